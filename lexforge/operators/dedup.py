"""Exact deduplication with a total, content-determined choice of the survivor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def dedup_window(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each ``key``: the first in ``order``, then in all other columns.

    The filter on the row number becomes a group limit below the shuffle, so a
    key with many rows sends one row a task, not all of them.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    window = Window.partitionBy(key).orderBy(*[F.col(c) for c in [*order, *rest]])
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def dedup_ordered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """As :func:`dedup_window`, with the rows in the order of the key over range partitions."""
    return dedup_window(df, key, order).orderBy(key)


def dedup_counts(df: DataFrame, key: str) -> DataFrame:
    """n_input, n_distinct and n_duplicates, from one aggregation by key."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_input"), F.count(F.lit(1)).alias("n_distinct")).withColumn("n_duplicates", F.col("n_input") - F.col("n_distinct"))


def bucket_key(text: Column) -> Column:
    """The hex of the first two UTF-8 bytes, padded with zeros: ordered as the texts are."""
    return F.rpad(F.lower(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 2))), 4, "0")
