"""Content-keyed samples, splits, conformance and chunk inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexforge.functions.hashing import acceptance_coordinate, split_coordinate
from lexforge.functions.lexing import chunks, conformant, offenders

SAMPLE_DOMAIN, SPLIT_DOMAIN = "canon_dedup_v1.subsample", "canon_dedup_v1.split"
SEED = 20260426


def hash_band(df: DataFrame, text_col: str, target: int, domain: str = SAMPLE_DOMAIN) -> DataFrame:
    """About ``target`` rows: those whose coordinate is below target over all (all, if there are fewer).

    A filter on the row alone: no shuffle, the same rows in every run, and a
    smaller target's rows are among a larger one's.
    """
    n = df.count()
    share = 1.0 if n == 0 else min(1.0, target / n)
    return df.where(acceptance_coordinate(F.col(text_col), domain) < share)


def holdout(df: DataFrame, id_col: str, *, share: float = 0.05, most: int = 1_000_000, seed: int = SEED, domain: str = SPLIT_DOMAIN) -> tuple[DataFrame, bool]:
    """``df`` with a split of ``test`` or ``train``, and whether the cap on test rows bound."""
    n = df.count()
    capped = most / n if n else 1.0
    limit = min(share, capped)
    coordinate = split_coordinate(F.col(id_col), seed, domain)
    return df.withColumn("split", F.when(coordinate < limit, "test").otherwise("train")), capped < share


def write_split(split: DataFrame, path: str) -> None:
    """The split as folders of one table, so that readers prune the other part."""
    split.write.partitionBy("split").option("compression", "zstd").parquet(path)


def fixed_sample(df: DataFrame, text_col: str, n: int, domain: str = SAMPLE_DOMAIN) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer): those with the smallest coordinates. Each task sends ``n`` at most."""
    return df.withColumn("_at", acceptance_coordinate(F.col(text_col), domain)).orderBy("_at", text_col).limit(n).drop("_at")


def filter_conformant(df: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows that the glyph alphabet covers, and the rejected texts with what offends."""
    ok = conformant(F.col(text_col))
    return df.where(ok), df.where(~ok).select(text_col, offenders(F.col(text_col)).alias("offenders"))


def conformance(df: DataFrame, text_col: str) -> DataFrame:
    """(kept, rejected): how many rows :func:`filter_conformant` keeps and rejects, in one pass."""
    ok = conformant(F.col(text_col))
    return df.select(ok.alias("ok")).agg(F.count_if("ok").alias("kept"), F.count_if(~F.col("ok")).alias("rejected"))


def chunk_inventory(df: DataFrame, text_col: str, *, seq: str | None = None, most: int | None = 3_000_000) -> tuple[DataFrame, bool]:
    """(chunk, n, is_bracket) of distinct chunks, and whether the cap on chunks outside brackets bound.

    The cap keeps those seen first by ``seq`` (by chunk, without one): it is the
    reference operator's own limit. None takes all, in one job less.
    """
    first = F.min(seq) if seq else F.min("chunk")
    all_chunks = df.select(*([seq] if seq else []), F.explode(chunks(F.col(text_col))).alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).withColumn("is_bracket", F.col("chunk").rlike(r"(?d)^\[.*\]$"))  # of line ends only \n is none of a bracket's signs
    plain = all_chunks.where("not is_bracket")
    bound = most is not None and plain.count() > most
    kept = plain.orderBy("first", "chunk").limit(most) if bound else plain
    return all_chunks.where("is_bracket").unionByName(kept).drop("first"), bound


def structural_split(chunk_pieces: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(piece, class): structural if some chunk outside brackets has it, bracket_internal if only brackets do, unseen else.

    chunk_pieces: (is_bracket, piece) of encoded distinct chunks.
    """
    seen = chunk_pieces.groupBy("piece").agg(F.bool_or(~F.col("is_bracket")).alias("outside"))
    label: Column = F.when(F.col("outside"), "structural").when(~F.col("outside"), "bracket_internal").otherwise("unseen")
    return vocabulary.select("piece").distinct().join(seen, "piece", "left").select("piece", label.alias("class"))
