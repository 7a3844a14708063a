"""The fixed schema of ingested corpora."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

RAW_V1 = T.StructType([
    T.StructField("source_id", T.StringType(), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("ingest_ts", T.TimestampNTZType(), False),
])


def identifier(name: str) -> str:
    """A name quoted for SQL; an error unless it is letters, digits and underscores and doesn't begin with a digit."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not an identifier: {name!r}")
    return f"`{name}`"


def coerce(df: DataFrame, schema: T.StructType = RAW_V1) -> DataFrame:
    """The schema's columns by name, cast; other columns go. A null where the schema has none is an error when it is met."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).to(T.StructType([T.StructField(f.name, f.dataType, True) for f in schema]))


def project(df: DataFrame, *, id_col: str, text_col: str, source: str | Column, ingest_ts: Column, nulls: str = "drop", keep: list[str] | None = None) -> DataFrame:
    """Rows in the raw schema, and the columns of ``keep``. ``nulls``: ``drop`` rows with a null or empty text, or ``keep`` them as empty texts."""
    if nulls not in ("drop", "keep"):
        raise ValueError("nulls: drop or keep")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("string").alias("source_id"), text.alias("text"), F.lit(source).alias("source"), ingest_ts.cast("timestamp_ntz").alias("ingest_ts"), *(keep or ()))
    return rows.where(F.length("text") > 0) if nulls == "drop" else rows
