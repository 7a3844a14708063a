"""Delimited sources: positional and named files, file sets, and lists of tranches."""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from lexforge.sources.schemas import project


def utc_now() -> Column:
    """This run's time stamp, taken once on the driver: UTC, whole seconds, no zone."""
    return F.lit(datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None, microsecond=0)).cast("timestamp_ntz")


@dataclass(frozen=True)
class Delimited:
    """How to read a delimited corpus.

    positional: two columns without usable names, the id first or second.
    named: a header, the two columns picked by name, others dropped; files can't
    be compressed, as their header couldn't be checked before.
    """

    source: str
    path: str | list[str]
    mode: str = "positional"
    delimiter: str = "\t"
    header: bool = False
    id_first: bool = True
    id_column: str = "id"
    text_column: str = "text"
    id_type: str = "string"
    normalize_names: bool = False
    verbatim: bool = False
    nulls: str = "drop"
    options: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.mode not in ("positional", "named"):
            raise ValueError("mode: positional or named")
        if self.mode == "named" and not self.header:
            raise ValueError("a named source has a header")
        if self.mode == "named" and any(re.search(r"\.(gz|zst|bz2)$", p) for p in ([self.path] if isinstance(self.path, str) else self.path)):
            raise ValueError("a named source isn't compressed")


def normalized(name: str) -> str:
    """A column name in lower case, with underscores for what isn't a letter or digit."""
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def _columns(spark: SparkSession, own: Delimited) -> DataFrame:
    """The file's columns, before the two are picked."""
    reader = spark.read.options(sep=own.delimiter, header=str(own.header).lower(), **own.options)
    if own.verbatim:
        reader = reader.options(quote="", escape="\u0000")
    paths = [own.path] if isinstance(own.path, str) else sorted(own.path)
    if own.mode == "positional":
        kind = T.LongType() if own.id_type in ("long", "bigint") else T.StringType()
        fields = [T.StructField("id", kind), T.StructField("text", T.StringType())]
        return reader.option("enforceSchema", "true").schema(T.StructType(fields if own.id_first else fields[::-1])).csv(paths)
    df = reader.csv(paths)  # all columns as text: ids keep their leading zeros
    return df.withColumnsRenamed({c: normalized(c) for c in df.columns}) if own.normalize_names else df


def scan(spark: SparkSession, own: Delimited) -> DataFrame:
    """(id, text) as the file has them; the columns not asked for aren't parsed."""
    return _picked(_columns(spark, own), own)


def _picked(df: DataFrame, own: Delimited) -> DataFrame:
    if own.mode == "positional":
        return df.select("id", "text")
    missing = {own.id_column, own.text_column} - set(df.columns)
    if missing:
        raise ValueError(f"no such column: {', '.join(sorted(missing))}")
    return df.select(F.col(own.id_column).alias("id"), F.col(own.text_column).alias("text"))


def ingest(spark: SparkSession, own: Delimited, ingest_ts: Column | None = None) -> DataFrame:
    """A delimited corpus in the raw schema."""
    return project(scan(spark, own), id_col="id", text_col="text", source=own.source, ingest_ts=utc_now() if ingest_ts is None else ingest_ts, nulls=own.nulls)


def file_tallies(spark: SparkSession, own: Delimited) -> DataFrame:
    """(file, n_rows, n_kept) for each file of a set, in one scan."""
    rows = scan(spark, own)
    kept = F.coalesce(F.length("text"), F.lit(0)) > 0
    return rows.select(F.input_file_name().alias("file"), kept.alias("kept")).groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("kept").alias("n_kept"))


def file_digests(spark: SparkSession, paths: str | list[str], pattern: str = "*") -> DataFrame:
    """(file, n_bytes, sha256) of each file, hashed by the executors; for files that fit in a task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(paths)
    return files.select(F.col("path").alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def aggregate_digest(digests: DataFrame, by: str = "file") -> str:
    """SHA-256 of the sorted ``name:sha256`` lines of a file set."""
    lines = digests.select(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.element_at(F.split(by, "/"), -1), "sha256"))), "\n").alias("x"))
    return lines.select(F.sha2("x", 256)).first()[0]


TRANCHES = "tranche_id string, generation string, heavy_atom_bin string, logp_bin string, url string, expected_bytes long"


def tranche_list(spark: SparkSession, path: str) -> DataFrame:
    """A list of tranches: six tab-separated columns under an exact header; anything else is an error."""
    names = [f.split()[0] for f in TRANCHES.split(", ")]
    head = spark.read.text(path).first()
    if head is None or head[0].split("\t") != names:
        raise ValueError(f"the header isn't {names}")
    return spark.read.schema(TRANCHES).options(sep="\t", header="true", mode="FAILFAST", enforceSchema="false").csv(path)


def tranches(spark: SparkSession, sources: dict[str, Delimited], done: set[str] = frozenset(), ingest_ts: Column | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """All tranches that aren't done as one table with a tranche_id, and what failed by tranche.

    A tranche that can't be planned (no such path, a wrong header) is left out
    and told; it doesn't stop the others. Tranches of one form are one scan, however
    many they are, and a row's tranche is looked up by its file; a tranche that
    shares a file with another is a scan of its own.
    """
    groups: dict[tuple, list[Delimited]] = {}
    files: dict[tuple, dict[str, tuple[str, str]]] = {}
    failed: dict[str, str] = {}
    for name in sorted(set(sources) - set(done)):
        own = sources[name]
        try:
            df = _columns(spark, own)
            here = _picked(df, own).inputFiles()
        except Exception as error:
            failed[name] = f"{type(error).__name__}: {str(error).splitlines()[0]}"
            continue
        form = (tuple(df.columns), repr(replace(own, source="", path="")))
        if files.get(form, {}).keys() & set(here):
            form = (*form, name)
        groups.setdefault(form, []).append(own)
        files.setdefault(form, {}).update((f, (name, own.source)) for f in here)
    found, stamp = None, utc_now() if ingest_ts is None else ingest_ts
    for form, members in groups.items():
        paths = [p for m in members for p in ([m.path] if isinstance(m.path, str) else m.path)]
        rows = scan(spark, replace(members[0], path=paths)).select("*", F.input_file_name().alias("_file"))
        of = spark.createDataFrame([(f, *x) for f, x in files[form].items()], "_file string, tranche_id string, _source string")
        df = project(rows.join(of, "_file"), id_col="id", text_col="text", source=F.col("_source"), ingest_ts=stamp, nulls=members[0].nulls, keep=["tranche_id"])
        found = df if found is None else found.unionByName(df)
    return found, failed


def unused(discovered: DataFrame, used: DataFrame, excluded: list[str], key: str = "tranche_id") -> DataFrame:
    """The tranches that are neither used nor listed as excluded; there should be none."""
    return discovered.select(key).join(used.select(key), key, "left_anti").where(~F.col(key).isin(excluded))


def union(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The tables of several folders as one, in the order of their paths."""
    return spark.read.option("pathGlobFilter", "*.parquet").parquet(*sorted(paths))


def with_sequence(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows numbered in the order of file names and rows in them (Parquet): an order that rereading keeps.

    Counts by file come first, so that no window runs over more than one file.
    """
    at = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    before = at.groupBy("_file").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_file", "_before")
    return at.join(before, "_file").withColumn(seq, F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")


def first_rows(df: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """The first ``n`` rows in sequence order; each task sends ``n`` at most."""
    return df.orderBy(seq).limit(n)


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet folder, from the footers."""
    return spark.read.option("pathGlobFilter", "*.parquet").parquet(path).count()
