"""Sinks: sharded tables, atomic publication, manifests, ledgers and rendered tables."""

from __future__ import annotations

import contextlib
import datetime
import fcntl
import json
import math
import os
import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexforge.functions.hashing import shard_fingerprint
from lexforge.session import written
from lexforge.sources.delimited import file_digests

STATE = "MANIFEST.json"


@contextlib.contextmanager
def atomic_folder(target: str | Path, keep_on_error: bool = False) -> Iterator[Path]:
    """A sibling folder to fill, that takes the target's place if all goes well; else it goes, or stays for a look."""
    target = Path(target)
    staging = target.with_name(target.name + ".tmp")
    shutil.rmtree(staging, ignore_errors=True)
    staging.mkdir(parents=True)
    try:
        yield staging
    except BaseException:
        if not keep_on_error:
            shutil.rmtree(staging, ignore_errors=True)
        raise
    old = target.with_name(target.name + ".old")
    shutil.rmtree(old, ignore_errors=True)
    if target.exists():
        target.rename(old)
    staging.rename(target)
    shutil.rmtree(old, ignore_errors=True)


@contextlib.contextmanager
def stage(target: str | Path) -> Iterator[tuple[Path, datetime.datetime]]:
    """A stage's folder and its start, UTC in whole seconds; what a failed stage wrote is kept."""
    with atomic_folder(target, keep_on_error=True) as folder:
        yield folder, datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None, microsecond=0)


def publish(spark: SparkSession, df: DataFrame, target: str, *, rows_per_shard: int = 0, order: list[str] | None = None) -> None:
    """Writes a Parquet table (zstd) beside ``target``, on any Hadoop file system, and renames it into place."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    staging, final, old = path(f"{target}.tmp"), path(target), path(f"{target}.old")
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(staging, True)
    rows = df.orderBy(*order) if order else df.hint("rebalance")
    writer = rows.write.option("compression", "zstd")
    (writer.option("maxRecordsPerFile", rows_per_shard) if rows_per_shard else writer).parquet(f"{target}.tmp")
    fs.delete(old, True)
    if fs.exists(final):
        fs.rename(final, old)
    fs.rename(staging, final)
    fs.delete(old, True)


def by_bytes(df: DataFrame, n_bytes: int, order: list[str]) -> DataFrame:
    """``df`` with a shard number: rows in order, a new shard wherever another ``n_bytes`` of content have gone by.

    Rows are dealt out by range and each range's bytes summed first, so the
    running sum is made in every range by itself.
    """
    size = F.length(F.to_json(F.struct(*[F.col(c) for c in df.columns]))).cast("long")
    ranged = written(df.withColumn("_size", size).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = ranged.groupBy("_range").agg(F.sum("_size").alias("_all")).withColumn("_before", F.coalesce(F.sum("_all").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("_range").alias("_own"), "_before")
    upto = F.sum("_size").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.withColumn("_upto", F.coalesce(upto, F.lit(0))).join(F.broadcast(before), F.col("_range") == F.col("_own"))
    return placed.withColumn("shard", F.floor((F.col("_upto") + F.col("_before")) / n_bytes).cast("int")).select(*df.columns, "shard")


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """(file, sha256, n_bytes, n_rows) of a table's files."""
    rows = spark.read.option("pathGlobFilter", "*.parquet").parquet(folder).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))
    digests = file_digests(spark, folder, "*.parquet").withColumn("file", F.element_at(F.split("file", "/"), -1))
    return digests.join(rows, "file", "left").select("file", "sha256", "n_bytes", F.coalesce("n_rows", F.lit(0)).alias("n_rows")).orderBy("file")


def verify_shards(found: DataFrame, expected: DataFrame) -> None:
    """An error if a file is missing, unexpected or different."""
    wrong = expected.select("file", F.col("sha256").alias("want")).join(found.select("file", "sha256"), "file", "full_outer").where(~F.col("want").eqNullSafe(F.col("sha256")))
    if (bad := [r["file"] for r in wrong.orderBy("file").limit(5).collect()]):
        raise ValueError(f"shards differ: {', '.join(bad)}")


def write_manifest(folder: str | Path, *, name: str, schema: str, found: DataFrame, spark: SparkSession | None = None, **more) -> Path:
    """A stage's manifest: its shards in order, their fingerprint, and counters. With a session the folder is of any Hadoop file system."""
    rows = [r.asDict() for r in found.collect()]
    body = {"schema": schema, "name": name, "n_rows": sum(r["n_rows"] for r in rows), "shards": rows, "fingerprint": shard_fingerprint(r["sha256"] for r in rows) if rows else None} | more
    if spark is not None:
        return Path(put_text(spark, f"{folder}/{STATE}", json.dumps(body, indent=2, sort_keys=True, default=str) + "\n"))
    return write_json(Path(folder) / STATE, body)


def write_text(path: str | Path, text: str) -> Path:
    """Text that is there whole or not at all."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=path.parent, delete=False) as out:
        out.write(text)
        out.flush()
        os.fsync(out.fileno())
    os.replace(out.name, path)
    return path


def put_text(spark: SparkSession, path: str, text: str) -> str:
    """As :func:`write_text`, on any Hadoop file system: written beside and renamed into place."""
    jvm = spark.sparkContext._jvm
    final, staging = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    with contextlib.closing(fs.create(staging, True)) as out:
        out.write(bytearray(text.encode()))
    fs.delete(final, False)
    fs.rename(staging, final)
    return path


def get_text(spark: SparkSession, path: str) -> str:
    """A small text file of any Hadoop file system; an OSError if there is none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(path)
    with contextlib.closing(fs.open(at)) as data:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(data)).decode()


def write_json(path: str | Path, body: object) -> Path:
    """JSON with sorted keys, two spaces and a last line end; NaN for undefined ratios."""
    return write_text(path, json.dumps(body, indent=2, sort_keys=True, default=str) + "\n")


class Ledger:
    """Artifacts by id and SHA-256, in one file; writers exclude each other."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def _entries(self) -> dict[str, dict]:
        return json.loads(self.path.read_text()) if self.path.exists() else {}

    def get(self, name: str) -> dict:
        """An entry, or KeyError."""
        return self._entries()[name]

    def record(self, name: str, sha256: str, **more) -> dict:
        """Adds an entry. The same again changes nothing; another digest for the id is an error."""
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with open(f"{self.path}.lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            entries = self._entries()
            if name in entries:
                if entries[name]["sha256"] != sha256:
                    raise ValueError(f"{name}: recorded with another digest")
                return entries[name]
            entries[name] = {"sha256": sha256} | more
            write_json(self.path, entries)
            return entries[name]

    def reconcile(self, name: str, sha256: str, record: bool = True) -> dict | None:
        """Compares with what is recorded; on first sight records, if asked to."""
        if name not in self._entries():
            return self.record(name, sha256) if record else None
        return self.record(name, sha256)


def lines(df: DataFrame, column: str, path: str) -> None:
    """One text a line."""
    df.select(F.col(column).cast("string").alias("value")).write.text(path)


def cached_by(spark: SparkSession, df: DataFrame, path: str, fingerprint: str) -> DataFrame:
    """A table kept under ``path`` as long as the fingerprint is the same."""
    target = f"{path}/{fingerprint}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        df.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def number(value: float | None, spec: str = ".4f") -> str:
    """A table's cell: a dash for None, ``nan`` for NaN, four decimals else."""
    return "—" if value is None else "nan" if math.isnan(value) else format(value, spec)


def markdown(rows: list[dict], columns: list[tuple[str, str]]) -> str:
    """Rows as a Markdown table; columns: (key, format, or an empty string for text)."""
    head = ["| " + " | ".join(k for k, _ in columns) + " |", "|" + "|".join("---" for _ in columns) + "|"]
    cell = lambda r, k, f: number(r[k], f) if f else str(r[k])
    return "\n".join([*head, *("| " + " | ".join(cell(r, k, f) for k, f in columns) + " |" for r in rows)]) + "\n"


def rendered(registry: DataFrame, deposits: DataFrame, key: str, columns: list[tuple[str, str]], folder: str | Path, topic: str) -> tuple[Path, Path]:
    """A topic's table, as Markdown and JSON: deposits in the order of their keys, and the registered keys that have none yet."""
    joined = registry.select(key).join(deposits.withColumn("_there", F.lit(True)), key, "left").orderBy(key)
    rows = [r.asDict() for r in joined.collect()]
    there = [r for r in rows if r.pop("_there")]
    pending = [r[key] for r in rows if r not in there]
    text = markdown(there, columns) + (f"\npending: {', '.join(pending)}\n" if pending else "")
    folder = Path(folder)
    return write_text(folder / f"{topic}_table.md", text), write_json(folder / f"{topic}_table.json", {"rows": there, "pending": pending})
