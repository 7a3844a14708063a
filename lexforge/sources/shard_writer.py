"""A sink of shards by bytes: files that roll over at a size, committed all at once with a manifest.

Tasks write files of their own into a staging folder, each until its encoded bytes
reach the budget, and tell the driver what they have written: name, rows, bytes,
SHA-256. Only when all tasks are done do the files that were told get their
final names, in order of tasks, and a manifest that lists them. A task that fails
or runs twice leaves files that nothing lists; the staging folder goes with them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexforge.functions.hashing import shard_fingerprint
from lexforge.session import uri

FORMAT, MANIFEST = "lexforge_shards", "shards.json"
#: Bytes of a shard, and rows that are encoded together.
TARGET, ROWS = 256 << 20, 4096


@dataclass
class Told(WriterCommitMessage):
    """What one task has written."""

    task: int
    shards: list[dict]


class _Counted:
    """A file that knows how much has been written, and its hash."""

    def __init__(self, out):
        self.out, self.n_bytes, self.sha, self.closed = out, 0, hashlib.sha256(), False

    def write(self, data) -> int:
        data = bytes(data)
        self.sha.update(data)
        self.n_bytes += len(data)
        self.out.write(data)
        return len(data)

    def tell(self) -> int:
        return self.n_bytes

    def flush(self) -> None:
        pass

    def close(self) -> None:
        self.closed = True


class Rolled:
    """Parquet files in a folder, a new one as soon as the last has reached its budget."""

    def __init__(self, filesystem: fs.FileSystem, folder: str, schema: pa.Schema, stem: str, target: int, rows: int = ROWS):
        self.filesystem, self.folder, self.schema, self.stem, self.target, self.rows = filesystem, folder, schema, stem, target, rows
        self.shards: list[dict] = []
        self.writer = None

    def add(self, batch: pa.RecordBatch) -> None:
        for at in range(0, batch.num_rows, self.rows):
            part = batch.slice(at, self.rows)
            if self.writer is None:
                name = f"{self.stem}-{len(self.shards):05d}.parquet"
                self.raw = self.filesystem.open_output_stream(f"{self.folder}/{name}")
                self.counted = _Counted(self.raw)
                self.writer = pq.ParquetWriter(pa.PythonFile(self.counted, "w"), self.schema, compression="zstd")
                self.name, self.n_rows = name, 0
            self.writer.write_batch(part)
            self.n_rows += part.num_rows
            if self.counted.n_bytes >= self.target:
                self.close()

    def close(self) -> None:
        if self.writer is not None:
            self.writer.close()
            self.raw.close()
            self.shards.append({"file": self.name, "sha256": self.counted.sha.hexdigest(), "n_rows": self.n_rows, "n_bytes": self.counted.n_bytes})
            self.writer = None


class ByteShards(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.filesystem, self.folder = fs.FileSystem.from_uri(uri(options["path"]))
        self.prefix, self.target = options.get("prefix", "shard"), int(options.get("targetbytes", TARGET))
        if self.target < 1:
            raise ValueError("targetBytes is at least 1")
        self.schema, self.overwrite, self.staging = to_arrow_schema(schema), overwrite, f".staging-{uuid.uuid4().hex}"
        if not overwrite and self._there():
            raise ValueError(f"{self.folder} holds shards already")

    def _there(self) -> bool:
        return self.filesystem.get_file_info(f"{self.folder}/{MANIFEST}").type == fs.FileType.File

    def write(self, batches: Iterator[pa.RecordBatch]) -> Told:
        from pyspark import TaskContext

        task = TaskContext.get()
        folder = f"{self.folder}/{self.staging}"
        self.filesystem.create_dir(folder, recursive=True)
        # an attempt's files are its own
        rolled = Rolled(self.filesystem, folder, self.schema, f"{task.partitionId():06d}-{task.taskAttemptId()}", self.target)
        for batch in batches:
            rolled.add(batch.cast(self.schema) if batch.schema != self.schema else batch)
        rolled.close()
        return Told(task.partitionId(), rolled.shards)

    def commit(self, messages: list[Told | None]) -> None:
        listed, names = [], set()
        for told in sorted((m for m in messages if m is not None), key=lambda m: m.task):
            for shard in told.shards:
                name = f"{self.prefix}-{self.staging[9:17]}-{len(listed):05d}.parquet"
                self.filesystem.move(f"{self.folder}/{self.staging}/{shard['file']}", f"{self.folder}/{name}")
                listed.append(shard | {"file": name})
                names.add(name)
        body = {"prefix": self.prefix, "n_rows": sum(s["n_rows"] for s in listed), "fingerprint": shard_fingerprint(s["sha256"] for s in listed) if listed else None, "shards": listed}
        self.filesystem.create_dir(self.folder, recursive=True)
        with self.filesystem.open_output_stream(f"{self.folder}/{self.staging}.json") as out:
            out.write(json.dumps(body, indent=2).encode())
        self.filesystem.move(f"{self.folder}/{self.staging}.json", f"{self.folder}/{MANIFEST}")  # from here on the new shards are the table
        self._drop_staging()
        for info in self.filesystem.get_file_info(fs.FileSelector(self.folder)):
            if info.base_name.startswith(f"{self.prefix}-") and info.base_name.endswith(".parquet") and info.base_name not in names:
                self.filesystem.delete_file(info.path)  # of the table before

    def abort(self, messages: list[Told | None]) -> None:
        self._drop_staging()

    def _drop_staging(self) -> None:
        if self.filesystem.get_file_info(f"{self.folder}/{self.staging}").type == fs.FileType.Directory:
            self.filesystem.delete_dir(f"{self.folder}/{self.staging}")


class ShardSource(DataSource):
    """``df.write.format("lexforge_shards").option("targetBytes", n).mode("overwrite").save(folder)``"""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> ByteShards:
        return ByteShards(self.options, schema, overwrite)


def write_shards(df: DataFrame, folder: str, *, target_bytes: int = TARGET, prefix: str = "shard", overwrite: bool = True) -> dict:
    """``df`` as shards in a folder of any file system that pyarrow has; returns the manifest.

    A shard is closed as soon as its encoded bytes reach the budget, so it is over it
    by one group of rows and the footer at most; only a task's last shard is smaller. Rows keep the order of their
    partitions. An empty table has a manifest without shards.
    """
    df.sparkSession.dataSource.register(ShardSource)
    df.write.format(FORMAT).option("targetBytes", str(target_bytes)).option("prefix", prefix).mode("overwrite" if overwrite else "append").save(folder)
    return manifest(folder)


def manifest(folder: str) -> dict:
    filesystem, path = fs.FileSystem.from_uri(uri(folder))
    with filesystem.open_input_stream(f"{path}/{MANIFEST}") as own:
        return json.loads(own.read())


def listed(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The rows of the shards that the manifest lists, and of no other file."""
    files = [f"{folder}/{s['file']}" for s in manifest(folder)["shards"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def changed(spark: SparkSession, folder: str) -> list[str]:
    """Listed shards that are missing or whose bytes differ from the manifest, hashed where they are read."""
    from pyspark.sql import functions as F

    from lexforge.sources.sinks import file_digests

    want = {s["file"]: s["sha256"] for s in manifest(folder)["shards"]}
    found = {r["file"]: r["sha256"] for r in file_digests(spark, folder, "*.parquet").select(F.element_at(F.split("file", "/"), -1).alias("file"), "sha256").collect()} if want else {}
    return sorted(f for f, sha in want.items() if found.get(f) != sha)
