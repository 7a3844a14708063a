"""Structured Streaming forms of the keyed, skip-if-fresh deposits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


def keyed_dedup(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each key once within the delay of the watermark; state older than that goes."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


class FirstOfKey(StatefulProcessor):
    """Of each key's rows the first by the other columns, once: a key that has been seen has no more rows."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [p.astype(object).sort_values(self.columns, kind="stable").head(1) for p in rows if len(p)]
        if parts and not self.seen.exists():
            self.seen.update((True,))
            yield pd.concat(parts).sort_values(self.columns, kind="stable").head(1)

    def close(self) -> None:
        pass


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def known_keys(spark: SparkSession, target: str, key: str) -> DataFrame:
    return spark.read.parquet(target).select(key)


def deposit_stream(stream: DataFrame, target: str, key: str, checkpoint: str, compute: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """What has arrived, computed and appended to a table, key by key: keys that the table has are skipped.

    Keys are kept as state, to begin with those of the table, so a batch costs what
    arrives and not what is there. Only a run's first batch is compared with the table, as it can be one that was
    written before a failure and is run again. Rows with a null key take no part.
    """
    spark = stream.sparkSession
    columns = [c for c in stream.columns if c != key]
    keyed = stream.where(F.col(key).isNotNull()).groupBy(key)
    # the keys that are there when the checkpoint begins; later runs have them from it
    there = known_keys(spark, target, key).distinct().groupBy(key) if _exists(spark, target) and not _exists(spark, checkpoint) else None
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    first = [True]

    def step(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        new = batch.select(stream.columns)
        if first and _exists(own, target):
            new = new.join(known_keys(own, target, key), key, "left_anti")
        compute(new).write.mode("append").parquet(target)
        first.clear()

    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        once = keyed.transformWithStateInPandas(statefulProcessor=FirstOfKey(columns or [key]), outputStructType=stream.schema, outputMode="Append", timeMode="None", initialState=there)
        return once.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)
