"""Deposits over a stream: what is there is skipped, batches don't reread it, failures don't write twice."""

from __future__ import annotations

import pytest

from lexforge.streaming import deposit_stream, incremental

SCHEMA = "k long, v long"


def started(spark, tmp_path, compute=lambda d: d):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return deposit_stream(stream, str(tmp_path / "out"), "k", str(tmp_path / "check"), compute)


def arrive(spark, tmp_path, *batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def deposited(spark, tmp_path):
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("k", "v").collect())


def test_batches_do_not_reread_the_table(spark, tmp_path, monkeypatch):
    reads = []
    own = incremental.known_keys
    monkeypatch.setattr(incremental, "known_keys", lambda *a: reads.append(a) or own(*a))
    spark.createDataFrame([(1, 100), (7, 700)], SCHEMA).write.parquet(str(tmp_path / "out"))  # from elsewhere
    arrive(spark, tmp_path, [(1, 1), (2, 5), (2, 4), (None, 0)], [(2, 1), (3, 3)], [(7, 1), (4, 4)], [(3, 0), (5, 5)])
    query = started(spark, tmp_path)
    query.awaitTermination()
    assert deposited(spark, tmp_path) == [(1, 100), (2, 4), (3, 3), (4, 4), (5, 5), (7, 700)]
    batches = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert len(batches) == 4 and len(reads) == 2  # once for the state, once for the run's first batch
    arrive(spark, tmp_path, [(5, 0), (6, 6), (7, 0)], [(6, 0)])
    started(spark, tmp_path).awaitTermination()
    assert deposited(spark, tmp_path)[-3:] == [(5, 5), (6, 6), (7, 700)] and len(reads) == 3


def test_a_batch_that_is_run_again_writes_nothing_twice(spark, tmp_path):
    arrive(spark, tmp_path, [(1, 1), (2, 2)], [(2, 0), (3, 3)])
    fail = [True]

    class Written:
        """Writes, and then fails: the batch isn't committed."""

        def __init__(self, df):
            self.df, self.write = df, self

        def mode(self, how):
            return self

        def parquet(self, path):
            self.df.write.mode("append").parquet(path)
            if fail:
                raise RuntimeError("lost after writing")

    with pytest.raises(Exception, match="lost after writing"):
        started(spark, tmp_path, Written).awaitTermination()
    fail.clear()
    started(spark, tmp_path, Written).awaitTermination()
    assert deposited(spark, tmp_path) == [(1, 1), (2, 2), (3, 3)]
