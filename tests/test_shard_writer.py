"""Shards by bytes: sizes, order, manifests, failed attempts, changed files."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lexforge.sources import shard_writer


def rows_of(spark, n, partitions=3):
    return spark.range(0, n, 1, partitions).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))


def test_rolls_at_the_budget_and_lists_what_it_wrote(spark, tmp_path):
    df = rows_of(spark, 60_000)
    body = shard_writer.write_shards(df, f"file://{tmp_path}/t", target_bytes=400_000, prefix="part")
    files = sorted(p.name for p in (tmp_path / "t").iterdir() if p.suffix == ".parquet")
    assert [s["file"] for s in body["shards"]] == files and len(files) > 6 and body["n_rows"] == 60_000
    for shard in body["shards"]:
        raw = (tmp_path / "t" / shard["file"]).read_bytes()
        assert (len(raw), hashlib.sha256(raw).hexdigest()) == (shard["n_bytes"], shard["sha256"])
        assert shard["n_bytes"] < 400_000 + 400_000
    assert sum(s["n_bytes"] < 400_000 for s in body["shards"]) <= 3  # the last of each task
    again = shard_writer.listed(spark, f"file://{tmp_path}/t", df.schema)
    assert again.exceptAll(df).isEmpty() and df.exceptAll(again).isEmpty()
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith(".staging")]
    first = spark.read.parquet(f"file://{tmp_path}/t/{files[0]}").select("id").collect()
    assert [r["id"] for r in first] == list(range(len(first)))  # rows in order


def test_replaces_and_refuses(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    one = shard_writer.write_shards(rows_of(spark, 100), folder, target_bytes=1000)
    with pytest.raises(Exception, match="holds shards already"):
        shard_writer.write_shards(rows_of(spark, 5), folder, overwrite=False)
    two = shard_writer.write_shards(rows_of(spark, 50), folder, target_bytes=1 << 20)
    assert not {s["file"] for s in one["shards"]} & {s["file"] for s in two["shards"]} and two["n_rows"] == 50
    assert {p.name for p in (tmp_path / "t").iterdir() if p.suffix == ".parquet"} == {s["file"] for s in two["shards"]}
    assert one["fingerprint"] != two["fingerprint"]
    with pytest.raises(Exception, match="at least 1"):
        shard_writer.write_shards(rows_of(spark, 5), folder, target_bytes=0)


def test_a_failed_job_leaves_the_table_as_it_was(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    before = shard_writer.write_shards(rows_of(spark, 100), folder, target_bytes=2000)
    bad = rows_of(spark, 3000).withColumn("text", F.when(F.col("id") == 2500, F.raise_error(F.lit("broken row"))).otherwise(F.col("text")).cast("string"))
    with pytest.raises(Exception, match="broken row"):
        shard_writer.write_shards(bad, folder, target_bytes=2000)
    assert shard_writer.manifest(folder) == before and shard_writer.changed(spark, folder) == []
    assert shard_writer.listed(spark, folder, rows_of(spark, 1).schema).count() == 100
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith(".staging")]


def test_changed_and_missing_shards_are_found(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    body = shard_writer.write_shards(rows_of(spark, 20_000), folder, target_bytes=200_000)
    a, b = body["shards"][0]["file"], body["shards"][1]["file"]
    raw = bytearray((tmp_path / "t" / a).read_bytes())
    raw[len(raw) // 2] ^= 1
    (tmp_path / "t" / a).write_bytes(bytes(raw))
    (tmp_path / "t" / f".{a}.crc").unlink(missing_ok=True)
    (tmp_path / "t" / b).rename(tmp_path / "t" / "other.parquet")
    assert shard_writer.changed(spark, folder) == sorted([a, b])


def test_empty_tables(spark, tmp_path):
    body = shard_writer.write_shards(rows_of(spark, 5).where("id < 0"), f"file://{tmp_path}/t")
    assert body["shards"] == [] and body["fingerprint"] is None and json.loads((tmp_path / "t" / "shards.json").read_text()) == body
    assert shard_writer.listed(spark, f"file://{tmp_path}/t", rows_of(spark, 1).schema).count() == 0 and shard_writer.changed(spark, f"file://{tmp_path}/t") == []
