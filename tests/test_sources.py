"""Sources and sinks."""

import gzip
import json
import math

import pytest
from pyspark.sql import functions as F

from lexforge.operators import tokenizers
from lexforge.sources import artifacts, delimited, schemas, sinks


def test_positional_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "a.tsv.gz", "wt") as out:
        out.write('007\tC"C\n8\t\n9\tCC\n')
    own = delimited.Delimited("s", str(tmp_path / "a.tsv.gz"), verbatim=True)
    assert [(r["source_id"], r["text"]) for r in delimited.ingest(spark, own).orderBy("source_id").collect()] == [("007", 'C"C'), ("9", "CC")]
    kept = delimited.Delimited("s", str(tmp_path / "a.tsv.gz"), verbatim=True, nulls="keep")
    assert delimited.ingest(spark, kept).where("text = ''").count() == 1
    coerced = schemas.coerce(delimited.ingest(spark, own).withColumn("more", F.lit(1)))
    assert coerced.columns == schemas.RAW_V1.names


def test_named(spark, tmp_path):
    (tmp_path / "n.csv").write_text("Identifier,Canonical SMI,mass\nX01,CCO,1.5\nX02,,2\n")
    own = delimited.Delimited("s", str(tmp_path / "n.csv"), mode="named", delimiter=",", header=True, id_column="identifier", text_column="canonical_smi", normalize_names=True)
    assert [(r["source_id"], r["text"]) for r in delimited.ingest(spark, own).collect()] == [("X01", "CCO")]
    with pytest.raises(ValueError):
        delimited.scan(spark, delimited.Delimited("s", str(tmp_path / "n.csv"), mode="named", header=True, delimiter=",", id_column="nope"))
    with pytest.raises(ValueError):
        delimited.Delimited("s", "x.csv.gz", mode="named", header=True)
    with pytest.raises(ValueError):
        delimited.Delimited("s", "x.csv", mode="named")


def test_file_sets_and_tranches(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"part-{k}.txt").write_text(f"text\tid\nC{k}\t{k}\n\t9\n")
    own = delimited.Delimited("s", [str(tmp_path / f"part-{k}.txt") for k in range(2)], header=True, id_first=False)
    assert sorted((r["n_rows"], r["n_kept"]) for r in delimited.file_tallies(spark, own).collect()) == [(2, 1), (2, 1)]
    digests = delimited.file_digests(spark, str(tmp_path), "*.txt")
    assert len(delimited.aggregate_digest(digests)) == 64
    found, failed = delimited.tranches(spark, {"a": own, "b": delimited.Delimited("s", str(tmp_path / "none")), "c": own}, done={"c"})
    assert found.where("tranche_id = 'a'").count() == 2 and list(failed) == ["b"]
    one = delimited.Delimited("t", own.path[0], header=True, id_first=False)  # shares a file with a
    other = tmp_path / "d%20 e"
    other.mkdir()
    (other / "x.txt").write_text("text\tid\nN\t7\nO\t8\n")
    (tmp_path / "named.csv").write_text("Id,Text\n1,P\n")
    more = {"a": own, "one": one, "dir": delimited.Delimited("u", str(other), header=True, id_first=False), "n": delimited.Delimited("v", str(tmp_path / "named.csv"), mode="named", delimiter=",", header=True, normalize_names=True)}
    found, failed = delimited.tranches(spark, more)
    assert not failed and sorted((r["tranche_id"], r["source"], r["source_id"], r["text"]) for r in found.collect()) == [
        ("a", "s", "0", "C0"), ("a", "s", "1", "C1"), ("dir", "u", "7", "N"), ("dir", "u", "8", "O"), ("n", "v", "1", "P"), ("one", "t", "0", "C0"),
    ]
    many = {}
    for k in range(12):
        (tmp_path / f"many-{k}.txt").write_text(f"{k}\tC\n")
        many[f"m{k}"] = delimited.Delimited(f"s{k}", str(tmp_path / f"many-{k}.txt"))
    found, _ = delimited.tranches(spark, many)
    assert {(r["tranche_id"], r["source"], r["source_id"]) for r in found.collect()} == {(f"m{k}", f"s{k}", str(k)) for k in range(12)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1  # one scan
    names = "tranche_id\tgeneration\theavy_atom_bin\tlogp_bin\turl\texpected_bytes"
    (tmp_path / "list.tsv").write_text(names + "\nt1\tg\tH04\tP0\thttp://x\t12\n")
    assert delimited.tranche_list(spark, str(tmp_path / "list.tsv")).first()["expected_bytes"] == 12
    (tmp_path / "bad.tsv").write_text("x\ty\n1\t2\n")
    with pytest.raises(ValueError):
        delimited.tranche_list(spark, str(tmp_path / "bad.tsv"))
    listed = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "tranche_id string")
    assert [r[0] for r in delimited.unused(listed, listed.where("tranche_id = 't1'"), ["t2"]).collect()] == ["t3"]


def test_sequence_survives_rereading(spark, tmp_path):
    spark.range(100).select("id").repartition(3).write.parquet(str(tmp_path / "t"))
    df = delimited.with_sequence(spark.read.parquet(str(tmp_path / "t")))
    assert sorted(r["seq"] for r in df.collect()) == list(range(100))
    assert [r["id"] for r in delimited.first_rows(df, 7).collect()] == [r["id"] for r in delimited.first_rows(delimited.with_sequence(spark.read.parquet(str(tmp_path / "t"))), 7).collect()]
    assert delimited.row_count(spark, str(tmp_path / "t")) == 100


def test_artifacts(spark, tmp_path):
    bpe = json.dumps({"model": {"vocab": {"C": 0, "O": 1}, "merges": [[0, 1], [2, 0]]}})
    assert [r["glyphs"] for r in artifacts.bpe_vocabulary(spark, bpe).orderBy("token_id").collect()] == [["C"], ["O"], ["C", "O"], ["C", "O", "C"]]
    uni = json.dumps({"model": {"type": "Unigram", "vocab": [{"glyphs": ["C", "C"], "score": -1.5}]}})
    assert artifacts.unigram_vocabulary(spark, uni).first()["score"] == -1.5
    with pytest.raises(ValueError):
        artifacts.unigram_vocabulary(spark, json.dumps({"model": {"type": "BPE", "vocab": []}}))
    log = tmp_path / "log.jsonl"
    log.write_text(json.dumps({"format": artifacts.SCAFFOLD_FORMAT, "vocab_size": 5}) + "\n" + json.dumps({"step": 1, "pair": [0, 1], "new_id": 2, "new_token": "CO", "candidate_freq": 9, "standalone": [[2, 9], [0, -9]]}) + "\n")
    head, records = artifacts.scaffold_log(spark, str(log))
    assert head["vocab_size"] == 5 and records.count() == 1
    log.write_text("{}\n")
    with pytest.raises(ValueError):
        artifacts.scaffold_log(spark, str(log))
    assert artifacts.record_or_none(tmp_path / "nope.json") is None and not artifacts.complete(tmp_path / "nope.json")


def test_tokenizers_saved_and_loaded(spark, tmp_path):
    """Train, save, load: the same pieces and segments, and the table readers see the same pieces."""
    words = ["banana", "bandana", "cabana", "abba", "nab", "[13CH3]", "Clan"] * 3
    table = tokenizers.chunk_table(spark.createDataFrame([(w,) for w in words], "t string"), "t")
    for own in (tokenizers.train_bpe(table, 30), tokenizers.train_unigram(table, 25, max_piece_length=4), tokenizers.train_bpe(table, 28, merge_brackets=True)):
        folder = f"file://{tmp_path}/{own.kind}{own.merge_brackets}"
        artifacts.save_tokenizer(spark, own, folder, corpus="test")
        back = artifacts.load_tokenizer(spark, folder)
        assert (back.kind, back.pieces, back.merges, back.merge_brackets) == (own.kind, own.pieces, own.merges, own.merge_brackets)
        for w in set(words) | {"xyz", "bananab"}:
            parts = tuple(w)
            assert back.segment(parts) == own.segment(parts)
        text = sinks.get_text(spark, f"{folder}/tokenizer.json")
        read = (artifacts.bpe_vocabulary if own.kind == "bpe" else artifacts.unigram_vocabulary)(spark, text)
        assert [tuple(r["glyphs"]) for r in read.orderBy("token_id").collect()] == own.pieces
        assert json.loads(sinks.get_text(spark, f"{folder}/meta.json"))["corpus"] == "test"


def test_manifests_and_configs_on_any_file_system(spark, tmp_path):
    folder = f"file://{tmp_path}/stage"
    sinks.publish(spark, spark.range(30).withColumn("t", F.lit("x")), folder, rows_per_shard=10, order=["id"])
    sinks.write_manifest(folder, name="x", schema="raw_v1", found=sinks.shards(spark, folder), spark=spark)
    assert artifacts.complete(f"{folder}/{sinks.STATE}", spark=spark) and not artifacts.complete(f"{folder}/none", spark=spark)
    assert artifacts.manifest(f"{folder}/{sinks.STATE}", spark)[1]["n_rows"] == 30
    path = sinks.put_text(spark, f"file://{tmp_path}/config.json", json.dumps({"source": "x", "path": "/a.tsv"}))
    assert artifacts.config(path, delimited.Delimited, spark) == delimited.Delimited("x", "/a.tsv")
    sinks.put_text(spark, path, json.dumps({"source": "x", "path": "/a.tsv", "colour": 1}))
    with pytest.raises(ValueError):
        artifacts.config(path, delimited.Delimited, spark)


def test_shards_by_bytes(spark):
    """A shard ends where its bytes are full, over ranges."""
    rows = [(i, "x" * (i % 17)) for i in range(400)]
    found = sinks.by_bytes(spark.createDataFrame(rows, "id int, t string").repartition(5), 500, ["id"]).orderBy("id").collect()
    upto, want = 0, []
    for i, t in rows:
        want.append(upto // 500)
        upto += len(json.dumps({"id": i, "t": t}, separators=(",", ":")))
    assert [r["shard"] for r in found] == want


def test_publish_and_manifest(spark, tmp_path):
    target = tmp_path / "stage"
    for n in (10, 20):
        sinks.publish(spark, spark.range(n), str(target), rows_per_shard=5)
        assert spark.read.parquet(str(target)).count() == n and not (tmp_path / "stage.tmp").exists()
    found = sinks.shards(spark, str(target)).cache()
    sinks.verify_shards(found, found)
    with pytest.raises(ValueError):
        sinks.verify_shards(found, found.withColumn("sha256", F.lit("0")))
    path = sinks.write_manifest(tmp_path, name="x", schema="raw_v1", found=found)
    assert artifacts.complete(path) and artifacts.manifest(path)[1]["n_rows"] == 20


def test_atomic_folder(tmp_path):
    with sinks.stage(tmp_path / "a") as (folder, _):
        (folder / "x").write_text("1")
    assert (tmp_path / "a" / "x").read_text() == "1"
    with pytest.raises(RuntimeError), sinks.atomic_folder(tmp_path / "a") as folder:
        (folder / "x").write_text("2")
        raise RuntimeError
    assert (tmp_path / "a" / "x").read_text() == "1" and not (tmp_path / "a.tmp").exists()


def test_ledger(tmp_path):
    ledger = sinks.Ledger(tmp_path / "ledger.json")
    assert ledger.reconcile("a", "1", record=False) is None
    ledger.record("a", "1")
    assert ledger.record("a", "1")["sha256"] == "1" == ledger.reconcile("a", "1")["sha256"]
    with pytest.raises(ValueError):
        ledger.record("a", "2")
    with pytest.raises(KeyError):
        ledger.get("b")


def test_rendered(spark, tmp_path):
    assert [sinks.number(x) for x in (None, math.nan, 0.12345)] == ["—", "nan", "0.1235"] and sinks.number(0.5, "+.4f") == "+0.5000"
    registry = spark.createDataFrame([("b",), ("a",), ("c",)], "k string")
    deposits = spark.createDataFrame([("a", 0.5), ("b", None)], "k string, v double")
    md, js = sinks.rendered(registry, deposits, "k", [("k", ""), ("v", ".4f")], tmp_path, "t")
    assert md.read_text().splitlines()[2:4] == ["| a | 0.5000 |", "| b | — |"] and json.loads(js.read_text())["pending"] == ["c"]


def test_cache_by_fingerprint(spark, tmp_path):
    first = sinks.cached_by(spark, spark.range(3), str(tmp_path), "f")
    assert first.count() == 3 == sinks.cached_by(spark, spark.range(9), str(tmp_path), "f").count() and sinks.cached_by(spark, spark.range(9), str(tmp_path), "g").count() == 9
