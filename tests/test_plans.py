"""Registry, deposits, sensitivity, audits, streaming, and the catalogue against its SQL."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from lexforge import plans
from lexforge.operators import emission, tokenizers
from lexforge.plans import audit, deposit, registry, sensitivity
from lexforge.sources import artifacts, schemas
from lexforge.streaming import deposit_stream, keyed_dedup

ROOT = Path(__file__).resolve().parent.parent
SLOW = {"unigram_train", "lattice_entropy"}


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows_of(df, columns):
    return sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - SLOW))
def test_catalogue(name, spark, sf, db):
    found = plans.QUERIES[name](spark, sf).toPandas()
    if name in plans.ORACLES:
        want = db.sql(plans.ORACLES[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert rows_of(found, sorted(found.columns)) == rows_of(want, sorted(found.columns))


def test_registry(spark):
    extras = registry.extras(spark)
    cells = registry.grid(spark).unionByName(registry.conditional(spark)).unionByName(extras)
    assert cells.count() == 138 == cells.select("cell_id").distinct().count() and extras.select("kind").distinct().count() == 17
    matched, alone = registry.pairs(cells)
    assert matched.count() == 34 and {(r["reason"], r["n"]) for r in alone.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()} == {("conditional_negative_branch", 2), ("extras_single_arm_knob", 4)}
    assert registry.pairs(cells, large_anchor=True)[0].count() == 35
    assert "pubchem__v512_nmb__subsample_r1" in {r["pair_key"] for r in matched.collect()}
    with pytest.raises(ValueError):
        registry.pairs(cells.unionByName(cells.where("tier = 'headline'").limit(1).withColumn("cell_id", F.lit("again"))))
    with pytest.raises(ValueError):
        registry.pairs(cells.where("not (kind = 'size_sweep' and algo = 'bpe') or kind is null"))
    knobs = {r["cell_id"]: r for r in registry.config(cells).collect()}
    assert knobs["pubchem__unigram_v512_nmb_mpl_ladder_4"]["max_piece_length"] == 4 and knobs["pubchem__bpe_v512_nmb_minfreq_ladder_0"]["min_frequency"] == 0 and knobs["pubchem__bpe_v256_mb"]["merge_brackets"]
    assert registry.smallest_bpe(cells.where("kind is null")).where("corpus = 'zinc22' and boundary = 'mb'").first()["bpe_cell_id"] == "zinc22__bpe_v256_mb"


def test_cells_done_and_isolated(spark, tmp_path):
    folder, table = f"file://{tmp_path}/cell", spark.createDataFrame([(list("abab"), 3), (list("abc"), 2)], "glyphs array<string>, n long")
    assert not audit.trained_from(spark, folder, "x")
    artifacts.save_tokenizer(spark, tokenizers.train_bpe(table, 6), folder, corpus_sha="x")
    assert audit.trained_from(spark, folder, "x") and not audit.trained_from(spark, folder, "y")
    train = audit.isolated(lambda c: [sys.executable, "-c", f"open(r'{tmp_path}/{c}', 'w')" if c != "bad" else "raise SystemExit(3)"])
    assert audit.dispatch(["a", "b"], audit.Seams(done=lambda c: c == "a", train=train), log=lambda line: None) == ["b"]
    assert (tmp_path / "b").exists() and not (tmp_path / "a").exists()
    with pytest.raises(RuntimeError):
        train("bad")


def test_confirmation_skips_what_is_there(spark):
    ranked = spark.createDataFrame([("x", r, 300 - 100 * r) for r in range(1, 4)] + [("y", 1, 500)], "cell string, rank int, n long")
    first = audit.confirm(ranked.where("cell = 'y'"), ["cell"], emission.threshold(ranked.limit(0), ["cell"], 0.95, 100))
    both = {r["cell"]: (r["clearing"], r["crossed"], r["first_rank_below"]) for r in audit.confirm(ranked, ["cell"], first.withColumn("clearing", F.lit(7).cast("long"))).collect()}
    assert both == {"x": (2, False, 3), "y": (7, True, None)}
    assert {r["clearing"] for r in audit.confirm(ranked, ["cell"], first, force=True).collect()} == {1, 2}


def test_identifiers():
    assert schemas.identifier("doc_id") == "`doc_id`"
    for bad in ("", "1a", "a b", "a`; drop", "é"):
        with pytest.raises(ValueError):
            schemas.identifier(bad)


def test_deposits(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    have = spark.createDataFrame([("a", "old", 1), ("b", "new", 2)], "k string, sha string, v int")
    fresh = deposit.fresh_block(F.col("sha"), F.lit("new"))
    make = lambda d: d.withColumn("sha", F.lit("new")).withColumn("v", F.lit(9))
    assert sorted(tuple(r) for r in deposit.deposit(names, have, "k", fresh, make).collect()) == [("a", "new", 9), ("b", "new", 2), ("c", "new", 9)]
    assert {r[0] for r in deposit.stale(names, have, "k", fresh, only=["a"]).collect()} == {"a"} and deposit.stale(names, have, "k", fresh, rebuild=True).count() == 3
    assert [r[0] for r in deposit.pending(names, have, "k").collect()] == ["c"] and [r[0] for r in deposit.violations(have, "k", F.col("v") > 1).collect()] == ["a"]
    t, f = F.lit(True), F.lit(False)
    got = spark.range(1).select(deposit.fresh_pair((t, t), (f, f)), deposit.fresh_pair((t, t), (t, f)), deposit.fresh_pair((f, f)), deposit.fresh_within_arm(t, [(t, t), (f, f)]), deposit.fresh_within_arm(f, [(t, t), (f, f)])).first()
    assert tuple(got) == (True, False, False, False, True)


def test_overlaps_by_sets_of_cells(spark):
    """No array holds all pieces of a cell, and a cell without pieces stays."""
    cells = spark.createDataFrame([(0, 2.0), (1, 4.0), (2, 1.0)], "rung int, fertility double")
    pieces = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b"), (1, "c"), (1, "c")], "rung int, piece string")
    crossed = sensitivity.crossing(cells, cells, pieces, pieces)
    found = {(r["y"], r["x"]): r["jaccard"] for r in crossed.collect()}
    third = pytest.approx(1 / 3)
    assert found == {(0, 0): 1, (0, 1): third, (1, 0): third, (1, 1): 1, (0, 2): 0, (2, 0): 0, (1, 2): 0, (2, 1): 0, (2, 2): None}
    assert "array_intersect" not in crossed._jdf.queryExecution().executedPlan().toString()
    other = spark.createDataFrame([(5, 1.0)], "rung int, fertility double")
    one = sensitivity.crossing(cells, other, pieces, spark.createDataFrame([(5, "c"), (5, "d")], "rung int, piece string"))
    assert {(r["y"], r["x"]): r["jaccard"] for r in one.collect()} == {(0, 5): 0, (1, 5): third, (2, 5): 0}
    placed = cells.withColumn("cell", F.col("rung")).withColumn("k", F.lit("k"))
    own = sensitivity.overlaps(pieces.select(F.col("rung").alias("cell"), "piece"), pieces.where("rung = 0").select(F.col("rung").alias("cell"), "piece"))
    got = sensitivity.contrasts(placed.where("rung > 0"), placed.where("rung = 0").drop("rung"), ["k"], own)
    assert {r["rung"]: (r["jaccard"], r["fertility_gap"]) for r in got.collect()} == {1: (third, pytest.approx(2 / 3)), 2: (0, pytest.approx(2 / 3))}


def test_sensitivity(spark):
    cells = spark.createDataFrame([(1, ["a", "b"], 2.0), (2, ["b", "c"], 4.0)], "rung int, pieces array<string>, fertility double")
    found = {(r["y"], r["x"]): r for r in sensitivity.crossing(cells, cells).collect()}
    assert found[1, 1]["jaccard"] == 1 and found[1, 2]["jaccard"] == pytest.approx(1 / 3) and found[1, 2]["fertility_gap"] == pytest.approx(2 / 3)
    refs = spark.createDataFrame([("p", ["a"], 1.0)], "corpus string, pieces array<string>, fertility double")
    swept = spark.createDataFrame([("p", 4, ["a", "b"], 2.0), ("q", 4, ["a"], 1.0)], "corpus string, mpl int, pieces array<string>, fertility double")
    got = {r["corpus"]: r["jaccard"] for r in sensitivity.contrasts(swept, refs, ["corpus"]).collect()}
    assert got == {"p": 0.5, "q": None}
    curve = sensitivity.ladder(swept.where("corpus = 'p'"), swept.where("corpus = 'q'"), 16, F.col("mpl")).collect()
    assert [(r["x"], r["is_default"]) for r in curve] == [(4.0, False), (16.0, True)]
    draws = spark.createDataFrame([("p", "bpe", "r10", 0.9), ("p", "bpe", "r2", 0.7)], "corpus string, algo string, label string, value double")
    r = sensitivity.robustness(draws, draws.withColumn("label", F.lit("5m"))).first()
    assert r["redraws"] == [0.7, 0.9] and r["spread"] == pytest.approx(0.2)
    listed = sensitivity.reference_of(spark.createDataFrame([("q", "special")], "corpus string, bpe_cell_id string"), swept.withColumn("default_ref", F.lit("base")), ["corpus"])
    assert {r["corpus"]: r["bpe_cell_id"] for r in listed.collect()} == {"p": "base", "q": "special"}


def test_audits(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["CCO", "CCCO", "c1ccccc1", "CCOC"] * 3)], "id int, t string")
    table = tokenizers.chunk_table(df, "t")
    train = lambda: tokenizers.train_bpe(table, 12)
    assert audit.train_twice(train).identical and audit.traced(train, train()) == train().log
    with pytest.raises(ValueError):
        audit.traced(train, tokenizers.train_bpe(table, 8))
    other = audit.compare(train(), tokenizers.train_bpe(table, 8))
    assert other.fatal and other.differing > 0 and audit.exhausted(train(), 50_000)["exhausted"]
    log, done = [], {"a"}
    seams = audit.Seams(done.__contains__, lambda c: done.add(c), [log.append])
    assert audit.dispatch(["a", "b"], seams, log=lambda x: None) == ["b"] and log == ["b"] and audit.dispatch(["a"], seams, force=True, dry_run=True, log=lambda x: None) == ["a"]


def test_streams(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    schema = "k long, v long"
    for batch in ([(1, 1), (2, 2), (2, 2)], [(2, 9), (3, 3)]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        deposit_stream(stream, str(target), "k", str(tmp_path / "check"), lambda d: d).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(target)).collect()) == [(1, 1), (2, 2), (3, 3)]
    events = spark.readStream.schema("k long, ts timestamp").parquet(str(source))
    assert keyed_dedup(events, "k", "ts", "1 hour").isStreaming


def test_entry_without_the_training_data_operators(tmp_path):
    """What the driver does: the subpackage and the pipeline are gone; the rest still imports."""
    import shutil

    for name in ("lexforge", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "lexforge/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'dedup_window' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=True)
