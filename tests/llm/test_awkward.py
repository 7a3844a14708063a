"""Every operator and stage on awkward rows, on an empty table, and beside columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from lexforge.llm import langid, mixing, permindex, quality, secrets, simhash, spm, substring, syncmer, warc
from lexforge.llm.queries import MODEL
from lexforge.session import shared_path

OPERATORS = {
    "langid": langid.identify,
    "simhash": lambda d: simhash.near_duplicates(d, shingle=4, width=1, radii=(4,), blocks=6, similarity=None),
    "simhash wide": simhash.near_duplicates,
    "substring": substring.remove_repeats,
    "quality": quality.classify,
    "syncmers": syncmer.edits,
    "sentencepiece": lambda d: spm.round_trip(d, MODEL),
    "mixing": mixing.mix,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each(name, awkward, empty, clashing):
    run = OPERATORS[name]
    ids = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())
    found = run(awkward).drop("fingerprint").cache()
    assert ids(found) == ids(awkward)
    assert run(empty).count() == 0
    plain = [tuple(r) for r in found.collect()]
    beside = [tuple(r) for r in run(clashing).drop("fingerprint").collect()]
    assert sorted(map(str, plain)) == sorted(map(str, beside))


def test_secrets(awkward, empty, clashing):
    forest = secrets.train(awkward.sparkSession)
    found = secrets.scan(awkward, forest=forest).collect()
    assert [(r["doc_id"], r["value"], r["is_secret"]) for r in found] == [(10, "04dbebab91ab85687d33eeaaf9ac699e1188f962", True)]
    assert secrets.scan(empty, forest=forest).count() == 0
    assert secrets.scan(clashing, forest=forest).count() == 1
    redacted = secrets.redact(clashing, forest=forest)
    assert redacted.columns == clashing.columns
    changed = redacted.where("doc_id = 10").first()["text"]
    assert changed == 'token = "[SECRET]" and more words here'
    assert redacted.where(F.col("text").isNull()).count() == 1


@pytest.mark.parametrize("rows", ["awkward", "empty", "clashing"])
def test_stages(rows, request):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = request.getfixturevalue(rows)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = docs.sparkSession.createDataFrame(stage(docs.sparkSession, docs, "").collect(), docs.schema)
        assert docs.columns == columns, name
    last = corpus_pipeline.STAGES[-1][1](docs.sparkSession, docs, "")
    assert last.count() == docs.count()


def test_archives(awkward, empty, clashing):
    """Nulls, empty and very long payloads, repeats; beside columns with clashing names; nothing but nulls; no rows."""
    run = lambda df: sorted(map(str, warc.round_trip(df, id_col="doc_id", url_col="source", payload_col="text").drop("payload").collect()))
    plain = run(awkward)
    assert len(plain) == awkward.count() and run(clashing) == plain and run(empty) == []
    nulls = awkward.select(*[F.lit(None).cast(t).alias(c) for c, t in awkward.dtypes])
    assert [r["payload_bytes"] for r in warc.round_trip(nulls, id_col="doc_id", url_col="source", payload_col="text").collect()] == [0] * awkward.count()
    folder = shared_path(awkward.sparkSession, "awkward-warc")
    index = warc.write_archives(awkward, folder, id_col="doc_id", url_col="source", payload_col="text")
    assert warc.read_records(index.where("false"), folder).count() == 0


def test_vectors(spark):
    """Ties, repeats, a very long vector, clashing names; nothing but nulls; no rows."""
    rows = [(i, [float(i % 3), 1.0]) for i in range(45)] + [(60, [1.0] * 5000), (61, [2.0] * 5000), (None, [1.0, 1.0]), (40, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    run = lambda d: [tuple(r) for r in permindex.nearest(d).orderBy("query_id", "rank").collect()]
    plain = run(df)
    assert [r for r in plain if r[0] == 60] == [(60, 1, 61, 10000.0)] and [r[2] for r in plain if r[0] == 20] == [i for i in range(45) if i % 3 == 2 and i != 20] + [1, 4, 7, 10, 13, 16]
    beside = df.select("*", *[F.lit(1).alias(c) for c in ("v", "dim", "mark", "own", "at", "asks", "b", "qb", "score", "rank", "query_id")])
    assert run(beside) == plain
    assert run(df.select("vec_id", F.lit(None).cast("array<double>").alias("embedding"))) == run(df.limit(0)) == []


def test_nothing_but_nulls(awkward):
    nulls = awkward.select(*[F.lit(None).cast(t).alias(c) for c, t in awkward.dtypes])
    for name, run in OPERATORS.items():
        assert run(nulls).count() == awkward.count(), name


def test_stages_of_nothing_but_nulls(awkward):
    nulls = awkward.select(*[F.lit(None).cast(t).alias(c) for c, t in awkward.dtypes])
    n = awkward.count()
    forest = secrets.train(awkward.sparkSession)
    assert secrets.redact(nulls, forest=forest).collect() == nulls.collect() and secrets.redact(nulls.limit(0), forest=forest).count() == 0
    assert quality.keep_accepted(nulls).count() == 0
    assert 1 <= simhash.keep_representatives(nulls).count() <= n


def test_an_index_row_given_twice_is_read_twice(awkward):
    folder = shared_path(awkward.sparkSession, "twice-warc")
    index = warc.write_archives(awkward, folder, id_col="doc_id", url_col="source", payload_col="text")
    once = warc.read_records(index, folder).collect()
    twice = warc.read_records(index.union(index), folder).collect()
    assert sorted(map(str, twice)) == sorted(map(str, once + once))


def test_a_query_id_with_two_vectors(spark):
    """Each row is a candidate for others; the query asks once, with the smaller vector, and neither row is its own neighbour."""
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [5.0, 1.0]), (2, [1.0, 5.0])]
    found = [tuple(r) for r in permindex.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    assert found == [(20, 1, 2, 5.0), (20, 2, 1, 1.0)]
