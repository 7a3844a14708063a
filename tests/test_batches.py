"""Arrays in Arrow batches are taken in parts, and what is made of them doesn't depend on the parts."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from lexforge.functions import batches, lexing
from lexforge.operators import emission, tokenizers
from lexforge.plans import token_queries


def test_parts_are_bounded_and_whole():
    r = random.Random(1)
    rows = [None if r.random() < 0.1 else ["x" * r.randrange(9) for _ in range(r.randrange(6))] for _ in range(300)]
    for own in (pa.array(rows, pa.list_(pa.string())), pa.array(rows, pa.list_(pa.string())).slice(17, 200)):
        found = [p.to_pylist() for p in batches.parts(own, 20)]
        assert [x for p in found for x in p] == own.to_pylist() and len(found) > 10
        assert all(len(p) == 1 or sum(len(w) for x in p for w in x or ()) <= 20 for p in found)
    assert [len(p) for p in batches.parts(pa.array([[1] * 9, [], [2], None, [3] * 4], pa.list_(pa.int32())), 5)] == [1, 4]


def test_a_task_makes_few_tokens_at_a_time():
    """A batch of many long texts is encoded in parts, and remembered chunks have an end."""
    own = token_queries.merging()
    texts = pa.array([[f"the thing {i} " * 2000] for i in range(60)], pa.list_(pa.string()))
    sizes = [len(tokenizers._encoded(own, p.to_pylist(), ("id",)).values) for p in batches.parts(texts)]
    assert len(sizes) > 2 and max(sizes) <= batches.MOST
    assert sum(map(len, own._known)) <= tokenizers.KNOWN


def test_glyphs_of_a_chunk_in_python(spark):
    r = random.Random(2)
    texts = ["".join(r.choice(["[", "]", "Cl", "Br", "@@", "C", "n", "l", "%12", "7", "(", "\n", "\r", " ", "é", "𝔸", " "]) for _ in range(r.randrange(14))) for _ in range(600)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(lexing.chunks(F.col("t")).alias("c"), F.transform(lexing.chunks(F.col("t")), lexing.glyphs).alias("g")).collect()
    assert [[lexing.chunk_glyphs(c) for c in x["c"]] for x in rows] == [x["g"] for x in rows]


def test_cuts_and_contrast_with_nulls_and_empties(spark):
    rows = [(1, [2, 1, 3], [3, 3]), (2, [], []), (3, None, None), (4, [5], [1, 4]), (5, [1] * 700, [7] * 100)]
    df = spark.createDataFrame(rows, "id int, a array<int>, b array<int>").coalesce(1)
    assert [x[0] for x in df.select(emission.cut_positions(F.col("a"))).collect()] == [[2, 3], [], None, [], list(range(1, 700))]
    whole = emission.contrast(df, ["id"], "a", "b").collect()
    ends = lambda c: F.when(F.col(c).isNotNull(), F.transform(F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1))), lambda k: F.aggregate(F.slice(c, 1, k), F.lit(0), lambda s, n: s + n)))
    made = df.select("id", *[F.when(F.size(c) == 0, F.array().cast("array<int>")).otherwise(ends(c)).alias(c) for c in ("a", "b")])
    assert emission.contrast_of_ends(made, ["id"], "a", "b").collect() == whole


def test_ends_equal_encoded_tokens(spark):
    df = spark.createDataFrame([(1, "the [Cl] thing"), (2, ""), (3, None), (4, "ou(ing)")], "id int, t string")
    arms = {"a": token_queries.merging(), "b": token_queries.scoring()}
    found = {r["id"]: r for r in tokenizers.ends(df, "t", arms, keep=["id"]).collect()}
    for arm, own in arms.items():
        for r in tokenizers.encode(df, "t", own).collect():
            assert found[r["id"]][arm] == (None if r["tokens"] is None else [t["end"] for t in r["tokens"]])
