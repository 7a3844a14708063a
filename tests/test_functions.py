"""Goldens and brute force for hashing, lexing and plug-ins."""

import random

import pytest
from pyspark.sql import functions as F

from lexforge.functions import arrays, chemistry, hashing, lexing


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def col(spark, text):
    return F.lit(text)


def test_coordinates(spark):
    row = one(
        spark,
        hashing.acceptance_coordinate(F.lit("CCO"), "canon_dedup_v1.subsample"), hashing.acceptance_coordinate(F.lit("c1ccccc1"), "canon_dedup_v1.subsample"),
        hashing.split_coordinate(F.lit("CID12345"), 20260426, "canon_dedup_v1.split"), hashing.split_coordinate(F.lit(42), 20260426, "canon_dedup_v1.split"), hashing.split_coordinate(F.lit("42"), 20260426, "canon_dedup_v1.split"),
    )
    assert list(row) == [0.015198286035248986, 0.06477514790296351, 0.9345032237394443, 0.6478037945345199, 0.6478037945345199]


def test_fingerprints():
    assert hashing.shard_fingerprint(["1" * 64, "0" * 64]) == "66d6592c4fd2ef9711b916b230ccb594"
    with pytest.raises(ValueError):
        hashing.shard_fingerprint([])
    assert lexing.glyph_fingerprint() == "c563acba9cd6d4355612b49e8fcb0e77" and len(lexing.GLYPHS) == 158


def test_content_fingerprint_ignores_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "i int, t string")
    of = lambda d: d.agg(hashing.content_fingerprint(d)).first()[0]
    assert of(df) == of(df.orderBy(F.desc("i")).repartition(3)) != of(df.distinct())


@pytest.mark.parametrize(
    "text, want",
    [("C1ccccc1C", ["C", "1", "ccccc", "1", "C"]), ("CC(=O)O", ["CC", "(", "=O", ")", "O"]), ("C%12[Na+].[Cl-]", ["C", "%12", "[Na+]", ".", "[Cl-]"]), ("C[N", ["C", "[", "N"]), ("", []), ("a%b", ["a", "%", "b"])],
)
def test_chunks(spark, text, want):
    row = one(spark, lexing.chunks(F.lit(text)).alias("c"), lexing.spans(lexing.chunks(F.lit(text))).alias("s"))
    assert row["c"] == want and "".join(row["c"]) == text
    assert [text[s["start"] : s["end"]] for s in row["s"]] == want


def test_glyphs_and_conformance(spark):
    strings = ["CCO", "c1ccccc1", "[13CH3][nH]", "ClCBr", "[Cn]Cn", "C[te]1", "[C@@H](F)Cl", "C%12CC%12", "Qx", "[se]1cccc1", "C\\C=C/C", ""]
    df = spark.createDataFrame([(s,) for s in strings], "t string")
    rows = df.select("t", lexing.segment(F.col("t")).alias("native"), lexing.longest_match("t").alias("check"), lexing.conformant(F.col("t")).alias("ok")).collect()
    for r in rows:
        assert r["native"] == r["check"] and r["ok"] == (r["check"] is not None), r
    found = {r["t"]: r["native"] for r in rows}
    assert found["[Cn]Cn"] == ["[", "Cn", "]", "C", "n"] and found["[13CH3][nH]"] == ["[", "1", "3", "C", "H", "3", "]", "[", "n", "H", "]"]


def test_native_match_on_random_strings(spark):
    r = random.Random(3)
    strings = ["".join(r.choice(["C", "c", "[", "]", "Cl", "1", "=", "(", ")", "n", "H", "+", "Se", "x", "@"]) for _ in range(r.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(s,) for s in strings], "t string")
    # one level of brackets only: what stands in a bracket has no bracket
    bad = df.where(~F.col("t").rlike(r"\[[^\]]*\[|^[^\[]*\]|\][^\[]*\]|\[[^\]]*$")).where(~lexing.segment(F.col("t")).eqNullSafe(lexing.longest_match("t")))
    assert bad.collect() == []


def test_atoms_rings_and_classes(spark):
    row = one(
        spark, lexing.atom_spans(lexing.glyphs(F.lit("[nH]1cccc1Cl"))), lexing.atom_spans(F.array(F.lit("["), F.lit("C"))), lexing.relabel_rings(F.lit("C9CC9")), lexing.relabel_rings(F.lit("C%12CC%12")), lexing.relabel_rings(F.lit("CC")), lexing.atom_starts(F.lit("[nH]1cccc1Cl")), lexing.normalize(F.lit(" [Fe++] ")),
        F.array(*[lexing.surface_class(F.lit(x)) for x in ("[C", "=1(", "CC", "")]), F.array(*[lexing.piece_class(F.array(*map(F.lit, x))) for x in (["[", "C"], ["c"], ["C", "O"], ["C", "="], ["C"])]),
        lexing.piece_of(F.array(F.lit(0), F.lit(4), F.lit(9)), F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("end")), F.struct(F.lit(3).alias("start"), F.lit(6).alias("end")))),
    )
    assert [tuple(s) for s in row[0]] == [(0, 4), (5, 6), (6, 7), (7, 8), (8, 9), (10, 11)] and row[1] is None
    assert row[2] == "C1CC1" and row[3] is None and row[4] is None
    assert row[5] == [0, 5, 6, 7, 8, 10] and row[6] == "[Fe+2]"
    assert row[7] == ["bracket_internal", "structural", "atomic", "structural"] and row[8] == ["bracket", "aromatic", "heteroatom", "unsat-C", "sat-C"]
    assert row[9] == [0, 1, -1]


def test_offenders(spark):
    df = spark.createDataFrame([("C[te]1",), ("C?",), ("[te][zz]",)], "t string")
    assert [r[0] for r in df.select(lexing.offenders(F.col("t"))).collect()] == [["aromatic-Te"], ["other"], ["aromatic-Te", "aromatic-Zz"]]


def test_what_no_toolkit_reads(spark):
    texts = ["not a smiles [[[", "CC(", "C)C", "C()C", "C[si-]1cccc1", "c1nc2ccccc2[te]1", "CCO", "[Na+].[Cl-]", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = [r[0] for r in df.orderBy("i").select(lexing.offenders(F.col("t"))).collect()]
    assert found == [["rdkit-unparseable"]] * 4 + [["aromatic-Si"], ["aromatic-Te"], ["other"], ["other"], ["other"]]
    assert one(spark, lexing.offenders(F.lit("CCO"), F.lit(False)))[0] == ["rdkit-unparseable"]


def test_atoms_with_wildcards_and_any_bond(spark):
    row = one(spark, *[lexing.atom_starts(F.lit(t)) for t in ("*CC*", "C~C", "[13CH3]C(=O)Br", "C%12>?c$C", "CxC", "")])
    assert list(row) == [[0, 1, 2, 3], [0, 2], [0, 7, 10, 12], [0, 6, 8], None, []]


def test_white_space_goes_on_both_sides(spark):
    assert one(spark, lexing.normalize(F.lit("\t CC++\r\n")), lexing.normalize(F.lit("a b")))[0:2] == ("CC+2", "a b")


def test_starts_of_many_parts(spark):
    r = random.Random(2)
    rows = [(k, [r.randint(0, 5) for _ in range(k)]) for k in [0, 1, 2, 3, 5, 10, 99, 1000, 3001]]
    df = spark.createDataFrame([*rows, (-1, None)], "k int, x array<int>")
    found = {row["k"]: row["s"] for row in df.select("k", arrays.starts(F.col("x")).alias("s")).collect()}
    assert found == {k: [sum(x[:i]) for i in range(k)] for k, x in rows} | {-1: None}


def test_proper_substrings(spark):
    row = one(spark, *[lexing.proper_substrings(F.array(*map(F.lit, s))) for s in ("ab", "abc", "abcd")])
    assert [["".join(p) for p in x] for x in row] == [[], ["ab", "bc"], ["ab", "bc", "cd", "abc", "bcd"]]


def test_text_plugin(spark):
    df = spark.createDataFrame([(1, " a  b "), (2, "  "), (3, None)], "i int, t string")
    kept, seen = chemistry.canonicalize(df, "t", chemistry.TextCanonicalizer())
    assert [tuple(r) for r in kept.collect()] == [(1, "a b")] and seen.get == {"n_input": 3, "n_rejected": 2}
    orbit = chemistry.orbit(spark.createDataFrame([(1, "C1CC1")], "id int, t string"), "id", "t", plug=chemistry.TextCanonicalizer())
    assert {(r["axis"], r["text"]) for r in orbit.collect()} == {("canonical", "C1CC1"), ("rings", "C2CC2")}


def test_pieces_of_starts_against_brute_force(spark):
    r = random.Random(5)
    rows = []
    for _ in range(60):
        edges = sorted(r.sample(range(40), 2 * r.randint(0, 8)))
        spans = list(zip(edges[::2], edges[1::2]))
        if r.random() < 0.5:  # without gaps
            spans = list(zip(edges, edges[1:]))
        rows.append((sorted(r.randrange(40) for _ in range(r.randint(0, 12))), spans))
    df = spark.createDataFrame(rows, "s array<int>, p array<struct<start:int,end:int>>")
    for row in df.select("s", "p", lexing.piece_of(F.col("s"), F.col("p")).alias("found")).collect():
        assert row["found"] == [next((i for i, (a, b) in enumerate(row["p"]) if a <= s < b), -1) for s in row["s"]]
    long = spark.range(1).select(lexing.piece_of(F.sequence(F.lit(0), F.lit(99_999)), F.transform(F.sequence(F.lit(0), F.lit(49_999)), lambda i: F.struct((i * 2).alias("start"), (i * 2 + 2).alias("end")))).alias("x"))
    assert long.select(F.element_at("x", -1), F.size("x")).first()[:] == (49_999, 100_000)


def test_atom_spans_of_awkward_glyphs(spark):
    rows = [("[[C]",), ("C]",), ("[C]]",), ("[C",), ("",), (None,), ("C[N][O]c",), ("[]C",)]
    df = spark.createDataFrame([(t, None if t is None else list(t)) for (t,) in rows], "t string, g array<string>")
    found = {x["t"]: x["a"] and [tuple(y) for y in x["a"]] for x in df.select("t", lexing.atom_spans(F.col("g")).alias("a")).collect()}
    assert found == {"[[C]": None, "C]": None, "[C]]": None, "[C": None, "": [], None: None, "C[N][O]c": [(0, 1), (1, 4), (4, 7), (7, 8)], "[]C": [(0, 2), (2, 3)]}
