"""Operators against hand-made and brute-force results."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexforge import plans
from lexforge.plans import lexing_queries
from lexforge.functions import lexing
from lexforge.functions.hashing import bootstrap_seed
from lexforge.operators import bootstrap, dedup, emission, parts, sampling, tokenizers, vocabulary


def pieces(spark, words, **more):
    return spark.createDataFrame([(list(w),) for w in words], "piece array<string>")


def test_dedup_survivor(spark):
    df = spark.createDataFrame([(2, "a", "x"), (1, "a", "y"), (1, "a", "x"), (3, "b", "z")], "i int, t string, s string")
    assert [tuple(r) for r in dedup.dedup_ordered(df, "t", ["i"]).collect()] == [(1, "a", "x"), (3, "b", "z")]
    plan = dedup.dedup_window(df, "t", ["i"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert df.select(dedup.bucket_key(F.lit("é")), dedup.bucket_key(F.lit("")), dedup.bucket_key(F.lit("abc"))).first()[:] == ("c3a9", "0000", "6162")


def test_samples_are_nested_and_split_is_disjoint(spark):
    df = spark.range(2000).select("id", F.concat(F.lit("t"), "id").alias("t"))
    small, large = ({r["id"] for r in sampling.hash_band(df, "t", n).collect()} for n in (100, 400))
    assert small < large and 60 < len(small) < 140
    assert sampling.hash_band(df.limit(0), "t", 5).count() == 0 and sampling.hash_band(df, "t", 10**9).count() == 2000
    split, bound = sampling.holdout(df, "id", most=20)
    assert bound and 5 < split.where("split = 'test'").count() < 40
    assert sampling.fixed_sample(df, "t", 10).count() == 10


def test_inventory_cap(spark):
    df = spark.createDataFrame([(0, "CC(C)"), (1, "[Na]O"), (2, "NN")], "seq int, t string")
    found, bound = sampling.chunk_inventory(df, "t", seq="seq", most=3)
    assert bound and {r["chunk"] for r in found.collect()} == {"[Na]", "(", ")", "C"} or {r["chunk"] for r in found.where("not is_bracket").collect()} <= {"CC", "(", "C", ")"}
    kept, rejected = sampling.filter_conformant(df.union(spark.createDataFrame([(3, "C[te]")], df.schema)), "t")
    assert kept.count() == 3 and rejected.first()["offenders"] == ["aromatic-Te"]
    chunks = spark.createDataFrame([(True, ["H"]), (False, ["C"]), (True, ["C"])], "is_bracket boolean, piece array<string>")
    assert {tuple(r["piece"]): r["class"] for r in sampling.structural_split(chunks, pieces(spark, ["C", "H", "O"])).collect()} == {("C",): "structural", ("H",): "bracket_internal", ("O",): "unseen"}


def test_overlap(spark):
    a, b, none = pieces(spark, ["ab", "c", "ab"]), pieces(spark, ["ab", "d"]), pieces(spark, ["x"]).limit(0)
    assert vocabulary.jaccard(a, b).first()[:] == (2, 2, 1, 1 / 3) and vocabulary.jaccard(none, none).first()["jaccard"] is None
    x, y = (spark.createDataFrame(rows, "piece string, n long") for rows in ([("p", 3), ("q", 1)], [("p", 1), ("r", 1)]))
    assert vocabulary.weighted_jaccard(x, y).first()["weighted_jaccard"] == pytest.approx(0.5 / (0.75 + 0.25 + 0.5))
    assert {tuple(r["piece"]): r["class"] for r in vocabulary.membership(a, b).collect()} == {("a", "b"): "shared", ("c",): "a_only", ("d",): "b_only"}
    assert vocabulary.symmetric_difference(a, b).count() == 2 and vocabulary.fresh(a, b).first()["piece"] == ["d"] and vocabulary.multi_glyph(a).count() == 1
    assert vocabulary.membership_counts(1 / 3, 2, 2) == (1, 1, 1)
    with pytest.raises(ValueError):
        vocabulary.membership_counts(0.4, 2, 2)
    assert vocabulary.length_profile(none).first()[:] == (0, 0.0, 0.0, 0) and vocabulary.length_profile(a).first()[:] == (3, 5 / 3, 2.0, 2)


def test_closure_against_brute_force(spark):
    r = random.Random(2)
    words = sorted({"".join(r.choice("ab[") for _ in range(r.randint(1, 5))) for _ in range(40)})
    multi = [w for w in words if len(w) > 1]
    known = set(words)
    parts = lambda w: [w[i:j] for i in range(len(w)) for j in range(i + 2, len(w) + 1) if w[i:j] != w]
    df = pieces(spark, words).withColumn("cell", F.lit("c"))
    found = vocabulary.closure(df, ["cell"]).first()
    assert found["n_bin_closed"] == sum(any(w[:i] in known and w[i:] in known for i in range(1, len(w))) for w in multi)
    assert found["n_orphan"] == sum(not any(p in known for p in parts(w)) for w in multi if len(w) > 2)
    assert found["n_full_closed"] == sum(all(p in known for p in parts(w)) for w in multi) and found["n_multi"] == len(multi)


def test_fertility_and_pairs(spark):
    units = spark.createDataFrame([("a", 2, 2), ("a", 4, 4), ("a", 6, 6), ("b", 0, 0)], "arm string, n_tokens int, n_glyphs int")
    found = {r["arm"]: r for r in emission.fertility(units, ["arm"]).collect()}
    assert found["a"]["variance"] == pytest.approx(8 / 3) and found["b"]["glyphs_per_token"] is None
    both = emission.pair_deltas(spark.createDataFrame([(1, 2.0, 5)], "k int, f double, g int"), spark.createDataFrame([(1, 3.0, 5)], "k int, f double, g int"), ["k"], ["f"], ["g"]).first()
    assert both["delta_f"] == 1.0 and both["same_g"] and spark.range(1).select(emission.relative_gap(F.lit(0.0), F.lit(0.0))).first()[0] is None


def test_distribution_counts_dead_pieces(spark):
    counts = spark.createDataFrame([("c", "x", 3), ("c", "y", 1), ("c", "z", 0), ("one", "x", 5)], "cell string, piece string, n long")
    found = {r["cell"]: r for r in emission.distribution(counts, ["cell"], F.when(F.col("cell") == "c", 4).otherwise(1)).collect()}
    p = np.array([0.75, 0.25])
    assert found["c"]["imbalance"] == pytest.approx(0.5 * (np.abs(p - 0.25).sum() + 0.5)) and found["c"]["entropy"] == pytest.approx(-(p * np.log2(p)).sum() / 2)
    assert found["c"]["renyi"] == pytest.approx(np.log2((p**2.5).sum()) / -1.5 / 2) and (found["one"]["imbalance"], found["one"]["entropy"], found["one"]["renyi"]) == (0, 0, 0)


def test_clearance_and_dead_zone(spark):
    vocab = spark.createDataFrame([("c", p) for p in "wxyz"], "cell string, piece string")
    counts = spark.createDataFrame([("c", "w", 300), ("c", "x", 100), ("c", "y", 60)], "cell string, piece string, n long")
    found = emission.clearance(vocab, counts, ["cell"]).first()
    assert (found["f_50"], found["f_100"], found["f_200"], found["unsafe"]) == (0.75, 0.5, 0.25, True)
    ranked = vocabulary.rank_frequency(counts, ["cell"])
    below = emission.threshold(ranked, ["cell"], 0.95, 100).first()
    assert (below["clearing"], below["crossed"], below["first_rank_below"]) == (2, False, 3)
    with pytest.raises(ValueError):
        emission.threshold(ranked, ["cell"], 0, 1)
    zone = emission.dead_zone(spark.createDataFrame([("p", 0.9, 0.96, 1.0, 1.0, 0.5, 0.1)], "k string, f_50_a double, f_50_b double, f_100_a double, f_100_b double, f_200_a double, f_200_b double"), ["k"])
    assert zone.count() == 9 and zone.where("p = 0.95 and n = 50").first()["any_unsafe"] and not zone.where("p = 0.95 and n = 50").first()["both_unsafe"]


def test_absorption(spark):
    span = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame([([(0, 1), (1, 2), (2, 7), (7, 8), (8, 8)], [(0, 1), (1, 2), (2, 5), (5, 8)])], f"c {span}, t {span}")
    got = df.select(emission.absorbed(F.col("c"), F.col("t"), True).alias("a"), emission.absorbed(F.col("c"), F.col("t"), False).alias("b")).first()
    assert tuple(got["a"]) == (4, 2, 1) and tuple(got["b"]) == (4, 2, None)


def test_nestedness(spark):
    df = spark.createDataFrame([([2, 3, 1], [2, 1, 2, 1])], "a array<int>, b array<int>")
    cut = df.select(emission.cut_positions(F.col("a")).alias("a"), emission.cut_positions(F.col("b")).alias("b"))
    assert tuple(cut.first()) == ([2, 5], [2, 3, 5])
    got = cut.select(emission.nestedness_of(F.col("a"), F.col("b"), F.lit(6)).alias("x")).select("x.*")
    assert tuple(got.first()) == (5, 2, 1, 0, 2) and emission.nestedness(got.withColumn("k", F.lit(1)), ["k"]).first()["nested"] == 1


def test_bonds_and_stability(spark):
    found = spark.range(1).select(emission.functional_bonds(lexing.glyphs(F.lit("CC(=O)OC#N"))).alias("b")).first()["b"]
    assert [(x["label"], x["position"]) for x in found] == [("C=O", 4), ("C#N", 9)]
    local = spark.range(1).select(emission.locality_of(emission.functional_bonds(lexing.glyphs(F.lit("CC(=O)OC#N"))), F.array(F.lit(4))).alias("bonds"), F.lit("x").alias("k"))
    assert emission.locality(local, ["k"]).first()["locality"] == 0.5
    row = spark.range(1).select(emission.bag_jaccard(F.array(F.lit(1), F.lit(1)), F.array(F.lit(1), F.lit(2))), emission.bag_jaccard(F.array().cast("array<int>"), F.array().cast("array<int>"))).first()
    assert tuple(row) == (pytest.approx(1 / 3), 1.0)
    encoded = spark.createDataFrame([(1, "canonical", [1, 2]), (1, "rings", [1, 3, 2])], "id int, axis string, tokens array<int>")
    r = emission.orbit_readings(encoded).first()
    assert (r["length_change"], r["bag_instability"]) == (0.5, pytest.approx(1 / 3))


def test_transfer(spark):
    units = spark.createDataFrame([("a", "a", 4, 8, 0), ("a", "b", 8, 8, 2), ("b", "b", 4, 4, 0), ("b", "a", 0, 0, 0)], "train string, eval string, n_tokens int, n_glyphs int, n_unknown int")
    found = {(r["train"], r["eval"]): r for r in emission.transfer(units, ["train", "eval"]).collect()}
    assert found["a", "b"]["oov_tokens"] == 0.25 and found["b", "a"]["oov_tokens"] == 0 and found["b", "a"]["glyphs_per_token"] is None
    table = {r["train"]: r for r in emission.transfer_penalty(emission.transfer(units, ["train", "eval"])).collect()}
    assert table["a"]["b"] == 2.0 and table["a"]["a"] == 1.0


def test_intervals():
    assert [bootstrap.bounds(n) for n in (1000, 40, 10, 1)] == [(25, 974), (1, 38), (0, 8), (0, 0)]
    x, d = np.array([1.0, 2, 3, 4]), np.array([1.0, 1, 0, 2])
    low, high = bootstrap.ratio_interval(x, d, 7, 200)
    assert low <= x.sum() / d.sum() <= high and bootstrap.ratio_interval(x, d, 7, 200) == (low, high)
    assert all(map(math.isnan, bootstrap.ratio_interval(x[:0], d[:0], 1))) and all(map(math.isnan, bootstrap.ratio_interval(x, d * 0, 1, 10)))


def test_interval_of_an_array(spark):
    sample = spark.range(1).select(bootstrap.percentile_interval(F.array(*[F.lit(float(x)) for x in (3, 1, 2)]), 3).alias("x")).first()["x"]
    assert tuple(sample) == (1.0, 2.0)


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(7)
    atoms = ["C", "CC", "c1ccccc1", "C(=O)O", "[nH]", "[Na+]", "Cl", "CCO", "N", "C#N"]
    return spark.createDataFrame([(i, "".join(r.choice(atoms) for _ in range(r.randint(1, 8)))) for i in range(300)], "id int, t string").cache()


def naive_bpe(table, size, least=2):
    """Recounts all pairs for every merge."""
    words = [([(g,) for g in run], n) for parts, n in table for run in tokenizers.runs(parts, False) if run]
    ids = {p: i for i, p in enumerate([("[UNK]",), *sorted({g for w, _ in words for g in w})])}
    merges = []
    while len(ids) < size:
        pairs = Counter()
        for w, n in words:
            for pair in zip(w, w[1:]):
                pairs[pair] += n
        if not pairs or max(pairs.values()) < least:
            break
        best = min(pairs, key=lambda p: (-pairs[p], ids[p[0]], ids[p[1]]))
        merges.append(best)
        ids.setdefault(best[0] + best[1], len(ids))
        for w, _ in words:
            k = 0
            while k + 1 < len(w):
                if (w[k], w[k + 1]) == best:
                    w[k : k + 2] = [best[0] + best[1]]
                k += 1
    return merges


def test_bpe_against_recounting(spark, corpus):
    table = tokenizers.chunk_table(corpus, "t")
    own = tokenizers.train_bpe(table, 40)
    assert own.merges == naive_bpe(tokenizers._collected(table), 40)
    counts = Counter(p for parts, n in tokenizers._collected(table) for p in own.segment(parts) for _ in range(n))
    delta = Counter()
    for record in own.log:
        for i, d in record["standalone"]:
            delta[i] += d
    assert all(delta[own.ids[p]] == counts[p] for p in own.pieces if len(p) > 1)
    longer = tokenizers.train_bpe(table, 44, start=own)
    assert longer.merges[: len(own.merges)] == own.merges and not any("[" in p and len(p) > 1 for p in own.pieces)
    log = spark.createDataFrame([(x["step"], x["candidate_freq"], x["standalone"]) for x in own.log], "step long, candidate_freq long, standalone array<array<long>>")
    last = own.log[-1]["candidate_freq"]
    want = {own.ids[p] for p in own.pieces if len(p) > 1 and counts[p] < last}
    assert {x["id"] for x in emission.scaffolds(log, own.vocabulary(spark).where("n_glyphs > 1").select(F.col("token_id").cast("long").alias("id"))).collect()} == want


def test_encode_round_trip(spark, corpus):
    table = tokenizers.chunk_table(corpus, "t")
    for own in (tokenizers.atomic(), tokenizers.train_bpe(table, 40), tokenizers.train_unigram(table, 40)):
        for r in tokenizers.encode(corpus, "t", own).collect():
            assert "".join(g for t in r["tokens"] for g in t["piece"]) == r["t"]
            assert all(r["t"][t["start"] : t["end"]] == "".join(t["piece"]) for t in r["tokens"])
            assert own.decode([t["id"] for t in r["tokens"]]) == r["t"]
    assert tokenizers.segment_table(corpus, "id", "t", own).agg(F.sum("n_glyphs")).first()[0] == corpus.select(F.sum(F.size(lexing.glyphs(F.col("t"))))).first()[0]
    with pytest.raises(ValueError):
        tokenizers.build("other", table)


def test_unigram_is_the_same_again(corpus):
    table = tokenizers.chunk_table(corpus, "t")
    a, b = tokenizers.train_unigram(table, 30), tokenizers.train_unigram(table.repartition(6), 30)
    assert a.pieces == b.pieces and len(a.pieces) <= 31


def all_ways(run, scores):
    if not run:
        return [(0.0, [])]
    return [(scores[run[:k]] + s, [run[:k], *w]) for k in range(1, len(run) + 1) if run[:k] in scores for s, w in all_ways(run[k:], scores)]


def test_lattice_against_all_segmentations():
    r = random.Random(11)
    for _ in range(200):
        scores = {tuple(r.choice("abc") for _ in range(r.randint(1, 3))): -r.random() * 4 for _ in range(7)}
        run = tuple(r.choice("abc") for _ in range(r.randint(1, 6)))
        ways = all_ways(run, scores)
        longest = max(map(len, scores))
        entropy = 0.0
        if ways:
            w = np.exp([s for s, _ in ways])
            p = w / w.sum()
            entropy = float(-(p * np.log(p)).sum())
            total, expected = tokenizers.forward_backward(run, scores, longest)
            assert total == pytest.approx(math.log(w.sum()))
            for piece in scores:
                assert expected.get(piece, 0.0) == pytest.approx(sum(q * way.count(piece) for q, (_, way) in zip(p, ways)), abs=1e-9)
            own = tokenizers.Tokenizer("unigram", [], scores=scores)
            if all((g,) in scores for g in run):
                assert sum(scores[x] for x in own.segment(run)) == pytest.approx(max(s for s, _ in ways))
        assert tokenizers.lattice_entropy(run, scores, longest) == pytest.approx(entropy, abs=1e-9)
    assert tokenizers.lattice_entropy(("a", "b"), {("a",): -1.0, ("b",): -1.0, ("a", "b"): -2.0}, 2) == pytest.approx(math.log(2))
    assert tokenizers.lattice_entropy(("z",), {("a",): 0.0}, 1) == 0.0


def test_segmentation_entropy_is_summed_over_chunks(spark, corpus):
    own = tokenizers.train_unigram(tokenizers.chunk_table(corpus, "t"), 40)
    found = {r["id"]: r["entropy"] for r in tokenizers.segmentation_entropy(corpus, "id", "t", own).collect()}
    for r in corpus.select("id", F.transform(lexing.chunks(F.col("t")), lexing.glyphs).alias("c")).limit(40).collect():
        assert found[r["id"]] == pytest.approx(sum(tokenizers.lattice_entropy(x, own.scores, own.longest) for c in r["c"] for x in tokenizers.runs(tuple(c), False)), abs=1e-9)


def test_intervals_by_the_standard_library():
    """Against the plain loop: indices drawn one by one, sums over them, places among the sorted ratios."""
    numerators, denominators = [3, 5, 2, 8, 13, 1, 4], [1, 2, 0, 3, 5, 0, 2]
    for seed in (123, bootstrap_seed("pubchem__smirk_gpe_v256_nmb")):
        rng, found = random.Random(seed), []
        for _ in range(200):
            drawn = [rng.randrange(7) for _ in range(7)]
            if below := sum(denominators[i] for i in drawn):
                found.append(sum(numerators[i] for i in drawn) / below)
        found.sort()
        low, high = bootstrap.bounds(len(found))
        got = bootstrap.ratio_interval(np.array(numerators, float), np.array(denominators, float), seed, 200, generator="stdlib")
        assert got == pytest.approx((found[low], found[high]))
    with pytest.raises(ValueError):
        bootstrap.ratio_interval(np.ones(2), np.ones(3), 1)
    with pytest.raises(ValueError):
        bootstrap.ratio_interval(np.ones(2), np.ones(2), 1, generator="other")


def test_places_and_arms_beside(spark):
    rows = spark.range(1, 400).select("id", *bootstrap.places(F.col("id"))).collect()
    assert all((r[1], r[2]) == bootstrap.bounds(r[0]) for r in rows)
    both = emission.arms_beside(spark.createDataFrame([("x", "a", 1.0), ("x", "b", 3.0), ("y", "a", 1.0)], "k string, arm string, f double"), "arm", ["k"], ["f"]).collect()
    assert [r[:] for r in both] == [("x", 1.0, 3.0, 2.0)]


def test_conformance_in_one_pass(spark):
    df = spark.createDataFrame([("C[Na]",), ("C[te]",), (None,), ("",), ("C?",)], "t string")
    found = sampling.conformance(df, "t")
    assert found.first()[:] == tuple(x.count() for x in sampling.filter_conformant(df, "t")) == (2, 3)
    assert "Union" not in found._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in lexing_queries.conformance_counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_readings_beside_are_those_of_rows(spark, sf):
    r = random.Random(7)
    bag = lambda: [r.choice(["a", "b", "é", "cc", None]) for _ in range(r.randint(0, 12))]
    rows = [(i, bag(), bag(), bag()) for i in range(300)] + [(300, ["a"], [], None)]
    df = spark.createDataFrame(rows, "id int, base array<string>, p array<string>, q array<string>")
    found = {(x["id"], x["axis"]): (x["length_change"], x["bag_instability"]) for x in emission.readings_beside(df, ["id"], "base", {"p": "p", "q": "q"}).collect()}
    assert len(found) == 2 * sum(len(x[1]) > 0 for x in rows)
    for (i, axis), (change, instability) in found.items():
        a, b = rows[i][1], rows[i][2 if axis == "p" else 3]
        if b is None:
            assert (change, instability) == (None, None)
            continue
        low = (Counter(a) & Counter(b)).total()
        assert change == pytest.approx(abs(len(a) - len(b)) / len(a)) and instability == pytest.approx(1 - low / (len(a) + len(b) - low))
    long = df.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("axis"), F.col(c).alias("tokens")) for k, c in (("canonical", "base"), ("p", "p"))])).alias("v")).select("id", "v.*")
    assert {(x["id"], x["axis"]): x["bag_instability"] for x in emission.orbit_readings(long).collect()} == {k: pytest.approx(v[1]) for k, v in found.items() if k[1] == "p"}
    plan = plans.QUERIES["noncanonicity"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_multi_glyph_makes_glyphs_once(spark, sf):
    """No filter repeats what makes the pieces, arrays aren't shuffled, and spellings keep the session's number of tasks."""
    df = spark.createDataFrame([("CCl",), ("C",), ("CCl",), ("C[Na]",), (None,)], "t string").select(lexing.glyphs(F.col("t")).alias("piece"))
    found = vocabulary.multi_glyph(df)
    assert sorted(tuple(r["piece"]) for r in found.collect()) == [("C", "Cl"), ("C", "[", "Na", "]")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "regexp_extract_all" in x] and not [x for x in plan.splitlines() if "Exchange hashpartitioning(piece" in x]
    rows = lexing_queries.notations(spark, sf)
    assert rows.count() == rows.distinct().count() and rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_parts_that_may_be_pieces(spark):
    """The filter leaves out no part that is a piece of the same vocabulary, and lets few others through; closure sends only these to its join."""
    r = random.Random(5)
    words = sorted({"".join(r.choice("abcdefgh[") for _ in range(r.randint(1, 9))) for _ in range(600)})
    df = spark.createDataFrame([(c, list(w)) for w in words for c in (["x", "y"] if len(w) % 2 else ["x"])], "cell string, piece array<string>")
    place = parts.likely(df.withColumn("len", F.size("piece")), ["cell"])
    told = others = 0
    for cell, piece, found in df.select("cell", "piece", place(F.col("piece"))).collect():
        known = {w for w in words if cell == "x" or len(w) % 2}
        w, n = "".join(piece), len(piece)
        due = {(k, i) for k in range(1, n) for i in range(n - k + 1) if w[i : i + k] in known and (k > 1 or i in (0, n - 1))}
        got = {(p >> 32, p & (1 << 32) - 1) for p in found}
        assert due <= got
        told, others = told + len(got), others + len(got - due)
    assert told > 1000 and others < told / 100
    plan = vocabulary.closure(df, ["cell"])._jdf.queryExecution().executedPlan().toString()
    assert "sequence(" not in plan


def test_closure_of_a_very_long_piece(spark):
    df = spark.createDataFrame([(["a"] * 3000,), (["a"] * 2,), (["a"] * 2998,), (["b"],)], "piece array<string>")
    assert vocabulary.closure(df, []).first()[:6] == (3, 2, 1, 0, 1, 0)


def test_ranks_of_one_large_corpus(spark):
    """One corpus in many ranges, ties and a null corpus among them: the window's ranks, and no task with all rows."""
    rows = spark.range(0, 60_000, 1, 6).select(F.when(F.col("id") % 50 == 0, None).otherwise("c").alias("cell"), F.concat(F.lit("p"), "id").alias("piece"), (F.col("id") * 7919 % 400).alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else a table as small as this is one range
    try:
        ranked = vocabulary.rank_all(rows, ["cell"])
        ranges = ranked.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(ranges) > 1 and max(r["count"] for r in ranges) < 40_000
    assert ranked.exceptAll(vocabulary.rank_frequency(rows, ["cell"]).withColumn("rank", F.col("rank").cast(dict(ranked.dtypes)["rank"]))).isEmpty() and ranked.count() == 60_000


def test_chunk_inventory_query_takes_all_chunks(spark, tmp_path, monkeypatch):
    """The query has no cap on chunks, and brackets with a carriage return are brackets, as in its SQL."""
    whole = sampling.chunk_inventory
    monkeypatch.setattr(sampling, "chunk_inventory", lambda df, text_col, most=2, **more: whole(df, text_col, most=most, **more))
    text = [("a1bb2ccc3dddd(e)[x\ry][z]\n[q\nr]",), (None,), ("",)]
    spark.createDataFrame(text, "text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.sql(plans.ORACLES["chunk_inventory"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()[0]
    assert tuple(plans.QUERIES["chunk_inventory"](spark, str(tmp_path)).first()) == want
