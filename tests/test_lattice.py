"""Lattices as arrays against the plain forward-backward pass, and seeds by ranges against a sort."""

import random
from collections import defaultdict

import numpy as np
import pytest

from lexforge.operators import lattice, seeds
from lexforge.operators.tokenizers import forward_backward


def test_expected_counts_equal_the_plain_pass(spark):
    r = random.Random(5)
    pieces = sorted({("Cl",), *[tuple(r.choice("abcd") for _ in range(r.randrange(1, 5))) for _ in range(40)]} | {("a",), ("b",), ("c",)} - {("d",)})
    pieces = [p for p in pieces if p != ("d",)]  # runs with d have a way only through longer pieces, or none
    runs = [([r.choice(["a", "b", "c", "Cl"] if r.random() < 0.9 else ["d", "a", "?"]) for _ in range(r.randrange(1, 12))], r.randrange(1, 9)) for _ in range(300)] + [(["a", "b"] * 900, 3)]
    names = sorted({g for p in pieces for g in p})
    ids = {g: i for i, g in enumerate(names, 1)}
    rows = np.array([[*[ids[g] for g in p], *[0] * (6 - len(p))] for p in pieces], np.int32)
    scores = np.array([-0.5 - 3 * r.random() for _ in pieces])
    scores[7] = -np.inf  # pruned
    want = defaultdict(float)
    own = {p: s for p, s in zip(pieces, scores) if s > -np.inf}
    for run, n in runs:
        for p, e in forward_backward(tuple(run), own, 6)[1].items():
            want[p] += n * e
    for parts in (1, 5):
        built = lattice.lattices(spark.createDataFrame(runs, "run array<string>, n long").repartition(parts), lattice.Numbers(rows), ids)
        found = lattice.expected(built, scores, 6)
        assert found == pytest.approx([want[p] for p in pieces], abs=1e-3, rel=1e-6)


def test_seeds_by_ranges_are_the_largest(spark):
    r = random.Random(6)
    rows = [(list("".join(r.choice("abcde") for _ in range(r.randrange(1, 9)))), r.randrange(1, 4)) for _ in range(400)]
    frame = spark.createDataFrame(rows, "run array<string>, n long").repartition(3)
    counts = {tuple(x["piece"]): x["n"] for x in seeds.substring_counts(frame, most=5).collect()}
    ranked = sorted((p for p in counts if len(p) > 1), key=lambda p: (-counts[p] * len(p), p))
    for size in (1, 50, 333, len(ranked), len(ranked) + 9):
        found = {tuple(x["piece"]): x["n"] for x in seeds.chosen(frame, most=5, size=size).collect()}
        assert found == {p: counts[p] for p in [*ranked[:size], *[p for p in counts if len(p) == 1]]}
