"""Substring counts by suffix arrays against counting every substring."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.operators import seeds


def plain(rows, most, least=2):
    found = Counter()
    for run, n in rows:
        for i in range(len(run or ())):
            for j in range(i + 1, min(len(run), i + most) + 1):
                found[tuple(run[i:j])] += n
    return {p: n for p, n in found.items() if n >= least or len(p) == 1}


def made_runs(seed, n, letters, longest=14):
    rng = random.Random(seed)
    parts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(8)]
    rows = [(list("".join(rng.choice(parts) for _ in range(rng.randrange(0, longest // 2)))), rng.randrange(1, 4)) for _ in range(n)]
    return [*rows, (None, 3), (["Cl", "C", "Cl", "C", "Cl"], 1), (["a"] * 40, 2)]


@pytest.mark.parametrize("seed,letters,most,partitions", [(1, "ab", 6, 3), (2, "abcdef", 16, 4), (3, "abc", 2, 1), (4, "aab", 16, 5)])
def test_counts_equal_plain_python(spark, seed, letters, most, partitions):
    rows = made_runs(seed, 150, letters)
    frame = spark.createDataFrame(rows, "run array<string>, n long").repartition(partitions)
    found = {tuple(r["piece"]): r["n"] for r in seeds.substring_counts(frame, most=most).collect()}
    assert found == plain(rows, most)


@pytest.mark.parametrize("seed", range(4))
def test_branches_stand_for_every_substring_once(seed):
    """In one task: each substring is in the range of one branch, with its count; there are at most two branches a suffix."""
    rng = np.random.default_rng(seed)
    runs = [rng.integers(1, 3, rng.integers(1, 12)) for _ in range(40)]
    weight = rng.integers(1, 5, len(runs))
    rows, owner = seeds.suffixes(np.concatenate(runs), np.array([len(r) for r in runs]), 7)
    found = {}
    many = 0
    for own, length, least, counts in seeds.branches(rows, weight[owner]):
        many += len(own)
        for row, low, n in zip(own.tolist(), least.tolist(), counts.tolist()):
            for k in range(low, length + 1):
                assert tuple(row[:k]) not in found
                found[tuple(row[:k])] = n
    assert found == plain([(r.tolist(), int(w)) for r, w in zip(runs, weight)], 7, 1) and many <= 2 * len(rows)


def test_seeds_keep_single_glyphs_and_the_largest(spark):
    rows = [(list("abab"), 2), (list("xyz"), 1)]
    own = seeds.seeds(spark.createDataFrame(rows, "run array<string>, n long"), most=4, size=2)
    assert own == {("a",): 4.0, ("b",): 4.0, ("x",): 1.0, ("y",): 1.0, ("z",): 1.0, ("a", "b"): 8.0, ("a", "b", "a", "b"): 8.0}
    assert seeds.seeds(spark.createDataFrame([], "run array<string>, n long")) == {}


def test_fewer_rows_than_substrings(spark):
    """What is shuffled: a row a branch, far below a row a substring."""
    rng = random.Random(0)
    rows = [("".join(rng.choice("abcdefgh") for _ in range(60)), 1) for _ in range(200)]
    runs = [(list(r), n) for r, n in rows]
    substrings = sum(len(r) * 16 - 120 for r, _ in runs)
    flat = np.concatenate([np.array([ord(c) - 96 for c in r]) for r, _ in rows])
    padded, owner = seeds.suffixes(flat, np.array([60] * 200), 16)
    sent = sum(len(own) for own, *_ in seeds.branches(padded, np.ones(len(padded), np.int64)))
    assert sent * 8 < substrings
    frame = spark.createDataFrame(runs, "run array<string>, n long")
    assert seeds.substring_counts(frame).agg(F.count(F.lit(1))).first()[0] == len(plain(runs, 16))
