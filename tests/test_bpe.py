"""BPE training with distributed words gives what the driver's loop gives, and artifacts keep its ids."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lexforge.operators import bpe, tokenizers
from lexforge.sources import artifacts


def table_of(spark, words, partitions=3):
    counts = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return spark.createDataFrame([(list(w), n) for w, n in counts.items()], "glyphs array<string>, n long").repartition(partitions)


def made_words(seed, n, letters):
    rng = random.Random(seed)
    parts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))) for _ in range(12)]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(n)]


@pytest.mark.parametrize("seed,letters,size,least", [(1, "ab", 24, 1), (2, "abcdefgh", 60, 2), (3, "aab", 24, 3), (4, "abc[]", 40, 2)])
def test_equals_the_drivers_loop(spark, seed, letters, size, least):
    table = table_of(spark, made_words(seed, 300, letters))
    own, other = bpe.train_bpe(table, size, min_frequency=least), tokenizers.train_bpe(table, size, min_frequency=least)
    assert (own.pieces, own.merges, own.log) == (other.pieces, other.merges, other.log)


def test_many_merges_of_words(spark):
    """512 merges of words of documents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    words = [w for r in docs.collect() for w in (r["text"] or "").split()]
    table = table_of(spark, words)
    size = len({c for w in words for c in w}) + 1 + 512
    own, other = bpe.train_bpe(table, size), tokenizers.train_bpe(table, size)
    assert len(own.merges) >= 512 and (own.pieces, own.merges, own.log) == (other.pieces, other.merges, other.log)


def test_continues_and_takes_brackets(spark):
    table = table_of(spark, ["[ab]ab", "[ab]", "abab", "aaaa", "b[ab]"])
    start = tokenizers.train_bpe(table, 6, min_frequency=1)
    for whole in (False, True):
        assert bpe.train_bpe(table, 12, min_frequency=1, start=start, merge_brackets=whole).log == tokenizers.train_bpe(table, 12, min_frequency=1, start=start, merge_brackets=whole).log
    assert bpe.train_bpe(table, 99, alphabet=frozenset("xyz")).pieces[:3] == [("[UNK]",), ("[",), ("]",)]
    empty = spark.createDataFrame([], "glyphs array<string>, n long")
    assert bpe.train_bpe(empty, 50).pieces == [("[UNK]",)]


def test_beyond_the_drivers_size(spark, monkeypatch):
    table = table_of(spark, made_words(5, 100, "abcd"))
    expected = tokenizers.train_bpe(table, 30)
    monkeypatch.setattr(tokenizers, "MOST_CHUNKS", 10)
    assert tokenizers.train_bpe(table, 30).log == expected.log


def test_repeats_of_one_token():
    for n in range(2, 9):
        ids, lengths, words, which = bpe.merged(np.zeros(n, np.int64), np.array([n]), np.array([0]), np.array([7]))
        assert ids.tolist() == [7] * (n // 2) + [0] * (n % 2) and lengths.tolist() == [len(ids)] and len(which) == n // 2
    # of two words: no pair across them
    ids, lengths, _, _ = bpe.merged(np.array([0, 1, 0, 1, 1]), np.array([1, 4]), np.array([1]), np.array([9]))  # the pair (0, 1)
    assert ids.tolist() == [0, 1, 9, 1] and lengths.tolist() == [1, 3]


def test_heads():
    pieces = [(c,) for c in "abcd"]
    ids = {p: i for i, p in enumerate(pieces)}
    pair = lambda a, b: a << 32 | b
    ranking = [(pair(0, 1), 9), (pair(0, 2), 8), (pair(3, 1), 7), (pair(1, 2), 6), (pair(3, 2), 5)]
    assert bpe.head(ranking, pieces, ids, 99) == ranking[:3]
    assert bpe.head(ranking, pieces, ids, 6) == ranking[:2]
    assert bpe.head([(pair(0, 0), 9), (pair(1, 2), 8)], pieces, ids, 99) == [(pair(0, 0), 9)]
    known = [*pieces, ("a", "b")]
    assert bpe.head(ranking, known, {p: i for i, p in enumerate(known)}, 99) == ranking[:1]


def test_artifacts_keep_ids_where_two_merges_make_a_piece(spark, tmp_path):
    named = [("[UNK]",), *[(c,) for c in "abcd"]]
    merges = [(("a",), ("b",)), (("b",), ("c",)), (("a", "b"), ("c",)), (("a",), ("b", "c")), (("c",), ("d",))]
    pieces = [*named, *dict.fromkeys(a + b for a, b in merges)]
    own = tokenizers.Tokenizer("bpe", pieces, merges=merges)
    artifacts.save_tokenizer(spark, own, f"file://{tmp_path}/t")
    again = artifacts.load_tokenizer(spark, f"file://{tmp_path}/t")
    assert (again.pieces, again.merges, again.ids) == (own.pieces, own.merges, own.ids)
    listed = artifacts.bpe_vocabulary(spark, (tmp_path / "t" / "tokenizer.json").read_text()).collect()
    assert [(r["token_id"], tuple(r["glyphs"])) for r in listed] == list(enumerate(pieces))


def test_counts_here_or_in_a_table(spark, monkeypatch):
    """Pairs' counts on the driver, in a table from the start, or moved to one on the way give one log."""
    rng = random.Random(9)
    rows = [(list("".join(rng.choice(["ab", "abc", "ca", "d", "aa", "cad"]) for _ in range(rng.randrange(1, 7)))), rng.randrange(1, 5)) for _ in range(80)]
    table = spark.createDataFrame(rows, "glyphs array<string>, n long").repartition(3)
    expected = tokenizers.train_bpe(table, 24).log
    for most in (1_000_000, 0, 12):
        monkeypatch.setattr(bpe, "PAIRS", most)
        assert bpe.train_bpe(table, 24).log == expected
