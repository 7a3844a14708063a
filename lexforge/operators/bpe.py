"""BPE training whose words stay distributed.

Words are packed in blocks, a row each: the ids of all words one after the other,
their lengths and weights. A round takes the most frequent pairs, applies the merges to all
blocks, and adds what the blocks say has changed to the counts of pairs. There are
at most as many pairs as pieces squared, whatever the texts; up to ``PAIRS`` the driver keeps
their counts, beyond they are a table, and what reaches it is the head of the ranking.

Which merges go together: the longest head of the ranking in which no token is the
first of one pair and the second of another. Such pairs share no occurrence, so none
changes another's count. A pair with a token that a merge makes, (x, ab) or (ab, y), is not more frequent than (x, a)
or (b, y), which come after the head, as they would have ended it; where they are
level, its ids are larger. So the next merges, one at a time, would have been the
same. A pair of a token with itself can leave a more frequent pair, and ends a
head; one that makes a piece which is there already adds to its counts, and goes alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexforge.operators.tokenizers import Piece, Tokenizer, runs
from lexforge.session import forget, written

#: Tokens of a block, pairs of a ranking's head, pairs whose counts the driver keeps (16 bytes each).
BLOCK, HEAD, PAIRS = 1 << 18, 512, 1_000_000
_SCHEMA = "ids binary, lengths binary, weights binary, pairs array<long>, changes array<long>, gained array<long>"
_HALF = np.int64(32)
_LOW = (1 << 32) - 1


def _pairs(ids: np.ndarray, lengths: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The neighbours in each word, and the word's weight for each."""
    inner = np.ones(len(ids), bool)
    inner[np.cumsum(lengths) - 1] = False
    at = np.flatnonzero(inner)
    return ids[at].astype(np.int64) << _HALF | ids[at + 1], np.repeat(weights, lengths)[at]


def merged(ids: np.ndarray, lengths: np.ndarray, pairs: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words after some merges, of which none touches another: (ids, lengths, words that changed, the merge of each place that was merged). ``pairs`` ascending."""
    if not len(ids):
        return ids, lengths, np.empty(0, np.int64), np.empty(0, np.int64)
    # most tokens are the first of no pair: only the others are looked up
    begins = np.zeros(max(int(ids.max()), int(pairs[-1] >> _HALF)) + 1, bool)
    begins[pairs >> _HALF] = True
    begun, ends = begins[ids], np.cumsum(lengths)
    begun[ends - 1] = False
    hit = np.flatnonzero(begun)
    own = ids[hit].astype(np.int64) << _HALF | ids[hit + 1]
    which = np.minimum(np.searchsorted(pairs, own), len(pairs) - 1)
    same = pairs[which] == own
    hit, which = hit[same], which[same]
    # a token beside itself more than once: every other place, from the left
    first = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
    every = (np.arange(len(hit)) - np.repeat(first, np.diff(np.append(first, len(hit))))) % 2 == 0
    hit, which = hit[every], which[every]
    words = np.searchsorted(ends, hit, side="right")
    out = ids.copy()
    out[hit] = made[which]
    return np.delete(out, hit + 1), lengths - np.bincount(words, minlength=len(lengths)), np.unique(words), which


def _changes(*sides: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of weights by pair, without those that are 0."""
    keys, at = np.unique(np.concatenate([s[0] for s in sides]), return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, at, np.concatenate([s[1] for s in sides]))
    return keys[sums != 0], sums[sums != 0]


def _row(ids: np.ndarray, lengths: np.ndarray, weights: np.ndarray, pairs: np.ndarray, changes: np.ndarray, gained: np.ndarray) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    fields = [pa.array([a.astype(t).tobytes()], pa.binary()) for a, t in ((ids, np.int32), (lengths, np.int32), (weights, np.int64))] + [pa.array([a.tolist()], longs) for a in (pairs, changes, gained)]
    return pa.RecordBatch.from_arrays(fields, ["ids", "lengths", "weights", "pairs", "changes", "gained"])


def _opened(table: DataFrame, ids: dict[Piece, int], merge_brackets: bool, start: Tokenizer | None) -> DataFrame:
    """Blocks of the words of a chunk table, with all their pairs as changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, lengths, weights = [], [], []

        def block() -> pa.RecordBatch:
            words = np.array(flat, np.int64), np.array(lengths, np.int64), np.array(weights, np.int64)
            return _row(*words, *_changes(_pairs(*words)), np.empty(0, np.int64))

        for batch in batches:
            for parts, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for own in runs(tuple(parts), merge_brackets):
                    word = [ids[p] for p in (start.segment(own) if start else [(g,) for g in own])]
                    if len(word) > 1:
                        flat += word
                        lengths.append(len(word))
                        weights.append(n)
                if len(flat) >= BLOCK:
                    yield block()
                    flat, lengths, weights = [], [], []
        if flat:
            yield block()

    return table.select("glyphs", F.col("n").cast("long")).mapInArrow(run, _SCHEMA)


def _applied(blocks: DataFrame, pairs: np.ndarray, made: np.ndarray) -> DataFrame:
    """The blocks after a round's merges; words of one token are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths, weights = (np.frombuffer(batch.column(i)[row].as_py(), t).astype(np.int64) for i, t in enumerate((np.int32, np.int32, np.int64)))
                after, shorter, words, which = merged(ids, lengths, pairs, made)
                gained = np.zeros(len(pairs), np.int64)
                if len(words):
                    changed = np.zeros(len(lengths), bool)
                    changed[words] = True
                    before, later = _pairs(ids[np.repeat(changed, lengths)], lengths[changed], weights[changed]), _pairs(after[np.repeat(changed, shorter)], shorter[changed], weights[changed])
                    told = _changes((before[0], -before[1]), later)
                    np.add.at(gained, which, np.repeat(weights, lengths - shorter))
                else:
                    told = np.empty(0, np.int64), np.empty(0, np.int64)
                stay = shorter > 1
                if stay.any() or len(words):
                    yield _row(after[np.repeat(stay, shorter)], shorter[stay], weights[stay], *told, gained)

    return blocks.select("ids", "lengths", "weights").mapInArrow(run, _SCHEMA)


def _told(blocks: DataFrame) -> DataFrame:
    """(pair, n): what has changed, and below 0 what each merge gained: -1 for the first."""
    zipped = F.transform(F.arrays_zip("pairs", "changes"), lambda x: F.struct(x["pairs"].alias("pair"), x["changes"].alias("n")))
    gained = F.transform("gained", lambda g, i: F.struct((-1 - i).cast("long").alias("pair"), g.alias("n")))
    return blocks.select(F.explode(F.concat(zipped, gained)).alias("x")).groupBy("x.pair").agg(F.sum("x.n").alias("n"))


class _Counts:
    """Counts of pairs: arrays here while they are few, else a table."""

    def __init__(self, blocks: DataFrame) -> None:
        self.spark, self.pairs, self.n = blocks.sparkSession, np.empty(0, np.int64), np.empty(0, np.int64)
        self.table: DataFrame | None = written(_told(blocks).where("pair >= 0 and n > 0"), "pairs")
        if self.table.count() <= PAIRS:
            self._take(self.table)
            forget(self.table)
            self.table = None

    def _take(self, changed: DataFrame) -> dict[int, int]:
        found = changed.toArrow()
        pair, n = found.column("pair").to_numpy(), found.column("n").to_numpy()
        self.pairs, self.n = _changes((self.pairs, self.n), (pair[pair >= 0], n[pair >= 0]))
        return {int(-1 - p): int(x) for p, x in zip(pair[pair < 0], n[pair < 0])}

    def add(self, blocks: DataFrame) -> dict[int, int]:
        """Adds a round's changes; what each merge of it gained."""
        if self.table is None:
            gained = self._take(_told(blocks))
            if len(self.pairs) > PAIRS:
                self.table = written(self.spark.createDataFrame(pa.table({"pair": self.pairs, "n": self.n})), "pairs")
                self.pairs = self.n = np.empty(0, np.int64)
            return gained
        told = written(_told(blocks), "changes")
        sums = told.where("pair >= 0").unionByName(self.table).groupBy("pair").agg(F.sum("n").alias("n")).where("n > 0")
        self.table, old = written(sums, "pairs"), self.table
        gained = {-1 - r["pair"]: r["n"] for r in told.where("pair < 0").collect()}
        forget(old, told)
        return gained

    def ranking(self, least: int) -> list[tuple[int, int]]:
        """The most frequent pairs with their counts, of equal ones the smaller first."""
        if self.table is not None:
            return [(r["pair"], r["n"]) for r in self.table.where(F.col("n") >= least).orderBy(F.col("n").desc(), "pair").limit(HEAD).collect()]
        best = np.lexsort((self.pairs, -self.n))[:HEAD]
        return [(int(p), int(n)) for p, n in zip(self.pairs[best], self.n[best]) if n >= least]


def head(ranking: list[tuple[int, int]], pieces: list[Piece], ids: dict[Piece, int], size: int) -> list[tuple[int, int]]:
    """The pairs, with their counts, that one round takes from the head of a ranking."""
    firsts, seconds, new, found = set(), set(), set(), []
    for pair, n in ranking:
        a, b = pair >> 32, pair & _LOW
        piece = pieces[a] + pieces[b]
        if a in seconds or b in firsts or found and (piece in ids or piece in new) or len(pieces) + len(new) >= size:
            break
        found.append((pair, n))
        if piece in ids or a == b:
            break
        firsts.add(a)
        seconds.add(b)
        new.add(piece)
    return found


def train_bpe(table: DataFrame, size: int, *, min_frequency: int = 2, merge_brackets: bool = False, alphabet: frozenset[str] | None = None, start: Tokenizer | None = None) -> Tokenizer:
    """The tokenizer that :func:`lexforge.operators.tokenizers.train_bpe` trains, from a (glyphs, n) table of any size.

    The same pieces, merges and log; ties go to the smaller pair by id. The driver
    holds the alphabet, the pieces, and ``PAIRS`` counts or the head of a ranking. Blocks
    are written each round, and those of the round before are deleted.
    """
    base = sorted({r[0] for r in table.select(F.explode("glyphs")).distinct().collect()} | set(alphabet or ()))
    pieces: list[Piece] = list(start.pieces) if start else [("[UNK]",), *[(g,) for g in base]]
    ids = {p: i for i, p in enumerate(pieces)}
    merges, log = list(start.merges) if start else [], []
    blocks = written(_opened(table, ids, merge_brackets, start), "words")
    counts = _Counts(blocks)
    while len(pieces) < size:
        taken = head(counts.ranking(max(1, min_frequency)), pieces, ids, size)
        if not taken:
            break
        made = []
        for pair, _ in taken:
            piece = pieces[pair >> 32] + pieces[pair & _LOW]
            made.append(ids.setdefault(piece, len(pieces)))
            if made[-1] == len(pieces):
                pieces.append(piece)
        order = np.argsort([p for p, _ in taken])
        blocks, old = written(_applied(blocks, np.array([p for p, _ in taken], np.int64)[order], np.array(made, np.int64)[order]), "words"), blocks
        forget(old)
        gained = counts.add(blocks)
        for i, ((pair, n), new) in enumerate(zip(taken, made)):
            a, b = pair >> 32, pair & _LOW
            merges.append((pieces[a], pieces[b]))
            times = gained.get(int(np.flatnonzero(order == i)[0]), 0)
            standing: Counter = Counter()
            for token, change in ((new, times), (a, -times), (b, -times)):
                standing[token] += change
            log.append({"step": len(merges), "pair": [a, b], "new_id": new, "new_token": "".join(pieces[new]), "candidate_freq": n, "standalone": [[t, d] for t, d in sorted(standing.items()) if d]})
    forget(blocks, counts.table)
    return Tokenizer("bpe", pieces, merges=merges, merge_brackets=merge_brackets, log=log)
