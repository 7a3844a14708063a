"""The E-step of a Unigram model over arrays: a run's lattice is made once, as the numbers of the pieces that start at each glyph.

A run of n glyphs has n times ``most`` places; place (i, k - 1) has the number of the piece of k glyphs
that starts at glyph i, or -1. A step sends scores by number, and gets sums by number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexforge.functions.batches import parts

#: A unit of what is summed: whole numbers, so that sums are the same in any order.
UNIT = 1 << 24


def rows_of(pieces: pa.ListArray, ids: dict[str, int], most: int) -> np.ndarray:
    """Pieces as rows of glyph numbers (from 1), padded with 0."""
    sizes = pieces.value_lengths().to_numpy().astype(np.int64)
    glyphs = pieces.flatten().dictionary_encode()
    names = np.array([ids[g] for g in glyphs.dictionary.to_pylist()], np.int32)
    rows = np.zeros((len(sizes), most), np.int32)
    rows[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = names[glyphs.indices.to_numpy()]
    return rows


def _hashes(rows: np.ndarray, salt: int) -> Iterator[np.ndarray]:
    """The hash of the first 1, 2, ... glyphs of each row."""
    h = np.full(len(rows), salt, np.uint64)
    for column in rows.T:
        h = (h ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        yield h


class Numbers:
    """Finds the numbers of pieces, the rows of an array, by hash; what is found is compared, so a number is never wrong."""

    def __init__(self, rows: np.ndarray) -> None:
        lengths, salt = (rows > 0).sum(axis=1), 0
        while True:
            own = np.zeros(len(rows), np.uint64)
            for k, h in enumerate(_hashes(rows, salt), 1):
                own[lengths == k] = h[lengths == k]
            order = np.argsort(own, kind="stable")
            if not (np.diff(own[order]) == 0).any():
                break
            salt += 1
        self.rows, self.salt, self.order, self.hashes = rows, salt, order.astype(np.int32), own[order]

    def of(self, glyphs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The places of some runs, one after the other; glyphs that no piece has are 0."""
        most = self.rows.shape[1]
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(glyphs))
        padded = np.concatenate((glyphs, np.zeros(most, glyphs.dtype)))
        seen = np.stack([np.where(left > k, padded[k : k + len(glyphs)], 0) for k in range(most)], axis=1)
        places = np.full((len(glyphs), most), -1, np.int32)
        for k, h in enumerate(_hashes(seen, self.salt)):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = np.flatnonzero((self.hashes[at] == h) & (left > k))
            number = self.order[at[hit]]
            same = (self.rows[number, : k + 1] == seen[hit, : k + 1]).all(axis=1)
            if k + 1 < most:
                same &= self.rows[number, k + 1] == 0
            places[hit[same], k] = number[same]
        return places


def lattices(work: DataFrame, numbers: Numbers, ids: dict[str, int]) -> DataFrame:
    """(n, places) of each run of (run, n)."""
    sent = work.sparkSession.sparkContext.broadcast((numbers, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = sent.value
        most = own.rows.shape[1]
        for batch in batches:
            at = 0
            for some in parts(batch.column(0)):
                glyphs = some.flatten().dictionary_encode()
                names = np.array([known.get(g, 0) for g in glyphs.dictionary.to_pylist()], np.int32)
                lengths = some.value_lengths().to_numpy().astype(np.int64)
                places = own.of(names[glyphs.indices.to_numpy()], lengths)
                edges = np.concatenate(([0], np.cumsum(lengths * most))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, len(some)), pa.ListArray.from_arrays(pa.array(edges), pa.array(places.ravel()))], ["n", "places"])
                at += len(some)

    return work.select("run", F.col("n").cast("long")).mapInArrow(run, "n long, places array<int>")


def _log_sums(ways: np.ndarray) -> np.ndarray:
    top = ways.max(axis=1)
    low = np.where(np.isneginf(top), 0.0, top)
    with np.errstate(divide="ignore"):
        return low + np.log(np.exp(ways - low[:, None]).sum(axis=1))


def expectations(places: np.ndarray, n: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, expected counts in units) over all segmentations of runs of one length; places: (run, glyph, length). Numbers repeat. ``scores`` ends with that of no piece."""
    size, length, most = places.shape
    s = scores[places]
    forward, backward = np.full((size, length + 1), -np.inf), np.full((size, length + 1), -np.inf)
    forward[:, 0] = backward[:, length] = 0.0
    for end in range(1, length + 1):
        k = np.arange(1, min(most, end) + 1)
        forward[:, end] = _log_sums(forward[:, end - k] + s[:, end - k, k - 1])
    total = forward[:, length]
    whole = np.isfinite(total)
    numbers, found = [], []
    for at in range(length - 1, -1, -1):
        k = min(most, length - at)
        ways = s[:, at, :k] + backward[:, at + 1 : at + 1 + k]
        backward[:, at] = _log_sums(ways)
        share = np.exp(ways[whole] + (forward[whole, at] - total[whole])[:, None])
        hit = share > 0
        numbers.append(places[whole, at, :k][hit])
        found.append(np.rint(share * (n[whole] * float(UNIT))[:, None])[hit])
    return np.concatenate(numbers), np.concatenate(found)


def expected(built: DataFrame, scores: np.ndarray, most: int) -> np.ndarray:
    """Each piece's expected count over all runs."""
    sent = built.sparkSession.sparkContext.broadcast(np.append(scores, -np.inf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        sums = np.zeros(len(own), np.int64)
        for batch in batches:
            weights, at = batch.column(0).to_numpy(), 0
            for some in parts(batch.column(1), 1 << 22):
                n = weights[at : at + len(some)]
                at += len(some)
                flat = some.flatten().to_numpy().reshape(-1, most)
                lengths = some.value_lengths().to_numpy().astype(np.int64) // most
                starts = np.cumsum(lengths) - lengths
                for length in np.unique(lengths):
                    which = np.flatnonzero(lengths == length)
                    numbers, found = expectations(flat[starts[which][:, None] + np.arange(length)], n[which], own)
                    np.add.at(sums, numbers, found.astype(np.int64))
        hit = np.flatnonzero(sums)
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(sums[hit])], ["number", "e"])

    rows = built.mapInArrow(run, "number int, e long").groupBy("number").agg((F.sum(F.col("e").cast("decimal(38,0)")) / UNIT).cast("double").alias("e")).toArrow()
    sent.unpersist()
    found = np.zeros(len(scores))
    found[rows.column("number").to_numpy()] = rows.column("e").to_numpy()
    return found
