"""Seed pieces of a Unigram model: the substrings of all runs with their counts, by suffix arrays.

A task sorts the suffixes of its runs, up to the longest piece, and finds how far neighbours
agree. Substrings that occur at the same places have the same count, so a task
sends one row for each branch of that order, with the lengths that it stands for,
instead of a row for every substring. Rows meet by the substrings' first
glyphs; there they are sorted once more, and what several tasks have is added up,
length by length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lexforge.operators.tokenizers import Piece
from lexforge.session import written

#: Suffixes that are sorted together; glyphs by which longer substrings meet, while shorter ones are few and go by themselves; branches for each bucket, about.
BLOCK, HEAD, BUCKET = 1 << 19, 3, 1 << 20
#: Pads a suffix; glyphs are numbered from 1.
_END = 0
_BRANCHES = "bucket int, text binary, least int, n long"


def _sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of padded rows, and how many glyphs each place in it shares with the one before (-1 for the first)."""
    order = np.lexsort(rows.T[::-1])
    own = rows[order]
    differ = own[1:] != own[:-1]
    same = np.where(differ.any(axis=1), np.argmax(differ, axis=1), rows.shape[1])
    lengths = (own != _END).sum(axis=1)
    return order, np.concatenate(([-1], np.minimum(same, lengths[1:])))[: len(rows)]


def branches(rows: np.ndarray, weight: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """From padded suffixes with weights: (a row that begins with each branch, its length, the least length of the same count, the count), for each length.

    A branch is a set of neighbours that agree in so many glyphs and not in one more,
    or the suffixes of exactly that length.
    """
    order, lcp = _sorted(rows)
    own, n, width = rows[order], weight[order], rows.shape[1]
    lengths = (own != _END).sum(axis=1)
    after = np.append(lcp[1:], -1)
    for length in range(width, 0, -1):
        start = np.flatnonzero((lcp < length))
        end = np.append(start[1:], len(own))
        keep = lengths[start] >= length
        start_kept, end_kept = start[keep], end[keep]
        if not len(start_kept):
            continue
        # within it: do all agree in one glyph more?
        inner = np.minimum.reduceat(np.where(lcp < length, width + 1, lcp), start)[keep]  # the first is a boundary
        deepest = np.minimum(inner, lengths[start_kept])
        is_branch = deepest == length
        counts = np.add.reduceat(n, start)[keep][is_branch]
        least = np.maximum(lcp[start_kept], after[end_kept - 1])[is_branch] + 1
        yield own[start_kept[is_branch]], length, np.maximum(least, 1), counts


def _numbered(batches: Iterator[pa.RecordBatch], ids: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(glyphs of all runs one after the other, lengths, weights) of some runs at a time."""
    for batch in batches:
        column = batch.column(0)
        flat, offsets = column.flatten(), np.concatenate(([0], np.cumsum(np.array(column.value_lengths().fill_null(0)))))
        glyph = np.array([ids[g] for g in flat.to_pylist()], np.int32)
        weight = batch.column(1).to_numpy()
        at = 0
        while at < len(weight):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
            yield glyph[offsets[at] : offsets[to]], np.diff(offsets[at : to + 1]), weight[at:to]
            at = to


def suffixes(glyph: np.ndarray, lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of runs, padded or cut to ``most`` glyphs, and the run of each."""
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(glyph))[:, None] + np.arange(most)
    return np.where(at < ends[:, None], glyph[np.minimum(at, max(0, len(glyph) - 1))], _END), np.repeat(np.arange(len(lengths)), lengths)


def _hashed(heads: np.ndarray, buckets: int) -> np.ndarray:
    h = np.zeros(len(heads), np.uint64)
    for column in heads.T:
        h = (h ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def substring_counts(runs: DataFrame, *, most: int = 16, least_count: int = 2) -> DataFrame:
    """(piece, n) of the substrings of 1 to ``most`` glyphs of (run, n), the runs' weights added up over all places, ``least_count`` at least; single glyphs in any case.

    Null and empty runs have none. A task holds ``BLOCK`` suffixes or a run; the alphabet
    is what the driver holds.
    """
    spark = runs.sparkSession
    alphabet = sorted(r[0] for r in runs.select(F.explode("run")).distinct().collect())
    ids = {g: i + 1 for i, g in enumerate(alphabet)}
    places = runs.agg(F.coalesce(F.sum(F.size("run")), F.lit(0))).first()[0] if alphabet else 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * places // BUCKET))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for glyph, lengths, weight in _numbered(batches, ids):
            if not len(glyph):
                continue
            rows, owner = suffixes(glyph, lengths, most)
            for own, length, least, counts in branches(rows, weight[owner]):
                # lengths up to HEAD, as substrings of their own; the others meet by their first HEAD glyphs
                parts = [(own, k, np.full(len(own), k), counts, least <= k) for k in range(1, min(HEAD, length) + 1)]
                if length > HEAD:
                    parts.append((own, length, np.maximum(least, HEAD + 1), counts, np.ones(len(own), bool)))
                for text, size, low, n, wanted in parts:
                    text, low, n = np.ascontiguousarray(text[wanted][:, :size]).astype("<i4"), low[wanted], n[wanted]
                    if len(text):
                        packed = pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer((np.arange(len(text) + 1) * 4 * size).astype(np.int32).tobytes()), pa.py_buffer(text.tobytes())])
                        yield pa.RecordBatch.from_arrays([pa.array(_hashed(text[:, :HEAD], buckets)), packed, pa.array(low, pa.int32()), pa.array(n, pa.int64())], ["bucket", "text", "least", "n"])

    def added(table: pa.Table) -> pa.Table:
        column = table.column("text").combine_chunks()
        sizes = pc.binary_length(column).to_numpy().astype(np.int64) // 4
        flat = np.frombuffer(b"".join(column.to_pylist()), "<i4")
        rows = np.full((len(sizes), most), _END, np.int32)
        rows[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        order, lcp = _sorted(rows)
        own, low, n, sizes = rows[order], table.column("least").to_numpy()[order], table.column("n").to_numpy()[order], sizes[order]
        pieces, counts = [], []
        for length in range(1, most + 1):
            start = np.flatnonzero(lcp < length)
            sums = np.add.reduceat(np.where((low <= length) & (length <= sizes), n, 0), start)
            want = (sums >= (1 if length == 1 else least_count)) & (sizes[start] >= length)
            pieces += [[alphabet[g - 1] for g in row] for row in own[start[want], :length].tolist()]
            counts.append(sums[want])
        return pa.table([pa.array(pieces, pa.list_(pa.string())), pa.array(np.concatenate(counts), pa.int64())], ["piece", "n"])

    rows = runs.select("run", F.col("n").cast("long")).where(F.size("run") > 0).mapInArrow(sent, _BRANCHES)
    met = rows.groupBy("bucket", "text", "least").agg(F.sum("n").alias("n"))
    return met.groupBy("bucket").applyInArrow(added, "piece array<string>, n long")


def chosen(runs: DataFrame, *, most: int = 16, size: int = 1_000_000) -> DataFrame:
    """(piece, n): single glyphs, and the ``size`` longer substrings of the largest count times length that occur twice; ties by the piece.

    The ranking is dealt out by ranges: whole ranges are taken, and only the one where ``size`` is reached is sorted.
    """
    counts = written(substring_counts(runs, most=most), "substrings")
    longer = counts.where(F.size("piece") > 1).withColumn("_weight", F.col("n") * F.size("piece"))
    if longer.count() > size:
        order = [F.col("_weight").desc(), F.col("piece")]
        longer = written(longer.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
        left, at = size, None
        for r in longer.groupBy("_range").agg(F.count(F.lit(1)).alias("many")).orderBy("_range").collect():  # a row a range
            at = r["_range"]
            if r["many"] > left:
                break
            left -= r["many"]
        longer = longer.where(F.col("_range") < at).unionByName(longer.where(F.col("_range") == at).orderBy(*order).limit(left))
    return counts.where(F.size("piece") == 1).unionByName(longer.select("piece", "n"))


def seeds(runs: DataFrame, *, most: int = 16, size: int = 1_000_000) -> dict[Piece, float]:
    """The :func:`chosen` pieces with their count times length."""
    return {tuple(r["piece"]): float(r["n"] * len(r["piece"])) for r in chosen(runs, most=most, size=size).collect()}
