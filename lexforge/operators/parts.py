"""Which parts of pieces may be pieces themselves: a Bloom filter over rolling hashes, looked up in Arrow batches.

A filter has 2^28 bits (32 MB), however large the vocabulary: the driver and each Python
worker have that and no pieces. What it lets through is looked up exactly by the caller.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lexforge.functions.batches import MOST

#: Bits of a filter, as a power of two, and its probes.
BITS, PROBES = 28, 2
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse among 64-bit numbers
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


class _Rolling:
    """Hashes of the parts of some glyph arrays: sums of each glyph's number times a power of its place, moved to place 0."""

    def __init__(self, rows: pa.ListArray, salts: pa.Array) -> None:
        self.counts = rows.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        told = pc.dictionary_encode(rows.flatten(), null_encoding="encode")
        numbers = np.array([int.from_bytes(hashlib.blake2b(repr(g).encode(), digest_size=8).digest(), "big") for g in told.dictionary.to_pylist()], np.uint64)
        own = numbers[told.indices.to_numpy(zero_copy_only=False)] if len(numbers) else np.zeros(0, np.uint64)
        power = np.full(len(own) + 1, _BASE, np.uint64)
        power[0], self.back = 1, np.full(len(own) + 1, _INVERSE, np.uint64)
        self.back[0] = 1
        power, self.back = np.cumprod(power, dtype=np.uint64), np.cumprod(self.back, dtype=np.uint64)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own * power[:-1], dtype=np.uint64)))
        self.salts = _mixed(salts.fill_null(0).to_numpy().astype(np.int64).view(np.uint64))

    def of(self, row: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return _mixed((self.sums[start + size] - self.sums[start]) * self.back[start] ^ self.salts[row])


def _places(h: np.ndarray) -> list[np.ndarray]:
    """The bits of a hash."""
    return [(h >> np.uint64(k * 32) & np.uint64((1 << BITS) - 1)).astype(np.int64) for k in range(PROBES)]


def _slices(rows: pa.ListArray) -> Iterator[slice]:
    """Parts of a batch of up to ``MOST`` glyphs, or of one row."""
    edges = rows.offsets.to_numpy().astype(np.int64)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + MOST, side="right")) - 1)
        yield slice(at, to)
        at = to


def likely(pieces: DataFrame, by: list[str]) -> Callable[[Column], Column]:
    """From (by, len, piece), distinct: a function of a glyph array that tells which of its proper parts may be in the vocabulary of the same ``by``.

    A part is its length << 32 | its place. Single glyphs are told only at either end. No part
    that is in the vocabulary is left out.
    """
    salt = F.xxhash64(*by) if by else F.lit(0).cast("long")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _Rolling(batch.column("piece"), batch.column("salt"))
            row = np.flatnonzero(own.counts)
            bits = np.concatenate(_places(own.of(row, own.first[row], own.counts[row])))
            yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array(np.left_shift(np.int64(1), bits & 63))], ["word", "bits"])

    sent = pieces.select("piece", salt.alias("salt")).mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (BITS - 6), np.int64)
    table[sent.column("word").to_numpy()] = sent.column("bits").to_numpy()
    del sent
    spark = pieces.sparkSession
    lengths = sorted(r["len"] for r in pieces.select("len").distinct().collect())
    held = spark.sparkContext.broadcast((table, lengths))

    @F.arrow_udf("array<long>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        bits, sizes = held.value
        for rows, salts in batches:
            for part in _slices(rows):
                yield _found(bits, sizes, rows[part], salts[part])

    return lambda piece: run(piece, salt)


def _found(bits: np.ndarray, sizes: list[int], rows: pa.ListArray, salts: pa.Array) -> pa.Array:
    own = _Rolling(rows, salts)
    owners, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    longest = own.counts.max(initial=0)
    for size in sizes:
        if size >= longest:
            break
        longer = np.flatnonzero(own.counts > size)
        if size == 1:
            row, at = np.repeat(longer, 2), np.stack((np.zeros(len(longer), np.int64), own.counts[longer] - 1), 1).ravel()
        else:
            many = own.counts[longer] - size + 1
            row = np.repeat(longer, many)
            at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        kept = np.ones(len(row), bool)
        for place in _places(own.of(row, own.first[row] + at, size)):
            kept &= (bits[place >> 6] >> (place & 63) & 1).astype(bool)
        owners.append(row[kept])
        parts.append(at[kept] | np.int64(size) << 32)
    row, part = np.concatenate(owners), np.concatenate(parts)
    order = np.argsort(row, kind="stable")
    edges = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(rows)))))
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(part[order]))
