"""Removal of byte strings that an earlier document has, by a hash-compared suffix sort.

Where suffixes meet: of the anchors (strings of about half of ``least`` bytes) in a string
of ``least`` bytes the one with the smallest hash stands for it, the leftmost of equals. Equal strings
have equal anchors at equal places, so strings need to meet by anchor only, and
consecutive ones that share an anchor travel as one segment. First only the
anchors' hashes are exchanged; segments go on where an anchor is in two documents.

The sort: a task puts the segments of its anchors into one buffer with prefix sums
of a polynomial hash, by which any two substrings are compared at once. A binary
search over them finds how far two suffixes agree, and a mergesort that compares that
way orders the suffixes of each anchor and place. Neighbours in that order are then compared by their bytes, which
proves order and equality; where a hash has misled, the bytes are sorted. Suffixes that
agree for ``least`` bytes share the smallest id among them.

Documents are taken in chunks of some megabytes. A chunk sends each distinct anchor
and segment once, with its smallest id, so a passage that a third of all documents
has is an entry a chunk. An anchor that is in very many contexts, as at the ends of
such a passage, would still gather all of them; the strings around it are dealt out by
their own hashes.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexforge.llm.substring import FAN, _by_document, _by_target, _cut_bits, _gathered, _joined, _mixed, _PACKED, _powers, _slots, _target, _unpacked, _ANSWER, _ANSWER_NAMES, _ANSWERS
from lexforge.session import forget, release, written

#: Bytes of a chunk and of text for each slot, at most about; bytes that are hashed together; contexts of an anchor beyond which its strings are dealt out.
CHUNK, SLOT, BLOCK, HOT = 8 << 20, 16 << 20, 1 << 18, 512
#: The low bits of an anchor's hash say in how many places of a chunk it is, at least: 1, 2 (of two documents), 8 or 64.
_TIMES = np.array([1, 2, 8, 64])
_LOW = np.uint64((1 << 20) - 1)
_VALUES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Arrays of a chunk for a slot, or back, or (without a slot) for itself, one after the other and compressed.
_PACKETS = "chunk long, slot int, many int, size int, packed binary"
#: The place of an anchor's hash in a segment of a hot one, which is a string by itself.
_ITSELF = (1 << 16) - 1
_NAMES, _TYPES = [c.split()[0] for c in _PACKETS.split(", ")], [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]


def _packet(chunk: int, slot: int | None, many: int, *arrays: np.ndarray) -> tuple:
    raw = b"".join(x.tobytes() for x in arrays)
    return chunk, slot, many, len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, _TYPES)], _NAMES)


def _raw(row: dict) -> bytes:
    return pa.decompress(row["packed"], row["size"], codec="zstd", asbytes=True)


class Hashed:
    """A buffer of bytes, and the hash of any of its substrings from prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1, 0)
        self.data, self.sums = data, np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]

    def all(self, length: int) -> np.ndarray:
        """The hashes of every substring of a length."""
        n = max(0, len(self.data) - length + 1)
        return (self.sums[length:] - self.sums[:n]) * self.down[:n] if n else np.empty(0, np.uint64)

    def common(self, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
        """How many bytes, up to ``most``, two suffixes agree in, by binary search; both have that many."""
        low, high = np.zeros(len(i), np.int64), np.full(len(i), most)
        for _ in range(int(most).bit_length()):
            mid = (low + high + 1) >> 1
            same = self.of(i, mid) == self.of(j, mid)
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
        return low

    def before(self, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
        """-1, 0 or 1: whether the suffix at i is less than, equal to or greater than the one at j."""
        agree = self.common(i, j, most)
        more = agree < most
        out = np.zeros(len(i), np.int8)
        out[more] = np.where(self.data[i[more] + agree[more]] < self.data[j[more] + agree[more]], -1, 1)
        return out


def suffix_sort(text: Hashed, start: np.ndarray, first: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """The order of suffixes by their first ``most`` bytes within buckets; an element's bucket begins at ``first`` and has ``size`` elements.

    A mergesort from below, all merges of a level at once: an element's new place
    is its place in its own run, plus the number of elements of the other run
    that go before it, which a binary search finds.
    """
    order = np.arange(len(start))
    run = 1
    while run < size.max(initial=0):
        own = np.flatnonzero(size > run)
        base, place, end = first[own], own - first[own], size[own]
        pair = place // (2 * run) * (2 * run)
        is_left = place < pair + run
        begin = np.where(is_left, np.minimum(pair + run, end), pair)
        low, high = begin.copy(), np.where(is_left, np.minimum(pair + 2 * run, end), pair + run)
        least = np.where(is_left, 0, 1)  # of equals the left run's go first
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            goes = text.before(start[order[base[open_] + mid]], start[order[own[open_]]], most) < least[open_]
            low[open_], high[open_] = np.where(goes, mid + 1, low[open_]), np.where(goes, high[open_], mid)
            open_ = open_[low[open_] < high[open_]]
        merged = order.copy()
        merged[base + pair + (place - np.where(is_left, pair, pair + run)) + low - begin] = order[own]
        order, run = merged, 2 * run
    return order


def verified(text: Hashed, start: np.ndarray, first: np.ndarray, order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The order, proved by bytes or else made by them, and for each place in it whether its suffix equals the one before."""
    rows = text.data[start[order][:, None] + np.arange(most)]
    bucket = first[order]
    inner = bucket[1:] == bucket[:-1]
    differ = rows[1:] != rows[:-1]
    at = np.argmax(differ, axis=1)
    k = np.arange(len(at))
    if (inner & (rows[1:][k, at] < rows[:-1][k, at])).any():  # a hash has misled
        order = order[np.lexsort((*rows.T[::-1], bucket))]
        rows = text.data[start[order][:, None] + np.arange(most)]
        differ = rows[1:] != rows[:-1]
    return order, np.concatenate((np.zeros(min(1, len(order)), bool), inner & ~differ.any(axis=1)))


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        a, have = np.minimum(a[: len(a) - step], a[step:]), have + step
    return a


def anchor_length(least: int) -> int:
    return max(1, least // 2 - 1)


class Chunk:
    """The documents of a chunk, one after the other, in an order that doesn't depend on the order of rows."""

    def __init__(self, docs: pa.Table, least: int):
        docs = docs.take(pc.sort_indices(docs, [("row_key", "ascending"), ("doc_id", "ascending")])).combine_chunks()
        column = docs.column("data").combine_chunks()
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        self.docs, self.data = docs, np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        self.bounds = offsets - offsets[0]
        ids = docs.column("doc_id")
        self.ids = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
        self.least, self.size = least, anchor_length(least)
        self.valid = np.ones(len(self.data), bool)
        for end in self.bounds[1:].tolist():
            self.valid[max(0, end - least + 1) : end] = False

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, side="right") - 1

    def segments(self) -> Iterator[tuple]:
        """(hashed block, where it begins, start in it, strings, place of the anchor, its hash) of the runs of strings with one anchor, block by block."""
        for at in range(0, max(0, len(self.data) - self.least + 1), BLOCK):
            text = Hashed(self.data[at : at + BLOCK + self.least - 1])
            hashes = _mixed(text.all(self.size))
            smallest = _sliding_min((hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64), self.least - self.size + 1)
            anchor = (smallest & _LOW).astype(np.int64)
            ok = self.valid[at : at + len(anchor)]
            new = ok.copy()
            new[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1])
            ends = np.flatnonzero(new | ~ok)
            many = np.diff(np.append(ends, len(anchor)))
            begins = new[ends]
            start, many = ends[begins], many[begins]
            yield text, at, start, many, anchor[start] - start, hashes[anchor[start]]


def anchors(docs: pa.Table, least: int) -> np.ndarray:
    """The distinct anchors of a chunk, ascending; the two lowest bits say how often (see ``_TIMES``)."""
    chunk = Chunk(docs, least)
    keys, owner = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for _, at, start, _, _, key in chunk.segments():
        keys.append(key & ~np.uint64(3))
        owner.append(chunk.owner(at + start))
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    if not len(keys):
        return keys
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    many = np.diff(np.append(first, len(keys)))
    two = np.minimum.reduceat(owner, first) < np.maximum.reduceat(owner, first)
    return keys[first] | np.where(two, 1 + (many >= _TIMES[2]) + (many >= _TIMES[3]), 0).astype(np.uint64)


def _shared(table: pa.Table, slots: int, per: int) -> pa.Table:
    """For each chunk with an anchor in a slot that two documents have: two bits for each of its anchors there, shared and hot."""
    keys, counts, values = _joined(table, "row_keys", np.int64), _joined(table, "counts", np.uint32).astype(np.int64), _joined(table, "hashes", np.uint32)
    owner = np.repeat(np.arange(len(keys)), counts)
    order = np.argsort(values >> np.uint32(2), kind="stable")
    own, times = values[order] >> np.uint32(2), _TIMES[values[order] & np.uint32(3)]
    new = np.concatenate(([True], own[1:] != own[:-1]))
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    sums = np.add.reduceat(times, first)
    bits = np.zeros((len(values), 2), bool)
    bits[order, 0], bits[order, 1] = (sums >= 2)[group], (sums >= HOT)[group]  # a chunk has an anchor once, so 2 is two chunks, or two documents of one
    ends = np.cumsum(counts)
    which = np.flatnonzero(np.bincount(owner[bits[:, 0]], minlength=len(keys)))
    packed = [np.packbits(bits[ends[k] - counts[k] : ends[k]]).tobytes() for k in which.tolist()]
    slot = np.full(len(which), table.column("slot")[0].as_py())
    return pa.table(_by_target(keys[which], slot, 2 * counts[which], packed, _target(keys[which], slots, per)), _ANSWER_NAMES)


def _ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of some ranges, one range after the other."""
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - length), length)


def _alike(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether data[a : a + length] equals data[b : b + length], by bytes."""
    out = np.empty(len(a), bool)
    for k in range(0, len(a), 1 << 15):
        own = slice(k, k + (1 << 15))
        at = np.arange(int(length[own].max()))
        inside = at < length[own][:, None]
        out[own] = ((data[np.where(inside, a[own][:, None] + at, 0)] == data[np.where(inside, b[own][:, None] + at, 0)])).all(axis=1)
    return out


def distinct(data: np.ndarray, columns: list[np.ndarray], start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by ``columns`` (hashes of the content among them), and for each place in it the number of its segment, equal ones having one."""
    order = np.lexsort(columns[::-1])
    same = np.ones(max(0, len(order) - 1), bool)
    for c in (*columns, length):
        own = c[order]
        same &= own[1:] == own[:-1]
    at = np.flatnonzero(same)
    same[at] = _alike(data, start[order[at]], start[order[at + 1]], length[order[at]])
    return order, np.cumsum(np.concatenate((np.zeros(min(1, len(order)), bool), ~same)))


def chosen(chunk: Chunk, slots: int, answers: list[tuple[int, bytes]]) -> tuple[np.ndarray, ...]:
    """(start, strings, place, key, hash of the content) of the segments of a chunk with a shared anchor; around a hot one each string is a segment with its own hash as key."""
    known = anchors(chunk.docs, chunk.least)
    slot = _slots(known, slots)
    by_slot = np.argsort(slot, kind="stable")
    edges = np.searchsorted(slot[by_slot], np.array([[s, s + 1] for s, _ in answers], np.int64).reshape(-1, 2))
    bits = np.zeros((len(known), 2), bool)
    for (low, high), (_, packed) in zip(edges.tolist(), answers):
        bits[by_slot[low:high]] = np.unpackbits(np.frombuffer(packed, np.uint8), count=2 * (high - low)).astype(bool).reshape(-1, 2)
    found: list[tuple] = []
    plain = known & ~np.uint64(3)
    for text, at, start, many, place, key in chunk.segments():
        own = np.searchsorted(plain, key & ~np.uint64(3))
        for hot in (False, True):
            of = np.flatnonzero(bits[own, 0] & (bits[own, 1] == hot))
            s, n, p, h = start[of], many[of], place[of], key[of]
            if hot:
                s = _ragged(s, n)
                n, p, h = np.ones(len(s), np.int64), np.full(len(s), _ITSELF), _mixed(text.of(s, chunk.least))
            found.append((s + at, n, p, h, text.of(s, n + chunk.least - 1)))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))


def sent(name: int, chunk: Chunk, slots: int, answers: list[tuple[int, bytes]]) -> pa.Table:
    """What a chunk sends to the slots: its distinct segments, each with the smallest id; and for itself, where they are."""
    start, many, place, key, content = chosen(chunk, slots, answers)
    length = many + chunk.least - 1
    order, group = distinct(chunk.data, [key, content, place, many], start, length)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(group)), bool), group[1:] != group[:-1])))
    least = np.minimum.reduceat(chunk.ids[chunk.owner(start[order])], first) if len(first) else np.empty(0, np.int64)
    slot = _slots(key[order[first]], slots)
    by_slot = np.argsort(slot, kind="stable")
    number = np.empty(len(first), np.uint32)
    number[by_slot] = np.arange(len(first))
    entry = np.empty(len(order), np.uint32)
    entry[order] = number[group]
    rows = [_packet(name, None, len(start), np.diff(start, prepend=0), entry)] if len(start) else []
    cuts = np.flatnonzero(np.diff(slot[by_slot])) + 1
    for own in np.split(by_slot, cuts) if len(by_slot) else []:
        at = order[first[own]]
        rows.append(_packet(name, int(slot[own[0]]), len(at), least[own], many[at].astype(np.uint16), place[at].astype(np.uint16), chunk.data[_ragged(start[at], length[at])]))
    return _table(rows)


def unpacked(row: dict, least: int) -> tuple[np.ndarray, ...]:
    """(ids, strings, place, key, text) of what a chunk sent to a slot; the keys are made from the text."""
    raw, n = _raw(row), row["many"]
    ids, text = np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.uint8, offset=12 * n)
    many, place = (np.frombuffer(raw, np.uint16, n, k * n).astype(np.int64) for k in (8, 10))
    length = many + least - 1
    start = np.cumsum(length) - length
    hashed, alone = Hashed(text), place == _ITSELF
    own = hashed.of(start + np.where(alone, 0, place), np.where(alone, least, anchor_length(least)))
    return ids, many, np.where(alone, 0, place), _mixed(own), text


def smallest(data: np.ndarray, start: np.ndarray, many: np.ndarray, place: np.ndarray, key: np.ndarray, ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each string of some segments the smallest id that has it: (segment's number for each, where its strings begin, the ids)."""
    text, length = Hashed(data), many + least - 1
    order, group = distinct(data, [key, text.of(start, length), place, many], start, length)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    own, low = order[first], np.minimum.reduceat(ids[order], first)
    # the suffixes of distinct segments, by anchor and by how far before it they begin
    n = many[own]
    begins = np.cumsum(n) - n
    suffix = _ragged(start[own], n)
    ahead = np.repeat(place[own] + start[own], n) - suffix
    anchor = np.repeat(np.cumsum(np.concatenate(([False], key[own][1:] != key[own][:-1]))), n)
    bucket = anchor * (least + 1) + ahead
    by_bucket = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], np.diff(bucket[by_bucket]) != 0)))
    sizes = np.diff(np.append(edge, len(bucket)))
    out = np.repeat(low, n)
    several = np.repeat(sizes > 1, sizes)
    at = by_bucket[several]  # a suffix alone in its bucket has no equal
    if len(at):
        sizes = sizes[sizes > 1]
        head = np.repeat(np.cumsum(sizes) - sizes, sizes)
        ranked, equal = verified(text, suffix[at], head, suffix_sort(text, suffix[at], head, np.repeat(sizes, sizes), least), least)
        at = at[ranked]
        run = np.flatnonzero(~equal)
        out[at] = np.repeat(np.minimum.reduceat(out[at], run), np.diff(np.append(run, len(at))))
    number = np.empty(len(order), np.int64)
    number[order] = group
    return number, begins, out


def decided(table: pa.Table, least: int) -> pa.Table:
    """The verdicts of a slot: for each segment of each chunk the smallest ids of its strings, as runs of equal ones."""
    ids, many, place, key, text = (np.concatenate(c) for c in zip(*(unpacked(row, least) for row in table.select(["many", "size", "packed"]).to_pylist())))
    length = many + least - 1
    start = np.cumsum(length) - length
    order = np.argsort(key, kind="stable")
    # blocks of whole anchors
    upto = np.cumsum(length[order])
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    block = np.maximum.accumulate(np.where(new, (upto - length[order]) // (2 * BLOCK), 0))
    runs, runs_of, low = np.zeros(len(key), np.int64), [], []
    for own in np.split(order, np.flatnonzero(np.diff(block)) + 1):
        data = text[_ragged(start[own], length[own])]
        number, begins, found = smallest(data, np.cumsum(length[own]) - length[own], many[own], place[own], key[own], ids[own], least)
        change = np.concatenate(([True], found[1:] != found[:-1]))
        change[begins] = True
        at = np.flatnonzero(change)
        in_each = np.add.reduceat(change.astype(np.int64), begins)
        from_each = np.cumsum(in_each) - in_each
        of = _ragged(from_each[number], in_each[number])
        runs[own] = in_each[number]
        runs_of.append(np.diff(np.append(at, len(found)))[of])
        low.append(found[at][of])
    # back to the order of the rows
    in_order = np.cumsum(runs[order]) - runs[order]
    begin = np.empty(len(key), np.int64)
    begin[order] = in_order
    back = _ragged(begin, runs)
    lengths, low = np.concatenate(runs_of)[back].astype(np.uint16), np.concatenate(low)[back]
    counts = table.column("many").to_numpy()
    ends, run_ends = np.cumsum(counts), np.concatenate(([0], np.cumsum(runs)))
    rows = []
    for e, c, chunk, slot in zip(ends.tolist(), counts.tolist(), table.column("chunk").to_pylist(), table.column("slot").to_pylist()):
        a, b = run_ends[e - c], run_ends[e]
        rows.append(_packet(chunk, slot, c, low[a:b], lengths[a:b], runs[e - c : e].astype(np.uint16)))
    return _table(rows)


def cut(chunk: Chunk, told: pa.Table) -> pa.Table:
    """The documents of a chunk without what is to go."""
    gone = np.zeros(len(chunk.data) + 1, np.int32)
    rows = sorted(told.to_pylist(), key=lambda row: -1 if row["slot"] is None else row["slot"])
    if len(rows) > 1:
        raw, n = _raw(rows[0]), rows[0]["many"]  # the chunk's own
        start, entry = np.cumsum(np.frombuffer(raw, np.int64, n)), np.frombuffer(raw, np.uint32, offset=8 * n).astype(np.int64)
        found: list[tuple] = []
        for row in rows[1:]:
            raw, n = _raw(row), row["many"]
            total = (row["size"] - 2 * n) // 10
            found.append((np.frombuffer(raw, np.int64, total), np.frombuffer(raw, np.uint16, total, 8 * total), np.frombuffer(raw, np.uint16, offset=10 * total)))
        low, lengths, runs = (np.concatenate(c).astype(np.int64) for c in zip(*found))
        begin = np.cumsum(runs) - runs
        ahead = np.cumsum(lengths) - lengths
        ahead -= np.repeat(ahead[begin], runs)
        each = runs[entry]
        of = _ragged(begin[entry], each)
        at = np.repeat(start, each) + ahead[of]
        bad = low[of] < np.repeat(chunk.ids[chunk.owner(start)], each)
        np.add.at(gone, at[bad], 1)
        np.add.at(gone, at[bad] + lengths[of][bad] + chunk.least - 1, -1)
    out = np.cumsum(gone[:-1]) > 0
    kept, spans, removed = [], [], []
    for a, b in zip(chunk.bounds[:-1].tolist(), chunk.bounds[1:].tolist()):
        own = out[a:b]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8)))
        spans.append([{"start": s, "length": e - s} for s, e in edges.reshape(-1, 2).tolist()])
        removed.append(int(own.sum()))
        kept.append(chunk.data[a:b][~own].tobytes() if len(edges) else chunk.data[a:b].tobytes())
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    return pa.table([chunk.docs.column("doc_id"), pa.array(np.diff(chunk.bounds)), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def _done(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that nothing will read any more, and lets Spark delete the shuffles before them: a first collection frees the plans, a second finds what only they held."""
    forget(*tables)
    for pause in (0.5, 0):
        release(spark)
        time.sleep(pause)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 50) -> DataFrame:
    """For each row: doc_id, n_bytes, n_removed, spans (start and length of what goes, in bytes) and kept, the bytes left.

    A byte of a text's UTF-8 goes if it lies in a string of ``least`` bytes that also
    starts in a document with a smaller id. All strings are judged on the input.
    A null text is empty. Rows with the same id are one document's: they don't
    repeat each other. A null id is larger than any other. Texts of any length are
    read whole, shorter ones than ``least`` stay. An empty table gives an empty
    result; other columns aren't read.
    """
    if not 4 <= least <= 1 << 15:
        raise ValueError("least is a number of bytes from 4 to 32768")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(id_col).cast("long").alias("doc_id"), text.alias("data"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks, slots = max(partitions, -(-n_bytes // CHUNK)), max(partitions, -(-n_bytes // SLOT))
    per = -(-slots // FAN)
    long = rows.where(F.length("data") >= least).withColumn("chunk", F.pmod(F.xxhash64("row_key"), F.lit(chunks)))

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        of = lambda hashes: _slots(hashes, slots) // np.uint32(per)
        found = list(_gathered(iter([(key[0].as_py(), 0, anchors(table, least))]), of, "<u4" if per == 1 else "<u8"))
        return pa.Table.from_batches(found) if found else pa.schema([("slot", pa.int32()), *((c, pa.binary()) for c in ("row_keys", "ids", "counts", "hashes"))]).empty_table()

    hashes = long.groupBy("chunk").applyInArrow(packed, _PACKED)
    if per > 1:
        fine = lambda h: _slots(h, slots)
        hashes = hashes.repartition("slot").mapInArrow(lambda b: _gathered(_unpacked(b, np.dtype("<u8")), fine, "<u4"), _PACKED)
    answers = hashes.groupBy("slot").applyInArrow(lambda t: _shared(t, slots, per), _ANSWERS)
    if per > 1:
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, slot, counts, bits = _cut_bits(batch)
                yield pa.RecordBatch.from_arrays(_by_target(keys, slot, counts, bits, _target(keys, slots)), _ANSWER_NAMES)

        answers = answers.repartition("target").mapInArrow(deal, _ANSWERS)
    shared = written(answers.groupBy("target").applyInArrow(lambda t: _by_document(t, "anchor"), _ANSWER.format("anchor")), "anchors")
    _done(spark)

    def segments(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        found = list(zip(told.column("anchor_slots")[0].as_py(), told.column("anchor_bits")[0].as_py())) if table.num_rows and told.num_rows else []
        if not found:
            return _table([])
        return sent(key[0].as_py(), Chunk(table, least), slots, found)

    met = written(long.groupBy("chunk").cogroup(shared.groupBy("own")).applyInArrow(segments, _PACKETS), "segments")
    _done(spark, shared)
    verdicts = met.where("slot is not null").groupBy("slot").applyInArrow(lambda t: decided(t, least), _PACKETS)
    told = written(verdicts.union(met.where("slot is null")), "verdicts")
    _done(spark, met)
    done = long.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(lambda table, t: cut(Chunk(table, least), t), "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, length: long>>, kept binary")
    short = rows.where(F.length("data") < least).select("doc_id", F.length("data").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.expr("cast(array() as array<struct<start: long, length: long>>)").alias("spans"), F.col("data").alias("kept"))
    return done.union(short)
