"""Removal of passages that an earlier document has, by fixed-block anchors.

Index: every document's non-overlapping blocks of half a ``window`` of words. Probe:
every rolling window of as many words. A passage of ``window`` words contains a
whole block wherever it starts, so each repeated passage has an anchor: a
rolling window equal to an indexed block of another document.

Extension: the windows of ``window`` words that contain an anchor are compared
in full (by 96 bits of two independent hashes of their word sequences) with those of
all other documents, which gives, as a union of overlapping windows, the maximal
exact repeats of at least ``window`` words. For each sequence only the smallest id
that has it is kept, never a pair.

Hot windows: a passage in a third of all documents would put an entry for each of
them into one slot. Windows that are frequent in a sample of documents are summed
up by the tasks that meet them, to one row a task, and what becomes of them is sent
to all tasks. The sample decides on the way only; a window that it misses goes the
way of the others, with the same result.

Hashes travel packed: a row holds what one task has for one slot of the hash
space, and the answer for a document is one bit for each of its hashes there.
Answers travel packed as well, one row from a slot to each slot of the document
keys, where they become one row a document. The slots grow in number with the
input, so what a task holds doesn't; beyond ``FAN`` of them rows go to groups of
slots first and are dealt out there, as rows for single slots would be short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lexforge.llm.batches import small
from lexforge.session import release, written

#: Characters of input for each slot, at most about; windows gathered before they are dealt out.
SLOT_CHARS, HELD = 16 << 20, 1 << 20
#: Documents of the sample that hot windows are looked for in, the share of them that a hot window is in (and the fewest), and hot windows that are sent to the tasks, at most.
SAMPLE, SHARE, FEWEST, MOST = 20_000, 1 / 256, 16, 1 << 17
#: Slots that one step deals out to, at most.
FAN = 4096
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_POWERS = {k: [np.ones(1, np.uint64), np.ones(1, np.uint64)] for k in range(2)}
#: A window of full length, by two hashes; a slot keeps 96 bits of them.
WIDE, KEPT = np.dtype([("a", "<u8"), ("b", "<u8")]), np.dtype([("a", "<u8"), ("b", "<u4")])


def _powers(n: int, which: int) -> list[np.ndarray]:
    """The powers of a base and of its inverse, modulo 2 ** 64, up to n of them; grown as needed."""
    own = _POWERS[which]
    if len(own[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASES[which], pow(_BASES[which], -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            own[k] = np.cumprod(steps, dtype=np.uint64)
    return own


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of anything but ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def rolling(own: np.ndarray, block: int, which: int = 0) -> np.ndarray:
    """A hash of each ``block`` consecutive words, from the words' own; there are two."""
    n = len(own)
    if n < block:
        return np.empty(0, np.uint64)
    up, down = _powers(n, which)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(own * up[:n], out=sums[1:])
    return _mixed((sums[block:] - sums[:-block]) * down[: n - block + 1])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def longer(own: np.ndarray, block: int, window: int) -> np.ndarray:
    """From the words' hashes, both hashes of each ``window`` words, each of two blocks, which may overlap."""
    n = max(0, len(own) - window + 1)
    out = np.empty(n, WIDE)
    for which, name in enumerate(("a", "b")):
        hashes = rolling(own, block, which)
        if n:
            out[name] = _mixed(hashes[:n] * np.uint64(3) + hashes[window - block :] * np.uint64(0xC2B2AE3D27D4EB4F))
    return out


def _slots(hashes: np.ndarray, slots: int) -> np.ndarray:
    hashes = hashes["a"] if hashes.dtype.names else hashes
    return ((hashes >> np.uint64(40)) % np.uint64(slots)).astype(np.uint32)


_PACKED = "slot int, row_keys binary, ids binary, counts binary, hashes binary"
_ANSWERS = "target int, row_keys binary, slots binary, counts binary, bits binary"
_ANSWER = "own long, {0}_slots array<int>, {0}_bits array<binary>"


def _dealt(keys, ids, arrays: list[np.ndarray], slot_of, dtype: str) -> pa.RecordBatch:
    """One row for each slot that a hash of the given documents falls into; in a row, documents in order, and their hashes by position."""
    sizes = np.fromiter(map(len, arrays), np.int64, len(arrays))
    hashes, owner = np.concatenate(arrays), np.repeat(np.arange(len(arrays)), sizes)
    slot = slot_of(hashes)
    order = np.argsort(slot, kind="stable")
    slot, owner, values = slot[order], owner[order], hashes[order].astype(dtype)
    starts = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
    keys, ids = np.array(keys, np.int64), np.array(ids, np.int64)
    rows: list[tuple] = []
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(slot)]):
        own = owner[lo:hi]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        counts = np.diff(np.append(first, hi - lo)).astype(np.uint32)
        rows.append((int(slot[lo]), keys[own[first]].tobytes(), ids[own[first]].tobytes(), counts.tobytes(), values[lo:hi].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 4])], ["slot", "row_keys", "ids", "counts", "hashes"])


def _gathered(documents: Iterator[tuple], slot_of, dtype: str) -> Iterator[pa.RecordBatch]:
    """From (row_key, id, hashes) of documents."""
    keys, ids, arrays, held = [], [], [], 0
    for key, own, found in documents:
        if len(found):
            keys.append(key)
            ids.append(np.iinfo(np.int64).max if own is None else own)
            arrays.append(found)
            held += len(found)
        if held >= HELD:
            yield _dealt(keys, ids, arrays, slot_of, dtype)
            keys, ids, arrays, held = [], [], [], 0
    if held:
        yield _dealt(keys, ids, arrays, slot_of, dtype)


def _unpacked(batches: Iterator[pa.RecordBatch], wide: np.dtype) -> Iterator[tuple]:
    """(row_key, id, hashes) of packed rows."""
    for batch in batches:
        for i in range(batch.num_rows):
            keys, ids, counts, hashes = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("row_keys", np.int64), ("ids", np.int64), ("counts", np.uint32), ("hashes", wide)))
            yield from zip(keys.tolist(), ids.tolist(), np.split(hashes, np.cumsum(counts.astype(np.int64))[:-1]))


def packed(rows: DataFrame, hashes_of, slots: int, dtype: np.dtype, wide: np.dtype) -> DataFrame:
    """The hashes of all documents by slot. hashes_of(row) gives a document's; rows begin with (row_key, id). dtype: what a slot keeps of a hash, of type ``wide``."""
    per = -(-slots // FAN)
    fine, coarse = (lambda h: _slots(h, slots)), (lambda h: _slots(h, slots) // np.uint32(per))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in small(batches):
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                row = [c[i].as_py() for c in columns]
                yield row[0], row[1], hashes_of(row)

    if per == 1:
        return rows.mapInArrow(lambda b: _gathered(documents(b), fine, dtype), _PACKED)
    grouped = rows.mapInArrow(lambda b: _gathered(documents(b), coarse, wide), _PACKED).repartition("slot")
    return grouped.mapInArrow(lambda b: _gathered(_unpacked(b, wide), fine, dtype), _PACKED)


def _joined(table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)


def _by_target(keys: np.ndarray, slot: np.ndarray, counts: np.ndarray, bits: list[bytes], target: np.ndarray) -> list[pa.Array]:
    """Packed answers, one row for each target."""
    rows: list[tuple] = []
    order = np.argsort(target, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(target[order])) + 1) if len(order) else []:
        rows.append((int(target[own[0]]), keys[own].tobytes(), slot[own].astype(np.int32).tobytes(), counts[own].astype(np.uint32).tobytes(), b"".join(bits[k] for k in own.tolist())))
    return [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, [pa.int32(), *[pa.binary()] * 4])]


_ANSWER_NAMES = ["target", "row_keys", "slots", "counts", "bits"]


def _target(keys: np.ndarray, slots: int, per: int = 1) -> np.ndarray:
    return (keys.view(np.uint64) % np.uint64(slots) // np.uint64(per)).astype(np.int32)


def _answers(table: pa.Table, dtype: str, slots: int, per: int, decide) -> pa.Table:
    """For each document of a slot with a chosen hash: a bit for each of its hashes there. decide(values, ids, owners) gives the bits of all."""
    keys, ids, counts, values = _joined(table, "row_keys", np.int64), _joined(table, "ids", np.int64), _joined(table, "counts", np.uint32).astype(np.int64), _joined(table, "hashes", dtype)
    owner = np.repeat(np.arange(len(keys)), counts)
    chosen = decide(values, ids, owner)
    ends = np.cumsum(counts)
    which = np.flatnonzero(np.bincount(owner[chosen], minlength=len(keys)))
    bits = [np.packbits(chosen[ends[k] - counts[k] : ends[k]]).tobytes() for k in which.tolist()]
    slot = np.full(len(which), table.column("slot")[0].as_py())
    return pa.table(_by_target(keys[which], slot, counts[which], bits, _target(keys[which], slots, per)), _ANSWER_NAMES)


def _cut_bits(table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(keys, slots, counts, bits) of packed answers, by document."""
    keys, slot, counts = _joined(table, "row_keys", np.int64), _joined(table, "slots", np.int32), _joined(table, "counts", np.uint32).astype(np.int64)
    data, ends = b"".join(table.column("bits").to_pylist()), np.cumsum(-(-counts // 8)).tolist()
    return keys, slot, counts, [data[i:j] for i, j in zip([0, *ends], ends)]


def answered(packed_rows: DataFrame, dtype: str, slots: int, decide) -> DataFrame:
    """Packed answers by slot of the document keys."""
    per = -(-slots // FAN)
    answers = packed_rows.groupBy("slot").applyInArrow(lambda t: _answers(t, dtype, slots, per, decide), _ANSWERS)
    if per == 1:
        return answers

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, slot, counts, bits = _cut_bits(batch)
            yield pa.RecordBatch.from_arrays(_by_target(keys, slot, counts, bits, _target(keys, slots)), _ANSWER_NAMES)

    return answers.repartition("target").mapInArrow(deal, _ANSWERS)


def _by_document(table: pa.Table, kind: str) -> pa.Table:
    """One row a document of its slots and their bits, from the packed answers to one slot of the keys."""
    keys, slot, _, bits = _cut_bits(table)
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
    offsets = pa.array(np.append(starts, len(keys)), pa.int32())
    return pa.table([pa.array(keys[order][starts]), pa.ListArray.from_arrays(offsets, pa.array(slot[order])), pa.ListArray.from_arrays(offsets, pa.array([bits[k] for k in order.tolist()], pa.binary()))], ["own", f"{kind}_slots", f"{kind}_bits"])


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by value, the starts of equal values in it, and the group of each place in it."""
    order = np.lexsort((values["b"], values["a"])) if values.dtype.names else np.argsort(values, kind="stable")
    own = values[order]
    new = np.concatenate(([True], own[1:] != own[:-1]))
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _anchored(values: np.ndarray, ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes (the lowest bit says: an indexed block) that some document has as a block, and two rows have."""
    order, starts, group = _groups(values >> np.uint32(1))
    block = np.bitwise_or.reduceat(values[order] & np.uint32(1), starts) > 0
    low, high = np.minimum.reduceat(owner[order], starts), np.maximum.reduceat(owner[order], starts)
    out = np.empty(len(values), bool)
    out[order] = (block & (low < high))[group]
    return out


def _earlier(values: np.ndarray, ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that a document with a smaller id has."""
    order, starts, group = _groups(values)
    own = ids[owner[order]]
    out = np.empty(len(values), bool)
    out[order] = np.minimum.reduceat(own, starts)[group] < own
    return out


class Hot:
    """Windows that don't go to slots: their hashes, ascending, and for each what is known of it."""

    def __init__(self, hashes: np.ndarray, chosen: np.ndarray | None = None):
        self.hashes, self.chosen = hashes, chosen

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some hashes are hot, and for each of these its number."""
        if not len(self.hashes) or not len(hashes):
            return np.zeros(len(hashes), bool), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = self.hashes[at] == hashes
        return found, at[found]


def frequent(rows: DataFrame, n: int, keys_of, slots: int) -> np.ndarray:
    """The hashes, ascending, that are in many documents of a sample. keys_of(text) gives a document's."""
    share, sampled = min(1.0, SAMPLE / max(1, n)), min(n, SAMPLE)
    least = max(FEWEST, int(SHARE * sampled))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.unique(keys_of(x)) for batch in small(batches) for x in batch.column(0).to_pylist()]
        keys, many = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
        keys, many = keys[many > 1], many[many > 1]  # of tasks with hundreds of documents each, a hot window is in some twice
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(many.astype(np.int64))], ["hash", "n"])

    at = F.shiftrightunsigned("row_key", 11) / F.lit(float(1 << 53))
    few = rows.where(at < share).select("text").repartition(min(slots, 32))
    sums = few.mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r[0] for r in sums.orderBy(F.col("n").desc(), "hash").limit(MOST).collect()], np.int64).view(np.uint64))


def met(rows: DataFrame, hot: Hot, keys_of, name: str) -> DataFrame:
    """What all documents have of the hot windows, one row a task and window: hash, block (somewhere it is an indexed one), least and most row_key, least id; and a row for each document with one (key). keys_of(row) gives (hashes, whether each is an indexed block)."""
    largest = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(hot.hashes)
        block, low, high, least = np.zeros(n, bool), np.full(n, largest), np.full(n, -largest - 1), np.full(n, largest)
        seen, keys = np.zeros(n, bool), []
        columns = lambda *x: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(x, [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64()])], ["hash", "block", "low", "high", "least", "key"])
        for batch in small(batches):
            fields = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                row = [c[i].as_py() for c in fields]
                hashes, blocks = keys_of(row)
                which, at = hot.find(hashes)
                if len(at):
                    keys.append(row[0])
                    seen[at] = True
                    np.logical_or.at(block, at, blocks[which])
                    low[at], high[at] = np.minimum(low[at], row[0]), np.maximum(high[at], row[0])
                    least[at] = np.minimum(least[at], largest if row[1] is None else row[1])
        at = np.flatnonzero(seen)
        yield columns(hot.hashes[at].view(np.int64), block[at], low[at], high[at], least[at], [None] * len(at))
        for k in range(0, len(keys), 1 << 16):
            own = keys[k : k + (1 << 16)]
            yield columns(*[[None] * len(own)] * 5, own)

    return written(rows.mapInArrow(run, "hash long, block boolean, low long, high long, least long, key long"), name)


def _places(hashes: np.ndarray, slots: int, answers: list, where: np.ndarray, hot: Hot, keys: np.ndarray, wanted) -> np.ndarray:
    """The places, out of ``where``, of the hashes that the answers (slot, bits) chose, and of the hot ones, by their keys, that are ``wanted`` (numbers of hot ones to yes or no)."""
    is_hot, number = hot.find(keys)
    cold = where[~is_hot]
    slot = _slots(hashes[~is_hot], slots)
    found = [where[is_hot][wanted(number)]]
    for own, bits in answers:
        at = cold[slot == own]
        found.append(at[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(at)).astype(bool)])
    return np.concatenate(found)


def _covering(places: np.ndarray, before: int, after: int, n: int) -> np.ndarray:
    """Those of 0 ... n-1 from ``before`` below a place to ``after`` above it, both included."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.clip(places - before, 0, n), 1)
    np.add.at(change, np.clip(places + after + 1, 0, n), -1)
    return np.flatnonzero(np.cumsum(change[:n]) > 0)


def _anchor_key(hashes: np.ndarray) -> np.ndarray:
    return hashes & ~np.uint64(1)


def _candidates(hashes: np.ndarray, slots: int, answers: list, block: int, window: int, hot: Hot) -> np.ndarray:
    """The starts of windows that contain an anchor."""
    anchors = _places(hashes, slots, answers, np.arange(len(hashes)), hot, _anchor_key(hashes), lambda k: hot.chosen[k])
    return _covering(anchors, window - block, 0, max(0, len(hashes) - (window - block)))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """For each row: doc_id, n_words, n_removed and kept, the words left, joined by one space.

    A word goes if it lies in ``window`` consecutive words whose sequence also
    starts in a document with a smaller id. All windows are judged on the input.
    A null text has no words. Rows with the same id are one document's: they
    don't repeat each other. A null id is larger than any other. Texts of any length
    are read whole. An empty table gives an empty result; other columns aren't
    read.
    """
    spark, block = docs.sparkSession, (window + 1) // 2  # two blocks cover a window, and a window holds a whole indexed block
    # (id, text) stand for a row: rows equal in both have the same windows
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n, chars = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // SLOT_CHARS))
    narrow, whole = np.dtype("<u8"), np.dtype("<u4")

    def told(packed_rows: DataFrame, kind: str, dtype: np.dtype, decide) -> DataFrame:
        """The answers by document, written; then the shuffles before them can go."""
        answers = answered(packed_rows, dtype, slots, decide)
        found = written(answers.groupBy("target").applyInArrow(lambda t: _by_document(t, kind), _ANSWER.format(kind)), kind)
        release(spark)
        return found

    def with_hot(answers: DataFrame, seen: DataFrame | None) -> DataFrame:
        """The answers, and documents that only have hot windows."""
        if seen is None:
            return answers
        keys = seen.where("key is not null").select("key").distinct()
        return answers.join(keys, F.col("own") == F.col("key"), "full_outer").withColumn("own", F.coalesce("own", "key")).drop("key")

    def summed(hot: Hot, seen: DataFrame) -> list:
        """(block, low, high, least) of each hot window, in their order: a row for each, whatever the input."""
        found = {r["hash"]: r for r in seen.where("hash is not null").groupBy("hash").agg(F.bool_or("block").alias("block"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("least").alias("least")).collect()}
        return [found.get(h) for h in hot.hashes.view(np.int64).tolist()]

    # hot blocks, and what becomes of them
    hot = Hot(frequent(rows, n, lambda x: _anchor_key(rolling(hashed(words_of(x)), block)), slots), np.empty(0, bool))
    seen = None
    if len(hot.hashes):
        def blocks(row: list) -> tuple[np.ndarray, np.ndarray]:
            hashes = _anchor_key(rolling(hashed(words_of(row[2])), block))
            return hashes, np.arange(len(hashes)) % block == 0

        seen = met(rows, hot, blocks, "hot-blocks")
        hot = Hot(hot.hashes, np.array([r is not None and r["block"] and r["low"] < r["high"] for r in summed(hot, seen)], bool))

    def probes(row: list) -> np.ndarray:
        """The lowest bit says whether a window is an indexed block; slots don't look at it."""
        hashes = _anchor_key(rolling(hashed(words_of(row[2])), block))
        marked = hashes | (np.arange(len(hashes)) % block == 0).astype(np.uint64)
        return marked[~hot.find(hashes)[0]]

    anchors = with_hot(told(packed(rows, probes, slots, whole, narrow), "anchor", whole, _anchored), seen)

    def starts_of(own: np.ndarray, answer_slots, answer_bits) -> np.ndarray:
        return _candidates(rolling(own, block), slots, list(zip(answer_slots or (), answer_bits or ())), block, window, hot)

    hit = rows.join(anchors, F.col("row_key") == F.col("own")).select("row_key", "doc_id", "text", "anchor_slots", "anchor_bits")
    # hot windows: only a document with a hot block has one
    warm = Hot(frequent(rows, n, lambda x: longer(hashed(words_of(x)), block, window)["a"], slots) if len(hot.hashes) else np.empty(0, np.uint64))
    first, found_warm = np.empty(0, np.int64), None
    if len(warm.hashes):
        def windows(row: list) -> tuple[np.ndarray, np.ndarray]:
            own = hashed(words_of(row[2]))
            found = longer(own, block, window)[starts_of(own, row[3], row[4])]["a"]
            return found, np.zeros(len(found), bool)

        found_warm = met(hit, warm, windows, "hot-windows")
        first = np.array([np.iinfo(np.int64).max if r is None else r["least"] for r in summed(warm, found_warm)], np.int64)

    def extensions(row: list) -> np.ndarray:
        own = hashed(words_of(row[2]))
        found = longer(own, block, window)[starts_of(own, row[3], row[4])]
        return found[~warm.find(found["a"])[0]]

    repeats = with_hot(told(packed(hit, extensions, slots, KEPT, WIDE), "repeat", KEPT, _earlier), found_warm)
    # of the anchors, only those of rows that lose words matter now
    known = repeats.join(anchors.withColumnRenamed("own", "its"), F.col("own") == F.col("its")).drop("its")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found: list[tuple] = []
            for doc_id, text, of_anchors, anchor_bits, of_repeats, repeat_bits, hit_any in zip(*(batch.column(i).to_pylist() for i in range(7))):
                words = words_of(text)
                n = len(words)
                gone = np.empty(0, np.int64)
                if hit_any:
                    own = hashed(words)
                    starts = starts_of(own, of_anchors, anchor_bits)
                    hashes = longer(own, block, window)[starts]
                    least = np.iinfo(np.int64).max if doc_id is None else doc_id
                    chosen = _places(hashes, slots, list(zip(of_repeats or (), repeat_bits or ())), starts, warm, hashes["a"], lambda k: first[k] < least)
                    gone = _covering(chosen, 0, window - 1, n)
                if len(gone):
                    stay = np.ones(n, bool)
                    stay[gone] = False
                    words = [words[i] for i in np.flatnonzero(stay).tolist()]
                found.append((n, len(gone), b" ".join(words).decode("utf-8", "surrogatepass")))
            columns = zip(*found) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip(columns, [pa.int64(), pa.int64(), pa.string()])]], ["doc_id", "n_words", "n_removed", "kept"])

    joined = rows.join(known, F.col("row_key") == F.col("own"), "left").select("doc_id", "text", "anchor_slots", "anchor_bits", "repeat_slots", "repeat_bits", F.col("own").isNotNull().alias("hit"))
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
