"""SimHash near-duplicates by BK-trees over pigeonhole shards.

Fingerprints: each shingle of words is hashed to 64 bits; a bit of the
fingerprint is 1 if it is set in over half of the hashes. Wider fingerprints
add words whose bits come from a mix of the same hashes.

Search: the first 64 bits are cut into blocks, and a fingerprint goes to one
shard for each pair of blocks, keyed by their bits. Two fingerprints that
differ in at most ``blocks - 2`` bits agree in two blocks and so meet in a
shard: up to that radius nothing is lost. In a shard a BK-tree is built, whose
children are keyed by their Hamming distance to the parent, and each
fingerprint follows only the edges within the radius. A shard with more than
``SHARD`` fingerprints is cut into parts, each part's tree goes to each part's
queries, and so a task holds two parts at most. All trees of a task are built
and searched together, level by level, as integer arrays.

What leaves a shard is a spanning forest of its links (at most one row a
fingerprint), never its pairs; it is grown by rising radius, so that whatever is
connected at a smaller distance is connected by links of that distance. Exact
copies are one fingerprint from the start.

Similarity of sets: where one is asked for, what goes to shards are sets of
distinct shingles. ``BANDS`` shards a set are keyed by ``ROWS_OF_BAND`` minimum
hashes each, and in a shard the trees hold one bit of each of 256 minimum
hashes. Only equal sets are one from the start. The forest's links are tested
exactly, on the sets; where a tested link fails and so leaves what the forest
had connected in pieces, all pairs across pieces are tested.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexforge.llm.batches import small, tidy
from lexforge.llm.graph import components
from lexforge.session import written

#: Fingerprints in a part of a shard, and (query, node) visits held at once.
SHARD, VISITS = 4096, 1 << 17
#: Rows that are broadcast at most.
SENT = 200_000
#: Rows of a task that are searched together.
ROWS = 1 << 17
#: Shards of a set, minimum hashes of a shard's key, and sets of a part where pairs across pieces are tested.
BANDS, ROWS_OF_BAND, PIECES = 30, 3, 1024
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hash of each shingle of words, repeats included; of the whole sequence, if it is shorter; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, and only ASCII space splits
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(joined[i:j], 42) for i, j in zip(starts[:n].tolist(), ends[-n:].tolist())), np.uint64, n)


def fingerprint(text: str | None, shingle: int = 4, width: int = 1) -> np.ndarray:
    """``width`` 64-bit words; all zero for a text without words."""
    h = _hashes(text, shingle)
    n, out = len(h), np.zeros(width, np.uint64)
    for k in range(width if n else 0):
        own = h if k == 0 else _mixed(h, _MIX[(k - 1) % 3] + 2 * k)
        set_bits = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 15):
            part = own[at : at + (1 << 15)]
            set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * set_bits > n, bitorder="little").view(np.uint64)[0]
    return out


def _mixed(h: np.ndarray, factor: int) -> np.ndarray:
    h = h * np.uint64(factor)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_SEEDS = _mixed(np.arange(1, 129, dtype=np.uint64), _MIX[0])


def minima(h: np.ndarray) -> np.ndarray:
    """The minima of 256 32-bit hashes of a set of hashes."""
    low = np.full(256, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 256):
        own = h[at : at + 256, None] ^ _SEEDS
        own *= np.uint64(_MIX[1])
        own ^= own >> np.uint64(32)
        own *= np.uint64(_MIX[2])
        own ^= own >> np.uint64(29)
        np.minimum(low, own.view(np.uint32).min(0), out=low)
    return low


def set_prints(rows: DataFrame, *, shingle: int) -> DataFrame:
    """(doc_id, text) to (doc_id, hash of the text, node: the hash of its set of shingles, f0 ... f3: a bit of each minimum, keys: its shards, none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [np.unique(_hashes(x, shingle)) for x in batch.column(2).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets], np.uint64).view(np.int64)
            low = np.array([minima(x) for x in sets], np.uint32).reshape(-1, 256)
            bits = np.packbits((low & 1).astype(np.uint8), axis=1, bitorder="little").view(np.int64)
            keys = np.repeat(np.arange(BANDS, dtype=np.uint64)[None], len(sets), 0)
            for k in range(ROWS_OF_BAND):
                keys = _mixed(keys ^ low[:, k * BANDS : (k + 1) * BANDS], _MIX[k % 3])
            shards = pa.array([x.view(np.int64) if len(own) else [] for x, own in zip(keys, sets)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node), *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4)], shards], ["doc_id", "hash", "node", "f0", "f1", "f2", "f3", "keys"])

    return rows.select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(run, "doc_id long, hash long, node long, f0 long, f1 long, f2 long, f3 long, keys array<long>")


def fingerprints(rows: DataFrame, *, shingle: int = 4, width: int = 1) -> DataFrame:
    """(doc_id, text) to (doc_id, hash of the text, f0 ... f{width-1}), whole texts; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = np.array([fingerprint(x, shingle, width) for x in batch.column(2).to_pylist()], np.uint64).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(np.ascontiguousarray(found[:, k]).view(np.int64)) for k in range(width)]], ["doc_id", "hash", *[f"f{k}" for k in range(width)]])

    return rows.select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(run, ", ".join(["doc_id long, hash long", *[f"f{k} long" for k in range(width)]]))


def _spans(blocks: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each block of 64 bits."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [(i, j - i) for i, j in zip(edges, edges[1:])]


def _keys(blocks: int) -> Column:
    """For each pair of blocks, the pair's number and their bits as one integer."""
    spans = _spans(blocks)
    bits = [F.shiftrightunsigned("f0", at).bitwiseAND(F.lit((1 << n) - 1)) for at, n in spans]
    pairs = list(combinations(range(blocks), 2))
    return F.array(*[F.shiftleft(F.shiftleft(bits[i], spans[j][1]).bitwiseOR(bits[j]), 11).bitwiseOR(F.lit(k).cast("long")) for k, (i, j) in enumerate(pairs)])


class Forest:
    """BK-trees, one for each group of rows, over fingerprints of any width."""

    def __init__(self, prints: np.ndarray, groups: np.ndarray):
        """prints: (n, width) of uint64; groups: ascending integers from 0, one a row; its first row is a tree's root."""
        self.prints, self.far = prints, 64 * prints.shape[1] + 1
        n = len(prints)
        first = np.concatenate(([True], groups[1:] != groups[:-1])) if n else np.empty(0, bool)
        self.root = np.flatnonzero(first)
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        waiting, at = np.flatnonzero(~first), self.root[groups[~first]]
        while len(waiting):
            away = self.distance(prints[waiting], at)
            slot = at * self.far + away
            order = np.argsort(slot, kind="stable")
            waiting, slot = waiting[order], slot[order]
            new = np.concatenate(([True], slot[1:] != slot[:-1]))
            child = waiting[new]
            parent[child], edge[child] = slot[new] // self.far, slot[new] % self.far
            at = child[np.cumsum(new) - 1][~new]
            waiting = waiting[~new]
        nodes = np.flatnonzero(parent >= 0)
        slot = parent[nodes] * self.far + edge[nodes]
        order = np.argsort(slot)
        self.slot, self.child = slot[order], nodes[order]

    def distance(self, prints: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return np.bitwise_count(prints ^ self.prints[nodes]).sum(1, dtype=np.int64)

    def search(self, prints: np.ndarray, groups: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yields arrays of (query row, node) within the radius; groups: the tree of each query."""
        stack = [(np.arange(len(prints)), self.root[groups])] if len(prints) else []
        while stack:
            query, node = stack.pop()
            if len(query) > VISITS:
                stack += [(query[:VISITS], node[:VISITS]), (query[VISITS:], node[VISITS:])][::-1]
                continue
            away = self.distance(prints[query], node)
            hit = away <= radius
            yield query[hit], node[hit]
            low = np.searchsorted(self.slot, node * self.far + np.maximum(away - radius, 0))
            high = np.searchsorted(self.slot, node * self.far + np.minimum(away + radius, self.far - 1), "right")
            many = high - low
            if total := int(many.sum()):
                step = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
                stack.append((np.repeat(query, many), self.child[np.repeat(low, many) + step]))


class Union:
    """Smallest members of joined sets."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        x = self.up[x]
        while (further := self.up[x] != x).any():
            x[further] = self.up[x[further]]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Joins the sets of each pair; returns which pairs did it: a spanning forest of what they connect."""
        at, used = np.arange(len(a)), []
        while len(at):
            x, y = self.find(a[at]), self.find(b[at])
            apart = x != y
            at, high, low = at[apart], np.maximum(x, y)[apart], np.minimum(x, y)[apart]
            root, first = np.unique(high, return_index=True)
            self.up[root] = low[first]
            used.append(at[first])
        return np.concatenate(used) if used else np.empty(0, np.int64)


def forest_links(prints: np.ndarray, groups: np.ndarray, in_tree: np.ndarray, asks: np.ndarray, radii: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(row, row): links between asking rows and tree rows of the same group that connect what is within the last radius, smaller radii first."""
    trees, sets = np.flatnonzero(in_tree), Union(len(prints))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    if len(trees):
        with_tree, own = np.unique(groups[trees], return_inverse=True)
        forest = Forest(prints[trees], own)
        rows = np.flatnonzero(asks & np.isin(groups, with_tree))
        for radius in radii:
            for query, node in forest.search(prints[rows], np.searchsorted(with_tree, groups[rows]), radius):
                a, b = rows[query], trees[node]
                used = sets.join(a, b)
                out.append((a[used], b[used]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 2


def links(prints: DataFrame, *, radii: tuple[int, ...], blocks: int | None, width: int = 1) -> DataFrame:
    """(a, b): links between rows of distinct fingerprints (columns node, f0, ...) that connect all that are within the last radius and share two blocks (with no ``blocks``: one of ``keys``), those of smaller radii first."""
    names = [f"f{k}" for k in range(width)]
    keyed = prints.select("node", *names, F.explode(_keys(blocks) if blocks else "keys").alias("key"))
    large = keyed.groupBy("key").count().where(F.col("count") > SHARD).select(F.col("key").alias("own"), F.ceil(F.col("count") / SHARD).cast("int").alias("parts"))
    large = written(large, "large-shards")
    part = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int")
    cut = keyed.join(large, F.col("key") == F.col("own"), "left").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    # a cell is (key, i, j), i <= j: part i is the tree, part j asks
    cells = cut.select("node", *names, "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part")
    dealt = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(table: pa.Table) -> pa.RecordBatch:
            column = lambda name: table.column(name).to_numpy()
            node, i, j, own = column("node"), column("i"), column("j"), column("part")
            key = column("key")
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            group = np.cumsum(new) - 1
            keep = np.bincount(group)[group] > 1  # alone, none has a link
            values = np.stack([column(x).view(np.uint64) for x in names], 1)[keep]
            a, b = forest_links(values, group[keep], (own == i)[keep], (own == j)[keep], radii)
            ids = node[keep]
            return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                key, i, j = (table.column(x).to_numpy() for x in ("key", "i", "j"))
                same = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))
                whole = int(same[-1]) + 1 if len(same) else 0  # the last group may go on
                if whole:
                    yield flush(table.slice(0, whole))
                held, size = table.slice(whole).to_batches(), table.num_rows - whole
        if size:
            yield flush(pa.Table.from_batches(held).combine_chunks())
        held.clear()
        tidy()

    return dealt.mapInArrow(run, "a long, b long")


def _shingles(rows: DataFrame, shingle: int) -> DataFrame:
    """(node, text) to (node, shingles): the distinct hashes of a text's shingles, 32 bits of those for fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [np.unique((_hashes(x, shingle) >> np.uint64(32)).astype(np.uint32)).view(np.int32) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int32()))], ["node", "shingles"])

    return rows.mapInArrow(run, "node long, shingles array<int>")


def _checked(found: DataFrame, docs: DataFrame, distinct: DataFrame, shingle: int, radius: int, similarity: float) -> DataFrame:
    """(a, b): links of texts whose sets of shingles are similar enough; they connect all such pairs that ``found`` connects and that are within the radius."""
    pairs = written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links-found")
    ends = pairs.select(F.col("a").alias("end")).union(pairs.select("b")).distinct()
    names = ["f0", "f1", "f2", "f3"]
    needed = written(distinct.join(ends, F.col("node") == F.col("end"), "left_semi").select("node", *names, F.col("first.id").alias("id"), F.col("first.hash").alias("hash")), "linked-texts")
    # 24 bytes a row: with up to SENT of them texts needn't be shuffled, beyond that both sides are
    sought = needed.select("node", "id", "hash")
    sought = F.broadcast(sought) if needed.count() <= SENT else sought
    texts = docs.join(sought, docs["doc_id"].eqNullSafe(sought["id"]) & (F.xxhash64(docs["text"]) == F.col("hash"))).select("node", docs["text"])
    sets = written(_shingles(texts, shingle).dropDuplicates(["node"]), "linked-shingles")
    side = lambda c: sets.select(F.col("node").alias(f"{c}_node"), F.col("shingles").alias(f"{c}_set"))
    both = pairs.join(side("a"), F.col("a") == F.col("a_node")).join(side("b"), F.col("b") == F.col("b_node"))
    shared = F.size(F.array_intersect("a_set", "b_set"))
    good = written(both.where(F.try_divide(shared, F.size("a_set") + F.size("b_set") - shared) >= similarity).select("a", "b"), "links-checked")
    if good.count() == pairs.count():
        return good
    root = lambda of, name: components(of, "a", "b").toDF(f"{name}_node", name)
    known, pieces = root(pairs, "known"), root(good, "piece")
    placed = needed.select("node", *names).join(known, F.col("node") == F.col("known_node"), "left").join(pieces, F.col("node") == F.col("piece_node"), "left")
    placed = written(placed.select("node", *names, F.coalesce("known", "node").alias("known"), F.coalesce("piece", "node").alias("piece")), "pieces")
    parts = placed.groupBy("known").agg(F.count(F.lit(1)).alias("n"), F.min("piece").alias("low"), F.max("piece").alias("high")).where("low < high").select(F.col("known").alias("own"), F.ceil(F.col("n") / PIECES).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    open_sets = placed.join(parts, F.col("known") == F.col("own")).join(sets.withColumnRenamed("node", "its"), F.col("node") == F.col("its"))
    cut = open_sets.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cut.select("known", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "piece", "shingles", *names)

    def run(cell: pa.Table) -> pa.Table:
        node, piece, own = (cell.column(c).to_numpy() for c in ("node", "piece", "part"))
        prints = np.stack([cell.column(c).to_numpy().view(np.uint64) for c in names], 1)
        a, b = across(prints, piece, own, [x.values.to_numpy() for x in cell.column("shingles")], radius, similarity)
        return pa.table({"a": pa.array(node[a], pa.int64()), "b": pa.array(node[b], pa.int64())})

    return good.union(cells.groupBy("known", "i", "j").applyInArrow(run, "a long, b long"))


def across(prints: np.ndarray, pieces: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, row): links that connect all pairs of rows, of different parts if there are two, that are within the radius and whose sets, ascending, are similar enough; rows of a piece are connected already."""
    first, second = np.flatnonzero(parts == parts.min()), np.flatnonzero(parts == parts.max())
    sizes = np.array([len(x) for x in sets])
    of = np.unique(pieces, return_inverse=True)[1].reshape(-1)
    sets_of = Union(int(of.max()) + 1)
    out: list[tuple[int, int]] = []
    for at in range(0, len(first), 128):
        rows = first[at : at + 128]
        away = np.bitwise_count(prints[rows][:, None] ^ prints[second][None]).sum(2, dtype=np.int64)
        near = (away <= radius) & (np.minimum(sizes[rows][:, None], sizes[second]) >= similarity * np.maximum(sizes[rows][:, None], sizes[second]) - 1e-9)
        near &= sets_of.find(of[rows])[:, None] != sets_of.find(of[second])
        x, y = np.nonzero(near)
        for k in np.argsort(away[x, y], kind="stable").tolist():
            a, b = int(rows[x[k]]), int(second[y[k]])
            u, v = (int(sets_of.find(of[c : c + 1])[0]) for c in (a, b))
            if u == v:
                continue
            shared = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if shared / (sizes[a] + sizes[b] - shared) >= similarity:
                sets_of.up[max(u, v)] = min(u, v)
                out.append((a, b))
    found = np.array(out, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, width: int = 4, radii: tuple[int, ...] = (20, 40, 60), blocks: int = 10, similarity: float | None = 0.8) -> DataFrame:
    """For each row: doc_id, hash (of its text), its fingerprint (f0, ...) and component_id, the smallest doc_id reachable over links.

    With no ``similarity``, two fingerprints link if they differ in at most the
    last of ``radii`` bits; with ``width`` 1 and ``blocks`` of at least two more
    every link is found.

    With a similarity, texts link if their sets of shingles share that much of
    their union; ``width`` and ``blocks`` aren't used. Every link is tested on
    the sets, but for equal ones. A pair at 0.8 isn't a candidate with a chance
    of 5e-10 by its shards (30 of 3 minima) and 1.2e-10 by the radius (60 of 256
    bits, 26 expected), both less the more alike the sets are; these chances
    hold for sets of any size.

    Texts without words are one set and link to no other; a null text has no
    words. Texts of any length are read whole. Repeated rows fall into the same
    component. A null id isn't in any component's minimum, but its row is returned. An empty table
    gives an empty result; other columns aren't read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    of_known = F.min(F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("id"), "hash")))
    of_any = F.min(F.struct(F.col("doc_id").alias("id"), "hash"))
    first = [F.min("doc_id").alias("least"), F.coalesce(of_known, of_any).alias("first")]
    if similarity is None:
        names = same = [f"f{k}" for k in range(width)]
        prints = written(fingerprints(rows, shingle=shingle, width=width), "fingerprints")
        node = F.col("f0") if width == 1 else F.xxhash64(*names)
        distinct = written(prints.groupBy(*names).agg(*first).withColumn("node", node), "distinct-prints")
        found = links(distinct, radii=radii, blocks=blocks, width=width)
    else:
        names, same = [f"f{k}" for k in range(4)], ["node"]
        prints = written(set_prints(rows, shingle=shingle), "fingerprints")
        distinct = written(prints.groupBy("node").agg(*first, *[F.first(c).alias(c) for c in (*names, "keys")]), "distinct-prints")
        found = _checked(links(distinct, radii=radii, blocks=None, width=4), rows, distinct, shingle, radii[-1], similarity)
    groups = components(found, "a", "b")
    rooted = distinct.join(groups.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").withColumn("root", F.coalesce("root", "node"))
    lowest = rooted.groupBy(F.col("root").alias("own")).agg(F.min("least").alias("component_id"))
    labels = rooted.join(lowest, F.col("root") == F.col("own")).select(*[F.col(x).alias(f"_{x}") for x in same], "component_id")
    labels = written(labels, "labels")
    return prints.join(labels, [F.col(x) == F.col(f"_{x}") for x in same]).select("doc_id", "hash", *names, "component_id")


def keep_representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the near-duplicates that :func:`near_duplicates` finds: of each component the row with the smallest id stays, with all its columns.

    Of repeated rows (of one id and one text) the first by the other columns
    stays, and rows of one id with different texts are documents of their own. A
    null id stays only in a component without any other. What goes is decided on
    (id, hash of the text, component) alone, so texts are only read again, and
    shuffled once.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stays"), F.col("hash").alias("its")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text_col].cast("string")).alias("hash"))
    kept = rows.join(stays, F.col("id").eqNullSafe(F.col("stays")) & (F.col("hash") == F.col("its"))).drop("stays", "its")
    rank = F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.to_json("row")))
    return kept.withColumn("rank", rank).where("rank = 1").select("row.*")
