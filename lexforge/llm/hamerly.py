"""Centroid clustering of whole-number vectors, by Hamerly's bounds.

Each vector keeps its cluster, an upper bound of the distance to that cluster's
centroid and one lower bound of the distance to every other. When centroids move,
the upper bound grows by its own centroid's drift and the lower one shrinks by the
largest drift of another. A vector whose upper bound stays below the lower one, or
below half the way from its centroid to the next, can't change; of the others the
upper bound is made exact, and those that are still ambiguous are compared with
all centroids, in whole numbers. Bounds are rounded outwards, so they decide only what is certain,
and ties are always scanned.

The state is a table with a row for each block of vectors. A round reads it and
writes it anew, with each block's sums by cluster beside it, which are all that a
round shuffles; a centroid for each cluster is all that reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexforge.session import forget, written

#: Vectors of a block; the size that components have to be below, so that sums of squares fit in 38 digits.
BLOCK, LARGEST = 4096, 2.0**45
_STATE = "ids array<long>, x binary, cluster binary, upper binary, lower binary, many binary, sums array<decimal(38,0)>, far array<decimal(38,0)>"


def whole(vectors: DataFrame, id_col: str, vector_col: str, components: int, scale: int) -> DataFrame:
    """(vec_id, x): floor(scale * component), as doubles, of the vectors with exactly ``components`` components, of which none is null, non-finite, or scaled to ``LARGEST`` or beyond."""
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda c: F.lit(float(scale)) * c)
    fits = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    down = F.transform("x", lambda c: F.floor(c).cast("double"))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == components) & F.coalesce(fits, F.lit(False))).select("vec_id", down.alias("x"))


def small_enough(*arrays: np.ndarray) -> bool:
    """Whether sums of squared differences are below 2 ** 53, so that doubles add them exactly in any order."""
    width = max((a.shape[1] for a in arrays), default=1)
    return all(np.abs(a).max(initial=0) <= 2.0 ** ((51 - int(width).bit_length()) // 2) for a in arrays)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows and centroids: doubles if they hold them, else Python's whole numbers."""
    if small_enough(x, c):
        return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
    own, its = ([[int(v) for v in row] for row in a] for a in (x, c))
    return np.array([[sum((p - q) ** 2 for p, q in zip(row, centre)) for centre in its] for row in own], object).reshape(len(x), len(c))


def _up(d2: np.ndarray) -> np.ndarray:
    """Roots, rounded up."""
    return np.nextafter(np.sqrt(np.nextafter(d2.astype(float), np.inf)), np.inf)


def _down(d2: np.ndarray) -> np.ndarray:
    """Roots, rounded down, but not below 0."""
    return np.maximum(np.nextafter(np.sqrt(np.maximum(np.nextafter(d2.astype(float), -np.inf), 0)), -np.inf), 0)


class Centroids:
    """The centroids of a round (Python's whole numbers), how far each has drifted since the last (rounded up), and half its way to the nearest other (rounded down)."""

    def __init__(self, rows: list[list[int]], before: list[list[int]] | None = None):
        self.rows = rows
        self.c = np.array([[float(v) if abs(v) < 1 << 53 else v for v in row] for row in rows], float if all(abs(v) < 1 << 53 for row in rows for v in row) else object)
        apart = np.array([[sum((p - q) ** 2 for p, q in zip(a, b)) for b in rows] for a in rows], object).astype(float)
        np.fill_diagonal(apart, np.inf)
        self.half = _down(apart.min(axis=1)) / 2
        moved = [sum((p - q) ** 2 for p, q in zip(a, b)) for a, b in zip(rows, before)] if before else [0] * len(rows)
        self.drift = np.where(np.array(moved, object) == 0, 0, _up(np.array(moved, object)))

    def others(self) -> np.ndarray:
        """For each the largest drift of another."""
        order = np.argsort(self.drift)
        out = np.full(len(self.drift), self.drift[order[-1]])
        out[order[-1]] = self.drift[order[-2]] if len(order) > 1 else 0
        return out


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, to: Centroids) -> int:
    """Clusters and bounds for these centroids, in place; ``cluster`` is -1 where there was none. Returns how many vectors were scanned."""
    known = np.flatnonzero(cluster >= 0)
    its = cluster[known]
    upper[known] = np.nextafter(upper[known] + to.drift[its], np.inf)
    lower[known] = np.nextafter(lower[known] - to.others()[its], -np.inf)
    unsure = known[upper[known] >= np.maximum(lower[known], to.half[its])]
    # the exact distance to the own centroid first
    for k in np.unique(cluster[unsure]).tolist():
        own = unsure[cluster[unsure] == k]
        upper[own] = _up(squared(x[own], to.c[k : k + 1])[:, 0])
    unsure = unsure[upper[unsure] >= np.maximum(lower[unsure], to.half[cluster[unsure]])]
    scan = np.concatenate((np.flatnonzero(cluster < 0), unsure))
    if len(scan):
        d2 = squared(x[scan], to.c)
        best = np.argmin(d2, axis=1)  # of equal ones the first
        at = np.arange(len(scan))
        cluster[scan], upper[scan] = best, _up(d2[at, best])
        rest = d2.copy()
        rest[at, best] = np.inf
        lower[scan] = _down(rest.min(axis=1)) if d2.shape[1] > 1 else np.inf
    return len(scan)


def distances(x: np.ndarray, cluster: np.ndarray, to: Centroids) -> list[int]:
    """Exact squared distances to the own centroids."""
    out = np.zeros(len(x), object)
    for k in np.unique(cluster).tolist():
        own = np.flatnonzero(cluster == k)
        out[own] = [int(v) for v in squared(x[own], to.c[k : k + 1])[:, 0]]
    return out.tolist()


def _sums(x: np.ndarray, cluster: np.ndarray, k: int) -> list[int]:
    """Component sums, cluster by cluster."""
    if small_enough(x):  # and a block has few rows
        out = np.zeros((k, x.shape[1]))
        np.add.at(out, cluster, x)
        return [int(v) for v in out.ravel()]
    out = [0] * (k * x.shape[1])
    for row, own in zip(x.tolist(), cluster.tolist()):
        for i, v in enumerate(row):
            out[own * x.shape[1] + i] += int(v)
    return out


def _row(ids: pa.Array, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, k: int, far: list[int] | None) -> pa.RecordBatch:
    """A block of the state."""
    number = pa.decimal128(38, 0)
    many = np.bincount(cluster, minlength=k)
    by_cluster = [0] * k
    for own, d2 in zip(cluster.tolist(), far or ()):
        by_cluster[own] += d2
    fields = [pa.array([ids.to_pylist()], pa.list_(pa.int64())), *(pa.array([a.tobytes()], pa.binary()) for a in (x, cluster, upper, lower, many)), pa.array([_sums(x, cluster, k)], pa.list_(number)), pa.array([by_cluster], pa.list_(number))]
    return pa.RecordBatch.from_arrays(fields, ["ids", "x", "cluster", "upper", "lower", "many", "sums", "far"])


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """(ids, x, cluster, upper, lower) of rows of the state."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch.column("ids")[i].values
            x, cluster, upper, lower = (np.frombuffer(batch.column(c)[i].as_py(), t).copy() for c, t in (("x", float), ("cluster", np.int64), ("upper", float), ("lower", float)))
            yield ids, x.reshape(-1, width), cluster, upper, lower


def _opened(kept: DataFrame, width: int, to: Centroids, k: int, last: bool) -> DataFrame:
    """The state after the first assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                n = part.num_rows
                x = part.column("x").flatten().to_numpy().reshape(n, width)
                cluster, upper, lower = np.full(n, -1), np.zeros(n), np.zeros(n)
                assign(x, cluster, upper, lower, to)
                yield _row(part.column("vec_id"), x, cluster, upper, lower, k, distances(x, cluster, to) if last else None)

    return kept.mapInArrow(run, _STATE)


def _moved(state: DataFrame, width: int, to: Centroids, k: int, last: bool) -> DataFrame:
    """The state for other centroids; ``last``: with distances summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, cluster, upper, lower in _blocks(batches, width):
            assign(x, cluster, upper, lower, to)
            yield _row(ids, x, cluster, upper, lower, k, distances(x, cluster, to) if last else None)

    return state.select("ids", "x", "cluster", "upper", "lower").mapInArrow(run, _STATE)


def _totals(state: DataFrame, column: str) -> list[int]:
    """The blocks' sums, position by position: as many numbers as a block has, whatever the input."""
    found = state.select(F.posexplode(column).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    return [int(r["v"]) for r in sorted(found, key=lambda r: r["i"])]


def _counts(state: DataFrame, k: int) -> list[int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                total += np.frombuffer(packed, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(total)], ["i", "v"])

    found = state.select("many").mapInArrow(run, "i long, v long").groupBy("i").agg(F.sum("v").alias("v")).collect()
    return [r["v"] for r in sorted(found, key=lambda r: r["i"])] or [0] * k


def cluster(vectors: DataFrame, *, k: int, rounds: int, components: int, seed: str, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector that :func:`whole` keeps.

    Centroids start as the ``k`` vectors with the smallest SHA-256 of
    ``seed:vec_id`` (ties by their components). Each round assigns every vector to
    the nearest centroid, ties to the smaller number, and moves each centroid that
    has vectors to the componentwise floor of their mean; then all are assigned
    once more. ``distance`` is squared; with the inertias it is null beyond 2 ** 63.
    Vectors with a null id take part, but aren't started from; rows that repeat
    an id are vectors each. With fewer than ``k`` to start from there are fewer
    clusters, and with none, or an empty table, the result is empty. Zero vectors are vectors. Other columns aren't read; a vector
    of another length, however long, isn't kept.
    """
    spark = vectors.sparkSession
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    kept = whole(vectors, id_col, vector_col, components, scale)
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.where("vec_id is not null").orderBy(mark, "x").limit(k).select("x").collect()
    if not first:
        return spark.createDataFrame([], result)
    now, before = Centroids([[int(v) for v in row["x"]] for row in first]), None
    k = len(first)
    state = written(_opened(kept, components, now, k, rounds == 0), "vectors")
    for turn in range(rounds):
        sums, many = _totals(state, "sums"), _counts(state, k)
        before = now.rows
        now = Centroids([[s // n for s in sums[i * components : (i + 1) * components]] if n else before[i] for i, n in enumerate(many)], before)
        state, old = written(_moved(state, components, now, k, turn == rounds - 1), "vectors"), state
        forget(old)
    far = _totals(state, "far")
    own = now

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, its, _, _ in _blocks(batches, components):
            d2 = [v if v < 1 << 63 else None for v in distances(x, its, own)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(its, pa.int32()), pa.array(d2, pa.int64())], ["vec_id", "cluster", "distance"])

    rows = state.select("ids", "x", "cluster", "upper", "lower").mapInArrow(ended, "vec_id long, cluster int, distance long")
    fits = lambda v: v if v < 1 << 63 else None
    about = [(i, fits(far[i]), fits(sum(far)), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for i, row in enumerate(now.rows)]
    named = spark.createDataFrame(about, "number int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(named), F.col("cluster") == F.col("number")).drop("number")  # k rows
