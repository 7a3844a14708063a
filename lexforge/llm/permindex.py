"""Nearest neighbours by a permutation index.

Some vectors serve as pivots. A vector is represented by its nearest pivots in
order, and posted, with its place in that order, in the inverted file of each
of the first ``POST``. A query reads only the files of its own nearest ``READ``
pivots. What it reads adds up to the footrule of the two orders: how far apart
they have the pivots, with ``POST`` as the place of one that a vector's list
lacks. The best are reranked by the exact measure.

Vectors come in blocks and queries in blocks, and each pair of blocks is a task
of its own with its own inverted files, so none grows with the input, and
copies of one vector are spread over all blocks. Of each block ``LEAST`` vectors
for each neighbour asked for and ``SHARE`` of what it holds are reranked (ties at
the edge are all in), at every size; a share of 1 is the exact search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lexforge.session import written

#: Pivots, files that a vector is posted in, files that a query reads; vectors reranked for each neighbour asked for, and besides the share of a block.
PIVOTS, POST, READ, LEAST, SHARE = 256, 128, 64, 8, 0.16
#: Vectors of a block, and queries of a block.
BLOCK, QUERIES = 8192, 16384


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v: array of doubles), without vectors that are null, empty, zero, or have a null or non-finite component."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))


def prefixes(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """For each row its ``length`` nearest pivots (largest cosine), nearest first."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :length]


class Index:
    """The inverted files of one block of distinct vectors: for each pivot the vectors that are posted there, and the pivot's place in their lists."""

    def __init__(self, x: np.ndarray, pivots: np.ndarray, post: int, read: int):
        self.n, self.post = len(x), min(post, len(pivots))
        self.read = min(read, self.post)
        order = prefixes(x, pivots, self.post).ravel()
        by_pivot = np.argsort(order, kind="stable")
        self.start = np.searchsorted(order[by_pivot], np.arange(len(pivots) + 1))
        self.vector, self.place = (by_pivot // self.post).astype(np.int32), (by_pivot % self.post).astype(np.int16)

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """For each vector the footrule over the pivots that a query reads, less what a vector in none of their files has (so 0 for such a one)."""
        files = order[: self.read]
        low, high = self.start[files], self.start[files + 1]
        many = high - low
        at = np.arange(int(many.sum())) + np.repeat(low - (np.cumsum(many) - many), many)
        own = np.repeat(np.arange(self.read), many)
        apart = np.abs(self.place[at] - own) - (self.post - own)
        return np.bincount(self.vector[at], apart, self.n)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of one vector with rows, added from the first component to the last, so that every plan gets the same bits."""
    return np.cumsum(x * q, axis=1)[:, -1]


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, pivots: np.ndarray, *, k: int, post: int, read: int, least: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of the best ``k`` found for each query in one block. Copies of a vector are indexed once."""
    _, first, copy_of = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
    x = x[first]
    by_copy = np.lexsort((ids, copy_of))  # the ids of each vector's copies, smallest first
    start = np.searchsorted(copy_of[by_copy], np.arange(len(x) + 1))
    index, orders = Index(x, pivots, post, read), prefixes(q, pivots, read)
    many = min(len(x), least * k + int(np.ceil(share * len(x))))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(q)):
        away = index.footrule(orders[i])
        near = np.flatnonzero(away <= np.partition(away, many - 1)[many - 1])
        if len(near) > k + 1:  # one more than k, for the query's own row; the margin is for rounding
            score = x[near] @ q[i]
            edge = np.partition(score, len(near) - k - 1)[len(near) - k - 1]
            near = near[score >= edge - 1e-9 * max(1.0, abs(edge))]
        score = products(q[i], x[near])
        own = [by_copy[start[v] : start[v] + min(start[v + 1] - start[v], k + 1)] for v in near.tolist()]
        score, own = np.repeat(score, [len(o) for o in own]), ids[np.concatenate(own)]
        score, own = score[own != query_ids[i]], own[own != query_ids[i]]
        best = np.lexsort((own, -score))[:k]
        out.append((np.full(len(best), query_ids[i]), own[best], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def nearest(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, pivots: int = PIVOTS, post: int = POST, read: int = READ, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by ``every`` the ``k`` found nearest among all others, by inner product.

    Nearest first, ties to the smaller id; ``rank`` counts from 1. Vectors that
    are null, empty, zero or hold a null or non-finite component take no part,
    nor do null ids. Vectors of different lengths don't meet. Rows that repeat
    an id are candidates each, but not for a query of that id; a repeated query
    id is asked once, with the smallest of its vectors. The pivots are
    the ``pivots`` distinct vectors whose smallest ids have the smallest MD5, for
    each length; nothing else of the index is fitted. With fewer rows than ``k``
    all are returned, and none for an empty table; other columns aren't read.
    Very long vectors are vectors of another length.
    """
    rows = written(clean(vectors, id_col, vector_col).where(F.col("vec_id").isNotNull()).withColumn("dim", F.size("v")), "vectors")
    # distinct vectors, by hash, so that copies don't use up the pivots
    marked = rows.groupBy("dim", F.xxhash64("v").alias("mark")).agg(F.min("vec_id").alias("own"))
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(F.md5(F.col("own").cast("string")), "own"))
    marks = marked.withColumn("at", rank).where(F.col("at") <= pivots).select(F.col("dim").alias("d"), F.col("mark").alias("m"), "own", "at")
    first = rows.join(F.broadcast(marks), (F.col("dim") == F.col("d")) & (F.col("vec_id") == F.col("own")) & (F.xxhash64("v") == F.col("m"))).groupBy("dim", "at").agg(F.min("v").alias("v"))
    chosen: dict[int, list] = {}
    for dim, v in first.orderBy("dim", "at").select("dim", "v").collect():
        chosen.setdefault(dim, []).append(v)
    means = {dim: np.array(v) / np.linalg.norm(np.array(v), axis=1, keepdims=True) for dim, v in chosen.items()}
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-n_queries // QUERIES))
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    query_block = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(query_blocks)).cast("int")
    over = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.select("vec_id", "v", "dim", block.alias("b"), over(query_blocks).alias("qb"), F.lit(False).alias("asks"))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")).select("vec_id", "v", "dim", over(blocks).alias("b"), query_block.alias("qb"), F.lit(True).alias("asks"))

    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        asks, ids = table.column("asks").to_numpy(), table.column("vec_id").to_numpy()
        x = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        order = np.argsort(ids, kind="stable")  # rows come in any order; the result doesn't
        asks, ids, x = asks[order], ids[order], x[order]
        if asks.all() or not asks.any():
            found = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        else:
            found = search_block(ids[~asks], x[~asks], ids[asks], x[asks], means[dim], k=k, post=post, read=read, least=least, share=share)
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["query_id", "vec_id", "score"])

    best = data.union(asked).groupBy("dim", "b", "qb").applyInArrow(run, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
