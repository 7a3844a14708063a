"""Bootstrap intervals of any statistic that is made from sums, with every draw shared by all of its sums.

Values are long: (key, unit, item, value), key being a cell and item what is summed:
a piece, a column's name, an arm's piece. ``sums`` gives one row for each cell, item and
resample, and everything after that is an aggregation: a ratio of two items, the
overlap of two arms, the entropy of a distribution. Both arms of a pair, and both
readings of an arm, see the same draw.

Two ways to draw. ``multinomial``: each resample draws as many units as there are, with
replacement. A cell is dealt out over parts, and how many draws fall to a part is
decided by binomial splits of the parts in two, made from the seed alone, so
every part finds its own number by itself; then it draws among its units. ``poisson``:
each unit has a weight of its own, from a hash of the seed, the resample and the
unit, which any SQL engine can make too; another estimator of the same interval.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexforge.functions.arrays import let
from lexforge.functions.batches import parts as few
from lexforge.functions.hashing import bootstrap_seed
from lexforge.operators.bootstrap import LEVEL, RESAMPLES, places

#: Units of a part, about.
PART = 1 << 16
#: Units whose weights are held at a time, and values that are weighted at a time.
BLOCK = 1 << 10
#: Poisson weights go up to this; the chance of more is 1e-10.
MOST_WEIGHT = 12


def part_draws(sizes: np.ndarray, part: int, seed: int, resamples: int) -> np.ndarray:
    """How many of a cell's draws fall to a part, for each resample: the cell's units are halved between parts until one is left."""
    upto = np.concatenate(([0], np.cumsum(sizes)))
    low, high, n = 0, len(sizes), np.full(resamples, upto[-1])
    while high - low > 1:
        mid, whole = (low + high) // 2, upto[high] - upto[low]
        left = np.random.default_rng([seed, 1, low, high]).binomial(n, (upto[mid] - upto[low]) / whole if whole else 0.0)
        n, low, high = (left, low, mid) if part < mid else (n - left, mid, high)
    return n


def part_sums(sizes: np.ndarray, part: int, seed: int, resamples: int, unit: np.ndarray, item: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The sums of a part: a row for each resample, a column for each item. ``unit`` and ``item`` are numbers from 0."""
    n_units, n_items = int(sizes[part]), int(item.max(initial=-1)) + 1
    own, out = np.random.default_rng([seed, 2, part]), np.zeros((resamples, n_items))
    for k, draws in enumerate(part_draws(sizes, part, seed, resamples).tolist()):
        weight = np.bincount(own.integers(0, n_units, draws), minlength=n_units)
        out[k] = np.bincount(item, weight[unit] * value, n_items)
    return out


def multinomial_sums(values: DataFrame, units: DataFrame, *, offset: int = 0, resamples: int = RESAMPLES, part: int = PART) -> DataFrame:
    """(key, item, resample, total) from values (key, unit, item, value) and units (key, unit).

    All distinct units of a cell are drawn from, with values or without; a value whose
    unit isn't among them isn't seen, a null value counts as 0. A cell's seed comes
    from its name and the offset. Results don't depend on the order or partitions
    of the input, but for the last bits of sums of fractions.
    """
    ask = units.select(F.col("key"), F.col("unit")).where(F.col("key").isNotNull() & F.col("unit").isNotNull()).distinct()
    parts = ask.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / part).alias("parts"))
    own = F.pmod(F.xxhash64("unit"), F.col("parts")).cast("int")
    dealt = ask.join(parts, "key").groupBy("key", own.alias("part")).agg(F.array_sort(F.collect_list("unit")).alias("units"))
    sized = dealt.groupBy("key").agg(F.collect_list(F.struct("part", F.size("units").alias("n"))).alias("sizes"))
    drawn = dealt.join(sized, "key").join(parts, "key").select(F.col("key").alias("cell"), F.col("part").alias("of"), "units", "sizes", "parts")
    its = values.select("key", "unit", "item", "value").join(parts, "key").withColumn("part", own).groupBy("key", "part", "unit", "item").agg(F.sum(F.coalesce(F.col("value").cast("double"), F.lit(0.0))).alias("value"))
    kinds = dict(its.dtypes)

    def run(table: pa.Table, units_of: pa.Table) -> pa.Table:
        row = units_of.slice(0, 1)
        none = [pa.array([], t) for t in (table.schema.field("key").type, table.schema.field("item").type, pa.list_(pa.float64()))]
        if not table.num_rows or not units_of.num_rows:
            return pa.table(none, ["key", "item", "totals"])
        sizes = np.zeros(row.column("parts")[0].as_py(), np.int64)
        for x in row.column("sizes")[0].as_py():
            sizes[x["part"]] = x["n"]
        number = {u: i for i, u in enumerate(row.column("units")[0].as_py())}
        unit = np.array([number.get(u, -1) for u in table.column("unit").to_pylist()], np.int64)
        table, unit = table.filter(pa.array(unit >= 0)), unit[unit >= 0]
        items, codes = table.column("item").combine_chunks(), {}
        item = np.array([codes.setdefault(tuple(x.values()) if isinstance(x, dict) else x, len(codes)) for x in items.to_pylist()], np.int64)
        key = row.column("cell")[0].as_py()
        sums = part_sums(sizes, row.column("of")[0].as_py(), (bootstrap_seed(str(key)) + offset), resamples, unit, item, table.column("value").to_numpy())
        names = items.take(pa.array(np.unique(item, return_index=True)[1]))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1) * resamples, pa.int32()), pa.array(np.ascontiguousarray(sums[:, : len(names)].T).ravel()))
        return pa.table([pa.array([key] * len(names), table.schema.field("key").type), names, flat], ["key", "item", "totals"])

    made = its.groupBy("key", "part").cogroup(drawn.groupBy("cell", "of")).applyInArrow(run, f"key {kinds['key']}, item {kinds['item']}, totals array<double>")
    return made.select("key", "item", F.posexplode("totals").alias("resample", "total")).groupBy("key", "item", "resample").agg(F.sum("total").alias("total"))


def poisson_weight(seed: int, resample: Column, unit: Column) -> Column:
    """0, 1, 2 ... with the chances of a Poisson number of mean 1, from an MD5."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), resample.cast("string"), unit.cast("string"))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    return let(u, lambda x: sum(((x >= e).cast("int") for e in poisson_edges()), F.lit(0)))


def poisson_edges() -> list[float]:
    """Where the weight grows by one."""
    edges, total, p = [], 0.0, math.exp(-1)
    for k in range(MOST_WEIGHT):
        total += p
        edges.append(total)
        p /= k + 1
    return edges


def _weights(seed: int, unit: str, resamples: int) -> bytes:
    """The first 48 bits of each resample's MD5, as :func:`poisson_weight` has them, in eight bytes each."""
    return b"".join(b"\0\0" + hashlib.md5(f"{seed}|{r}|{unit}".encode(), usedforsecurity=False).digest()[:6] for r in range(resamples))


def _weighted(rows_of: pa.Table, seed: int, resamples: int) -> np.ndarray:
    """From rows (unit, cell, value): a row for each cell number, a column for each resample."""
    edges = np.array(poisson_edges())
    units = rows_of.column("unit").combine_chunks().dictionary_encode()
    names, unit = units.dictionary.to_pylist(), units.indices.to_numpy()
    cell, value = rows_of.column("cell").to_numpy(), rows_of.column("value").to_numpy()
    out = np.zeros((int(cell.max(initial=-1)) + 1, resamples))
    order = np.argsort(unit, kind="stable")
    unit, cell, value = unit[order], cell[order], value[order]
    for at in range(0, len(names), BLOCK):  # weights of so many units at a time
        own = names[at : at + BLOCK]
        drawn = np.frombuffer(b"".join(_weights(seed, u, resamples) for u in own), ">u8").reshape(len(own), resamples).astype(float) / float(1 << 48)
        weight = np.searchsorted(edges, drawn.ravel(), side="right").reshape(drawn.shape).astype(float)
        low, high = np.searchsorted(unit, [at, at + len(own)])
        for i in range(low, high, 4 * BLOCK):
            rows = slice(i, min(high, i + 4 * BLOCK))
            cells, which = np.unique(cell[rows], return_inverse=True)
            dense = np.zeros((len(cells), len(own)))
            np.add.at(dense, (which, unit[rows] - at), value[rows])
            out[cells] += dense @ weight
    return out


def poisson_sums(values: DataFrame, *, seed: int, resamples: int = RESAMPLES) -> DataFrame:
    """(key, item, resample, total) from values (key, unit, item, value), by Poisson weights.

    A unit's values are weighted where they are, and its weights are made once; a task sends a row for each key and item of a batch, with
    sums of all resamples. Null keys and units take no part, a null value counts as 0, and resamples in which none of an
    item's units has a weight have no row. Units without values need not be known.
    """
    spark = values.sparkSession
    each = F.struct("item", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    # a unit's rows are few bytes and much work, so tasks aren't put together by size
    dealt = values.where(F.col("key").isNotNull() & F.col("unit").isNotNull()).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "unit")
    own = dealt.groupBy("key", "unit").agg(F.collect_list(each).alias("values")).select("key", F.col("unit").cast("string").alias("unit"), "values")
    kinds = dict(values.dtypes)
    most = max(1, (1 << 23) // resamples)  # values of a part, so that its sums have a bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for lists in few(batch.column("values"), most):
                yield told(batch.slice(at, len(lists)), lists)
                at += len(lists)

    def told(batch: pa.RecordBatch, lists: pa.ListArray) -> pa.RecordBatch:
        row = pa.array(np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()))
        key, unit = batch.column("key").take(row), batch.column("unit").take(row)
        items, value = lists.flatten().field("item"), lists.flatten().field("value")
        cell = np.zeros(len(row), np.int64)
        for column in (key, *(items.flatten() if pa.types.is_struct(items.type) else [items])):
            coded = column.dictionary_encode()
            cell = cell * (len(coded.dictionary) + 1) + coded.indices.fill_null(len(coded.dictionary)).to_numpy()
        _, first, cell = np.unique(cell, return_index=True, return_inverse=True)
        table = pa.table({"unit": unit, "cell": cell, "value": value})
        sums = _weighted(table, seed, resamples)
        ones = table.set_column(2, "value", pa.array(np.ones(len(cell))))
        seen = sums if (value.to_numpy() > 0).all() else _weighted(ones, seed, resamples)
        nested = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * resamples), pa.array(x.ravel()))
        at = pa.array(first)
        return pa.RecordBatch.from_arrays([key.take(at), items.take(at), nested(sums), nested((seen > 0).astype(np.int8))], ["key", "item", "totals", "seen"])

    made = own.mapInArrow(run, f"key {kinds['key']}, item {kinds['item']}, totals array<double>, seen array<tinyint>")
    found = made.select("key", "item", F.posexplode(F.arrays_zip("totals", "seen")).alias("resample", "x")).where("x.seen > 0")
    return found.groupBy("key", "item", "resample").agg(F.sum("x.totals").alias("total"))


def ratio(sums: DataFrame, numerator: str, denominator: str, name: str = "x") -> DataFrame:
    """(key, resample, x): one item's total over another's; null where that is 0."""
    of = lambda item: F.sum(F.when(F.col("item") == item, F.col("total")))
    return sums.groupBy("key", "resample").agg(F.try_divide(F.coalesce(of(numerator), F.lit(0.0)), of(denominator)).alias(name))


def overlap(sums: DataFrame, name: str = "x") -> DataFrame:
    """(key, resample, x) from items (arm, piece) of arms a and b: the weighted Jaccard of their distributions; null where an arm is empty."""
    by_piece = sums.groupBy("key", "resample", F.col("item.piece").alias("piece")).agg(*(F.coalesce(F.sum(F.when(F.col("item.arm") == arm, F.col("total"))), F.lit(0.0)).alias(arm) for arm in ("a", "b")))
    whole = by_piece.groupBy("key", "resample").agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    x, y = F.col("a") / F.col("all_a"), F.col("b") / F.col("all_b")
    return by_piece.join(whole.where("all_a > 0 and all_b > 0"), ["key", "resample"]).groupBy("key", "resample").agg((F.sum(F.least(x, y)) / F.sum(F.greatest(x, y))).alias(name))


def intrinsics(sums: DataFrame, vocabulary: int) -> DataFrame:
    """(key, resample, imbalance, entropy, renyi) of the items' distribution, for a vocabulary of a fixed size; all three from one draw."""
    whole = sums.groupBy("key", "resample").agg(F.sum("total").alias("whole"))
    p, v = F.col("total") / F.col("whole"), F.lit(float(vocabulary))
    found = sums.where("total > 0").join(whole.where("whole > 0"), ["key", "resample"]).groupBy("key", "resample").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs(p - 1 / v)).alias("apart"), (-F.sum(p * F.log2(p)) / F.log2(v)).alias("entropy"), (F.log2(F.sum(F.pow(p, F.lit(2.5)))) / F.lit(-1.5) / F.log2(v)).alias("renyi"),
    )
    return found.select("key", "resample", (0.5 * (F.col("apart") + (v - F.col("n")) / v)).alias("imbalance"), "entropy", "renyi")


def intervals(samples: DataFrame, *names: str, level: float = LEVEL) -> DataFrame:
    """(key, <name>_low, <name>_high, ...) by order statistics; resamples where a statistic is null are left out, a cell without any has nulls."""
    lists = samples.groupBy("key").agg(*(F.array_sort(F.collect_list(n)).alias(n) for n in names))

    def ends(name: str) -> list[Column]:
        low, high = places(F.size(name), level)
        at = lambda place: F.when(F.size(name) > 0, F.get(F.col(name), place.cast("int")))
        return [at(low).alias(f"{name}_low"), at(F.greatest(low, high)).alias(f"{name}_high")]

    return lists.select("key", *(c for n in names for c in ends(n)))


def columns(units: DataFrame, key: str, unit: str, *names: str) -> DataFrame:
    """Statistics of units, a column each, as values: (key, unit, item, value), the item being the column's name."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("item"), F.col(n).cast("double").alias("value")) for n in names)))
    return units.select(F.col(key).alias("key"), F.col(unit).alias("unit"), each.alias("v")).select("key", "unit", "v.item", "v.value")
