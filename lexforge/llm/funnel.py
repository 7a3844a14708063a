"""Ordered funnels with exclusions, by regular expressions over session strings.

Rows of one client at one time collapse into a symbol for the set of kinds seen
then. A client's symbols in order of time are a string, and an attempt is a match
that begins at any of its symbols: after a symbol with the first step, symbols
with neither the next step nor an excluded kind, then one with the next step and
no excluded kind, and so on. As the classes are disjoint there is one way to
match, which captures the earliest steps; ``regex`` finds the overlapping ones.
The places captured give the times, and those decide on the window.

A client's time is cut into slices. A slice has a copy of what lies at most a
window after its end, as an attempt that begins in it can reach that far, and its
string is cut wherever the client is silent for longer than a window. So no task
holds a client, however many rows it has, and nothing is read twice but the edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexforge.session import written


class Funnel(NamedTuple):
    """Kinds in order, and the kinds that end an attempt."""

    name: str
    steps: tuple[str, ...]
    excluded: tuple[str, ...] = ()


#: A slice of a client's time, in windows; a share of 1 / SLICE of the rows is in two slices.
SLICE = 12
#: Microseconds of the first histogram of times; the second is of single microseconds.
COARSE = 1 << 16
#: The first symbol's code point, beyond the surrogates; a slice or a silence ends with BREAK.
_FIRST, BREAK = 0x10000, " "


def pattern(funnel: Funnel, kinds: list[str]) -> regex.Pattern:
    """What matches an attempt. A symbol of a set of kinds is the code point ``_FIRST`` plus its bits, the first kind's the lowest; group k is step k + 1's symbol."""
    masks, bit = range(1 << len(kinds)), {kind: 1 << i for i, kind in enumerate(kinds)}
    bad = sum(bit[kind] for kind in set(funnel.excluded))

    def symbols(wanted) -> str:
        found = "".join(chr(_FIRST + mask) for mask in masks if wanted(mask))
        return f"[{found}]" if found else "(?!)"

    tail = ""
    for step in reversed(funnel.steps[1:]):
        own = bit[step]
        tail = f"(?:{symbols(lambda m: not m & (own | bad))}*({symbols(lambda m: m & own and not m & bad)}){tail})?"  # noqa: B023
    return regex.compile(symbols(lambda m: m & bit[funnel.steps[0]]) + f"(?={tail})")


def found_in(text: str, funnel: Funnel, kinds: list[str]) -> np.ndarray:
    """A row for each attempt: the places of its symbols, -1 for steps that it doesn't reach."""
    n = len(funnel.steps)
    own = pattern(funnel, kinds)
    places = [[m.start(), *(m.start(k) for k in range(1, n))] for m in own.finditer(text, overlapped=True)]
    return np.array(places, np.int64).reshape(-1, n)


def micros(ts: Column, kind: str) -> Column:
    """Microseconds since 1970 of a timestamp column of the given type; without a zone it is taken as it stands."""
    if kind != "timestamp_ntz":
        return F.unix_micros(ts.cast("timestamp"))
    seconds = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return ((F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(ts)) * 60 + F.minute(ts)) * F.lit(60_000_000).cast("long") + seconds


def attempts(rows: DataFrame, funnels: list[Funnel], *, client: str = "client_id", kind: str = "kind", at: str = "arrived_at", window: int = 300_000_000, slice_windows: int = SLICE) -> DataFrame:
    """(funnel, client, start, depth, times): a row for each attempt. ``start`` is in microseconds, ``times`` has those from each step to the next, so depth - 1 of them.

    A row of the first step starts an attempt. The next step is the earliest row
    of its kind at a later time; it is reached unless that is over ``window``
    microseconds after the start, or an excluded row is later than the previous step
    and not later than the next. Rows with a null client, kind or time take no part;
    repeated rows count once. Rows of several kinds at one time are ties: none is
    later than another. An empty table has no attempts; other columns aren't read.
    """
    kinds = sorted({k for f in funnels for k in (*f.steps, *f.excluded)})
    if len(kinds) > 16:
        raise ValueError("over 16 kinds in one call: their sets would be too many for a character class")
    length = slice_windows * window
    bit = F.create_map(*(F.lit(x) for pair in ((k, 1 << i) for i, k in enumerate(kinds)) for x in pair))
    known = rows.select(F.col(client).alias("client"), micros(F.col(at), dict(rows.dtypes)[at]).alias("t"), F.col(kind).alias("kind")).where(F.col("kind").isin(kinds) & F.col("client").isNotNull() & F.col("t").isNotNull())
    own = F.floor(F.col("t") / length)
    into = F.when(F.col("t") - own * length <= window, F.array(own, own - 1)).otherwise(F.array(own))
    dealt = known.select("client", "t", F.element_at(bit, F.col("kind")).alias("bit"), F.explode(into).alias("slice")).repartition("client", "slice")
    symbols = dealt.groupBy("client", "slice", "t").agg(F.bit_or("bit").alias("mask")).sortWithinPartitions("client", "slice", "t")
    patterns = [(f, [k for k in kinds if k in (*f.steps, *f.excluded)]) for f in funnels]

    def matched(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """The attempts of whole slices."""
        t, part, mask = (table.column(c).to_numpy() for c in ("t", "slice", "mask"))
        clients = table.column("client").combine_chunks()
        code = clients.dictionary_encode().indices.to_numpy()
        cut = np.flatnonzero((code[1:] != code[:-1]) | (part[1:] != part[:-1]) | (t[1:] - t[:-1] > window)) + 1
        for funnel, its in patterns:
            small = np.zeros(len(mask), np.uint32)
            for i, k in enumerate(its):
                small |= ((mask >> kinds.index(k)) & 1).astype(np.uint32) << np.uint32(i)
            text = np.insert(small + np.uint32(_FIRST), cut, ord(BREAK)).astype("<u4").tobytes().decode("utf-32-le")
            place = found_in(text, funnel, its)
            place -= np.where(place < 0, 0, np.searchsorted(cut + np.arange(len(cut)), place))  # breaks before it
            first = place[:, 0]
            times = t[place]
            reached = (place >= 0) & (times - times[:, :1] <= window)
            depth = np.logical_and.accumulate(reached, axis=1).sum(axis=1)
            mine = (part[first] == t[first] // length) & (depth > 0)  # one in the copied edge is the next slice's
            first, times, depth = first[mine], times[mine], depth[mine]
            steps = np.diff(times, axis=1)[np.arange(1, len(funnel.steps)) < depth[:, None]]
            offsets = pa.array(np.concatenate(([0], np.cumsum(depth - 1))), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([funnel.name] * len(first), pa.string()), clients.take(pa.array(first)), pa.array(t[first]), pa.array(depth, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(steps, pa.int64()))], ["funnel", "client", "start", "depth", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by slice; what may be an unfinished one waits for the next batch."""
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            client, part = table.column("client").combine_chunks().dictionary_encode().indices.to_numpy(), table.column("slice").to_numpy()
            whole = np.flatnonzero((client != client[-1]) | (part != part[-1])) if table.num_rows else ()
            n = int(whole[-1]) + 1 if len(whole) else 0
            if n:
                yield from matched(table.slice(0, n))
            rest = table.slice(n)
        if rest is not None and rest.num_rows:
            yield from matched(rest)

    return symbols.mapInArrow(run, f"funnel string, client {dict(known.dtypes)['client']}, start long, depth int, times array<long>")


def kth_smallest(times: DataFrame, keys: list[str], value: str, percent: int) -> DataFrame:
    """For each group the ceil(percent * n / 100)-th smallest of n whole numbers from 0, as ``kth``.

    By two histograms: the first finds the interval of ``COARSE`` values that has it,
    the second looks at that interval alone. So what meets in a task is the
    values' range, not a group's rows.
    """
    spread = times.groupBy(*keys, F.floor(F.col(value) / COARSE).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    by_group = Window.partitionBy(*keys)
    upto = F.sum("n").over(by_group.orderBy("part"))
    rank = F.ceil(F.sum("n").over(by_group) * percent / 100)
    edge = spread.select(*keys, "part", "n", upto.alias("upto"), rank.alias("rank")).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))).select(*(F.col(k).alias(f"e_{k}") for k in keys), F.col("part").alias("e_part"), (F.col("rank") - F.col("upto") + F.col("n")).alias("rest"))
    same = [F.col(k) == F.col(f"e_{k}") for k in keys]
    counts = times.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    near = counts.join(edge, [*same, F.floor(F.col(value) / COARSE) == F.col("e_part")])
    below = F.sum("n").over(by_group.orderBy(value))
    return near.withColumn("below", below).where((F.col("below") >= F.col("rest")) & (F.col("below") - F.col("n") < F.col("rest"))).select(*keys, F.col(value).alias("kth"))


def counted(rows: DataFrame, funnels: list[Funnel], *, percent: int = 25, **columns) -> DataFrame:
    """For each funnel and client with attempts: n1, n2, ... that reach each step, ``deepest``, t2, t3, ... (the ``percent`` percentile of the microseconds from the step before) and ``same_depth``, the clients of equal funnel and deepest.

    See :func:`attempts` for the rules and for nulls, ties, repeats and empty tables.
    Where funnels differ in length, steps that one lacks have 0 and null.
    """
    most = max(len(f.steps) for f in funnels)
    tries = written(attempts(rows, funnels, **columns), "attempts")
    by = ["funnel", "client"]
    steps = tries.groupBy(*by).agg(*(F.count_if(F.col("depth") >= k).alias(f"n{k}") for k in range(1, most + 1)), F.max("depth").alias("deepest"))
    times = tries.select(*by, F.posexplode("times").alias("step", "time"))
    kth = kth_smallest(times, [*by, "step"], "time", percent)
    wide = kth.groupBy(*by).agg(*(F.max(F.when(F.col("step") == k - 2, F.col("kth"))).alias(f"t{k}") for k in range(2, most + 1)))
    wide = wide.select(F.col("funnel").alias("t_funnel"), F.col("client").alias("t_client"), *(f"t{k}" for k in range(2, most + 1)))
    each = written(steps.join(wide, (F.col("funnel") == F.col("t_funnel")) & (F.col("client") == F.col("t_client")), "left").drop("t_funnel", "t_client"), "funnels")
    depths = each.groupBy(F.col("funnel").alias("d_funnel"), F.col("deepest").alias("d_deepest")).agg(F.count(F.lit(1)).alias("same_depth"))
    return each.join(F.broadcast(depths), (F.col("funnel") == F.col("d_funnel")) & (F.col("deepest") == F.col("d_deepest"))).drop("d_funnel", "d_deepest")  # a row for each funnel and depth
