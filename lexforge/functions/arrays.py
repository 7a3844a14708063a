"""Sums over arrays in a row, without leaving the row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _after(sizes: Column, first: Column) -> Column:
    """``first`` plus the sum of what is before, for each element. It costs the square of their number."""
    grown = F.aggregate(
        sizes,
        F.struct(first.cast("int").alias("at"), F.array().cast("array<int>").alias("all")),
        lambda s, x: F.struct((s["at"] + x).cast("int").alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")),
    )
    return grown["all"]


def starts(sizes: Column) -> Column:
    """For each of some integers the sum of those before it.

    An array that grows by one element is copied each time, so sums are made in
    blocks, as many as a block has elements: n of them cost n to the power 1.5. No
    elements give an empty array, null gives null.
    """

    def summed(all_: Column) -> Column:
        n = F.size(all_)
        step = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
        count = F.greatest(F.ceil(n / step).cast("int"), F.lit(1))
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(all_, k * step + 1, step))
        return let(blocks, placed)

    def placed(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: (s + x).cast("int")))
        return F.flatten(F.zip_with(blocks, _after(sums, F.lit(0)), _after))

    return let(sizes, lambda all_: F.when(all_.isNotNull(), summed(all_)))
