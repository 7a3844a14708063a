"""Order statistics of intervals, and the draws of one small cell by either generator.

What a cell of any size needs is in :mod:`lexforge.operators.resampling`; the
draws here are one stream from a seed, whose values are fixed.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, functions as F

RESAMPLES, LEVEL = 1000, 0.95


def bounds(n: int, level: float = LEVEL) -> tuple[int, int]:
    """The places, from 0, of an interval's ends among ``n`` sorted resamples."""
    tail = (1 - level) / 2
    low = min(n - 1, int(tail * n))
    return low, max(0, min(n - 1, int((1 - tail) * n) - 1))


def places(n: Column, level: float = LEVEL) -> tuple[Column, Column]:
    """:func:`bounds` of a column of sizes."""
    tail = (1 - level) / 2
    at = lambda share: F.floor(n * F.lit(share))
    return F.least(n - 1, at(tail)), F.greatest(F.lit(0), F.least(n - 1, at(1 - tail) - 1))


def percentile_interval(samples: Column, n: int, level: float = LEVEL) -> Column:
    """(low, high) of an array of ``n`` resamples, by order statistics; null for none."""
    if n == 0:
        return F.lit(None).cast("struct<low:double,high:double>")
    low, high = bounds(n, level)
    at = F.array_sort(samples)
    return F.struct(F.get(at, F.lit(low)).alias("low"), F.get(at, F.lit(max(low, high))).alias("high"))


def draws(n: int, seed: int, resamples: int, generator: str = "numpy") -> Iterator[np.ndarray]:
    """How often each of ``n`` units is drawn, for each resample, by numpy's generator or the standard library's."""
    if generator not in ("numpy", "stdlib"):
        raise ValueError("generator: numpy or stdlib")
    if generator == "numpy":
        rng = np.random.default_rng(seed)
        yield from (np.bincount(rng.integers(0, n, n), minlength=n) for _ in range(resamples))
    else:
        pick = random.Random(seed).randrange
        yield from (np.bincount(np.fromiter((pick(n) for _ in range(n)), np.int64, n), minlength=n) for _ in range(resamples))


def ratio_interval(numerator: np.ndarray, denominator: np.ndarray, seed: int, resamples: int = RESAMPLES, level: float = LEVEL, generator: str = "numpy") -> tuple[float, float]:
    """The interval of sum over sum, resampling units; resamples whose denominator is 0 are left out."""
    if len(numerator) != len(denominator):
        raise ValueError("as many numerators as denominators are needed")
    if not len(numerator):
        return math.nan, math.nan
    found = []
    for weight in draws(len(numerator), seed, resamples, generator):
        if below := float(weight @ denominator):
            found.append(float(weight @ numerator) / below)
    if not found:
        return math.nan, math.nan
    found.sort()
    low, high = bounds(len(found), level)
    return found[low], found[max(low, high)]


def mean_interval(values: np.ndarray, seed: int, resamples: int = RESAMPLES, level: float = LEVEL) -> tuple[float, float]:
    return ratio_interval(values, np.ones(len(values)), seed, resamples, level)
