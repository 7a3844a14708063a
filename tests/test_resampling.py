"""Intervals from shared draws: the same distribution as one stream of draws, and the same weights as a hash gives by hand."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.functions.hashing import bootstrap_seed
from lexforge.operators import bootstrap, resampling

R = 400


def one_stream(n, seed, resamples=R):
    return np.array(list(bootstrap.draws(n, seed, resamples)))


def made_units(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(k, i, float(a), float(b)) for k in ("c", "d") for i, (a, b) in enumerate(zip(rng.integers(1, 30, n), rng.integers(1, 5, n)))]


def frame(spark, units):
    return resampling.columns(spark.createDataFrame(units, "k string, i long, a double, b double"), "k", "i", "a", "b")


def test_parts_share_all_draws():
    sizes = np.array([5, 0, 17, 3, 40, 1])
    parts = np.array([resampling.part_draws(sizes, p, 9, 5000) for p in range(len(sizes))])
    assert (parts.sum(axis=0) == sizes.sum()).all() and (parts[1] == 0).all()
    n, p = sizes.sum(), sizes / sizes.sum()
    assert np.allclose(parts.mean(axis=1), n * p, atol=0.15)
    assert np.allclose(np.cov(parts), n * (np.diag(p) - np.outer(p, p)), atol=0.8)


def test_multinomial_parts_have_the_distribution_of_one_stream(spark):
    units = made_units(500)
    values = frame(spark, units)
    samples = {}
    for part in (1 << 16, 60):
        sums = resampling.multinomial_sums(values, values, resamples=R, part=part)
        again = resampling.multinomial_sums(values.repartition(7), values.repartition(3), resamples=R, part=part)
        rows = {(r["key"], r["resample"]): r["x"] for r in resampling.ratio(sums, "a", "b").collect()}
        assert rows == {(r["key"], r["resample"]): r["x"] for r in resampling.ratio(again, "a", "b").collect()}
        ones = resampling.ratio(resampling.multinomial_sums(values.withColumn("value", F.lit(1.0)), values, resamples=R, part=part), "a", "b").select("x").distinct().collect()
        assert [r["x"] for r in ones] == [1.0]
        for key in "cd":
            samples[key, part] = np.array([rows[key, r] for r in range(R)])
    for key in "cd":
        a, b = (np.array([u[c] for u in units if u[0] == key]) for c in (2, 3))
        weight = one_stream(500, bootstrap_seed(key))
        expected = weight @ a / (weight @ b)
        for part in (1 << 16, 60):
            own = samples[key, part]
            assert abs(own.mean() - expected.mean()) < 4 * expected.std() * math.sqrt(2 / R)
            assert 0.85 < own.std() / expected.std() < 1.18
            assert len(np.unique(own)) > R * 0.9


def test_poisson_weights_by_hand(spark):
    units = made_units(30)
    found = {(r["key"], r["item"], r["resample"]): r["total"] for r in resampling.poisson_sums(frame(spark, units), seed=5, resamples=20).collect()}
    for key in "cd":
        for r in range(20):
            u = [int(hashlib.md5(f"5|{r}|{i}".encode()).hexdigest()[:12], 16) / 2**48 for i in range(30)]
            weight = [sum(x >= e for e in resampling.poisson_edges()) for x in u]
            assert found[key, "a", r] == sum(w * x[2] for w, x in zip(weight, (x for x in units if x[0] == key)))
    weights = spark.range(20000).select(resampling.poisson_weight(1, F.lit(0), F.col("id")).alias("w")).toPandas()["w"]
    assert abs(weights.mean() - 1) < 0.03 and abs(weights.var() - 1) < 0.05


def plain_overlap(a, b):
    x, y = a / a.sum(), b / b.sum()
    return np.minimum(x, y).sum() / np.maximum(x, y).sum()


def plain_intrinsics(total, v):
    p = total[total > 0] / total.sum()
    return 0.5 * (np.abs(p - 1 / v).sum() + (v - len(p)) / v), -(p * np.log2(p)).sum() / np.log2(v), np.log2((p**2.5).sum()) / -1.5 / np.log2(v)


@pytest.mark.parametrize("kind", ["poisson", "multinomial"])
def test_joint_statistics_of_each_draw(spark, kind):
    """Both arms of a pair, and all readings of an arm, are of the same draw: known from the sums of every unit alone."""
    rng = np.random.default_rng(4)
    counts = {arm: rng.integers(0, 4, (25, 6)) for arm in "ab"}
    rows = [("k", i, (arm, f"p{j}"), int(n)) for arm, own in counts.items() for (i, j), n in np.ndenumerate(own) if n]
    values = spark.createDataFrame(rows, "key string, unit long, item struct<arm: string, piece: string>, value long")
    marks = values.select("key", "unit").distinct().select("key", "unit", F.struct(F.lit("u").alias("arm"), F.col("unit").cast("string").alias("piece")).alias("item"), F.lit(1).cast("long").alias("value"))
    both = values.unionByName(marks)
    sums = resampling.poisson_sums(both, seed=3, resamples=30) if kind == "poisson" else resampling.multinomial_sums(both, both, resamples=30, part=7)
    found = sums.collect()
    weight = np.zeros((30, 25))
    for r in found:
        if r["item"]["arm"] == "u":
            weight[r["resample"], int(r["item"]["piece"])] = r["total"]
    if kind == "multinomial":
        assert (weight.sum(axis=1) == 25).all()
    arms = spark.createDataFrame(found, sums.schema).where("item.arm <> 'u'")
    x = {r["resample"]: r["x"] for r in resampling.overlap(arms).collect()}
    one = arms.where("item.arm = 'a'").select("key", F.col("item.piece").alias("item"), "resample", "total")
    y = {r["resample"]: (r["imbalance"], r["entropy"], r["renyi"]) for r in resampling.intrinsics(one, 8).collect()}
    for r in range(30):
        a, b = weight[r] @ counts["a"], weight[r] @ counts["b"]
        assert x[r] == pytest.approx(plain_overlap(a, b)) and y[r] == pytest.approx(plain_intrinsics(a, 8))


def test_interval_ends_and_empty_cells(spark):
    samples = spark.createDataFrame([("c", r, float(r % 97), None if r % 2 else float(r)) for r in range(200)] + [("e", 0, None, None)], "key string, resample int, x double, y double")
    found = {r["key"]: r for r in resampling.intervals(samples, "x", "y").collect()}
    for name, values in (("x", sorted(float(r % 97) for r in range(200))), ("y", [float(r) for r in range(0, 200, 2)])):
        low, high = bootstrap.bounds(len(values))
        assert (found["c"][f"{name}_low"], found["c"][f"{name}_high"]) == (values[low], values[max(low, high)])
    assert found["e"]["x_low"] is None and found["e"]["y_high"] is None
    nothing = frame(spark, [(None, 1, 1.0, 1.0), ("c", None, 1.0, 1.0)])
    assert resampling.poisson_sums(nothing, seed=1, resamples=3).collect() == [] and resampling.multinomial_sums(nothing, nothing, resamples=3).collect() == []


def test_units_without_values_are_drawn_too(spark):
    units = spark.createDataFrame([("c", i) for i in range(50)], "key string, unit long")
    values = spark.createDataFrame([("c", 0, "x", None), ("c", 1, "x", 1.0), ("c", 99, "x", 5.0)], "key string, unit long, item string, value double")
    totals = [r["total"] for r in resampling.multinomial_sums(values, units, resamples=300, part=10).collect()]
    assert len(totals) == 300 and max(totals) < 9 and abs(np.mean(totals) - 1) < 0.3


def test_poisson_sums_send_a_row_for_an_item_not_for_a_unit(spark):
    """A task's rows for the shuffle are its keys and items, however many units there are."""
    values = spark.range(400).select(F.lit("c").alias("key"), F.col("id").alias("unit"), F.lit("x").alias("item"), F.lit(0).alias("value"))
    sums = resampling.poisson_sums(values, seed=2, resamples=5)
    assert [(r["item"], r["total"]) for r in sums.collect()] == [("x", 0.0)] * 5
    assert "MapInArrow" in sums._jdf.queryExecution().toString()
