"""Incremental deposits: what is fresh is skipped, what is missing or stale is computed and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def fresh_block(training: Column, current_training: Column, evaluation: Column | None = None, current_evaluation: Column | None = None) -> Column:
    """Whether an arm's record was made from the current training set (and held-out split, for measures that use one)."""
    ok = training.eqNullSafe(current_training)
    return ok if evaluation is None else ok & evaluation.eqNullSafe(current_evaluation)


def fresh_pair(*blocks: tuple[Column, Column]) -> Column:
    """From (present, fresh) of the arms: whether all that are present are fresh. No arm at all isn't fresh."""
    some, all_fresh = F.lit(False), F.lit(True)
    for present, ok in blocks:
        some, all_fresh = some | present, all_fresh & (~present | F.coalesce(ok, F.lit(False)))
    return some & all_fresh


def fresh_within_arm(matched: Column, blocks: list[tuple[Column, Column]]) -> Column:
    """As :func:`fresh_pair`; a matched pair needs both arms."""
    both = F.lit(True)
    for present, _ in blocks:
        both = both & present
    return fresh_pair(*blocks) & (~matched | both)


def stale(registry: DataFrame, deposits: DataFrame, key: str, fresh: Column, *, rebuild: bool = False, only: list[str] | None = None) -> DataFrame:
    """The registered rows that have to be computed."""
    asked = registry if only is None else registry.where(F.col(key).isin(only))
    return asked if rebuild else asked.join(deposits.where(fresh).select(key), key, "left_anti")


def deposit(registry: DataFrame, deposits: DataFrame, key: str, fresh: Column, compute: Callable[[DataFrame], DataFrame], *, rebuild: bool = False, only: list[str] | None = None) -> DataFrame:
    """Deposits brought up to date: computed rows take the place of stale ones, the rest stays as it is."""
    made = compute(stale(registry, deposits, key, fresh, rebuild=rebuild, only=only))
    return deposits.join(made.select(key), key, "left_anti").unionByName(made, allowMissingColumns=True)


def pending(registry: DataFrame, deposits: DataFrame, key: str) -> DataFrame:
    """Registered keys without a record."""
    return registry.select(key).join(deposits.select(key), key, "left_anti")


def violations(records: DataFrame, key: str, ok: Column) -> DataFrame:
    """The keys of records that break a roll-up's rule."""
    return records.where(~F.coalesce(ok, F.lit(False))).select(key).orderBy(key)


def measurement(deadzone: DataFrame, jaccard: DataFrame, fertility: DataFrame, distribution: DataFrame, absorption: DataFrame, scaffold: DataFrame, segmentation: DataFrame, key: str = "pair_key") -> DataFrame:
    """The seven measures by pair: dead zones lead, the next three have to be there, the last three may be missing."""
    for required in (jaccard, fertility, distribution):
        deadzone = deadzone.join(required, key)
    for optional in (absorption, scaffold, segmentation):
        deadzone = deadzone.join(optional, key, "left")
    return deadzone


def cross_axis(jaccard: DataFrame, fertility: DataFrame, distribution: DataFrame, key: str = "pair_key") -> DataFrame:
    """Three measures of the pairs that have all of them."""
    return jaccard.join(fertility, key).join(distribution, key)


def cell_table(registry: DataFrame, deposits: DataFrame, flag: Column) -> DataFrame:
    """Registered cells with their deposits: flagged, or pending where there is none, in order."""
    joined = registry.join(deposits.withColumn("_there", F.lit(True)), "cell_id", "left")
    return joined.withColumn("pending", F.col("_there").isNull()).withColumn("flagged", F.coalesce(flag, F.lit(False))).drop("_there").orderBy("corpus", "algo", "v", "boundary")
