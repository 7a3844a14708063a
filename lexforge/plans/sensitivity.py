"""Sensitivity ladders and interaction grids over measured cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexforge.operators.emission import relative_gap
from lexforge.session import written


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """From (cell, piece) of two arms, for each cell x of the one and y of the other: (x, y, shared, n_x, n_y, jaccard). Cells without pieces have no rows.

    A piece is one row with the cells that have it, and equal sets of cells are counted
    together: what grows with the cells' pairs are sets, and no task has all pieces of a cell.
    """
    told = lambda d, own: d.select("piece", *[(F.col("cell") if c == own else F.lit(None)).alias(c) for c in ("x", "y")])
    rows = told(a, "x").withColumn("y", F.col("x")) if a is b else told(a, "x").union(told(b, "y"))
    cells = lambda c: F.array_sort(F.collect_list(c)).alias(f"{c}s")
    sets = rows.distinct().groupBy("piece").agg(cells("x"), cells("y")).groupBy("xs", "ys").agg(F.count(F.lit(1)).alias("n"))
    # the pair of a cell and null stands for the cell alone
    with_none = lambda c: F.concat(F.col(c), F.array(F.lit(None)))
    each = sets.select("n", "ys", F.explode(with_none("xs")).alias("x")).select("n", "x", F.explode(with_none("ys")).alias("y")).groupBy("x", "y").agg(F.sum("n").alias("n"))
    each = written(each, "overlaps")  # a row a pair of cells
    alone = lambda c, other: each.where(F.col(c).isNotNull() & F.col(other).isNull()).select(c, F.col("n").alias(f"n_{c}"))
    both = alone("x", "y").crossJoin(alone("y", "x")).join(each.where("x is not null and y is not null").withColumnRenamed("n", "shared"), ["x", "y"], "left").na.fill(0, ["shared"])
    return both.select("x", "y", "shared", "n_x", "n_y", (F.col("shared") / (F.col("n_x") + F.col("n_y") - F.col("shared"))).alias("jaccard"))


def contrasts(swept: DataFrame, references: DataFrame, on: list[str], found: DataFrame | None = None) -> DataFrame:
    """Each swept cell against its reference arm: Jaccard of their pieces and the relative gap of fertility.

    Pieces are arrays, or :func:`overlaps` of the cells, which both tables then name in ``cell``.
    """
    given = F.col("pieces" if found is None else "cell")
    ref = references.select(*on, given.alias("_ref"), F.col("fertility").alias("ref_fertility"))
    both = swept.join(ref, on, "left").withColumn("fertility_gap", relative_gap(F.col("ref_fertility"), F.col("fertility"))).drop("ref_fertility")
    if found is None:
        shared, union = F.size(F.array_intersect("pieces", "_ref")), F.size(F.array_union("pieces", "_ref"))
        return both.withColumn("jaccard", F.try_divide(shared, union)).drop("pieces", "_ref")
    return _placed(both, "cell", "_ref", found).drop("cell", "_ref")


def _placed(pairs: DataFrame, x: str, y: str, found: DataFrame) -> DataFrame:
    """Pairs of cells with their Jaccard: 0 if one has no pieces, null if neither has."""
    sizes = found.groupBy(F.col("x").alias("_x")).agg(F.max("n_x").alias("_nx")), found.groupBy(F.col("y").alias("_y")).agg(F.max("n_y").alias("_ny"))
    own = found.select(F.col("x").alias("_fx"), F.col("y").alias("_fy"), "jaccard")
    told = pairs.join(own, (F.col(x) == F.col("_fx")) & (F.col(y) == F.col("_fy")), "left").join(sizes[0], F.col(x) == F.col("_x"), "left").join(sizes[1], F.col(y) == F.col("_y"), "left")
    some = (F.col("_nx").isNotNull() | F.col("_ny").isNotNull()) & F.col(x).isNotNull() & F.col(y).isNotNull()
    return told.withColumn("jaccard", F.coalesce("jaccard", F.when(some, 0.0))).drop("_fx", "_fy", "_x", "_y", "_nx", "_ny")


def reference_of(overrides: DataFrame, cells: DataFrame, on: list[str]) -> DataFrame:
    """The BPE reference of each cell: the one listed for it, else the one of its coordinate (column default_ref)."""
    return cells.join(overrides.withColumnRenamed("bpe_cell_id", "_listed"), on, "left").withColumn("bpe_cell_id", F.coalesce("_listed", "default_ref")).drop("_listed")


def ladder(anchor: DataFrame, rungs: DataFrame, default: float, value: Column) -> DataFrame:
    """A curve: the anchor at its default value, and the swept rungs, by value."""
    return anchor.withColumn("x", F.lit(float(default))).unionByName(rungs.withColumn("x", value.cast("double"))).withColumn("is_default", F.col("x") == float(default)).orderBy("x")


def surface(parts: list[tuple[DataFrame, Column, Column]]) -> DataFrame:
    """An interaction grid from its interior, its two ladders and its anchor, each with where it lies: (x, y, the measures)."""
    placed = [df.withColumn("x", x.cast("double")).withColumn("y", y.cast("double")) for df, x, y in parts]
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out.orderBy("y", "x")


def crossing(a: DataFrame, b: DataFrame, pieces_a: DataFrame | None = None, pieces_b: DataFrame | None = None) -> DataFrame:
    """Every rung of one arm against every rung of the other: both are a handful of rows. Columns: rung, fertility, and pieces, unless these come as tables of (rung, piece)."""
    listed = lambda d: d.select("rung", F.explode("pieces").alias("piece"))
    own = [(listed(d) if given is None else given).select(F.col("rung").alias("cell"), "piece") for d, given in ((a, pieces_a), (b, pieces_b))]
    same = (pieces_a is not None and pieces_a is pieces_b) or (pieces_a is None and pieces_b is None and a is b)
    left = a.select(F.col("rung").alias("y"), F.col("fertility").alias("fa"))
    right = b.select(F.col("rung").alias("x"), F.col("fertility").alias("fb"))
    found = overlaps(own[0], own[0] if same else own[1]).select(F.col("x").alias("y"), F.col("y").alias("x"), F.col("n_x").alias("n_y"), F.col("n_y").alias("n_x"), "jaccard")
    return _placed(left.crossJoin(right), "x", "y", found).select("x", "y", "jaccard", relative_gap(F.col("fa"), F.col("fb")).alias("fertility_gap"))


def robustness(redraws: DataFrame, sweep: DataFrame) -> DataFrame:
    """Clearances by corpus and arm, redraws in the order of their numbers, and the sweep in the order of sizes."""
    number = F.regexp_extract("label", r"(\d+)", 1).cast("int")
    listed = lambda d, n: d.groupBy("corpus", "algo").agg(F.transform(F.array_sort(F.collect_list(F.struct(number.alias("at"), F.col("value").alias("v")))), lambda x: x["v"]).alias(n))
    both = listed(redraws, "redraws").join(listed(sweep, "sweep"), ["corpus", "algo"], "full_outer")
    return both.withColumn("spread", F.array_max("redraws") - F.array_min("redraws"))
