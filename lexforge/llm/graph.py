"""Connected components over links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexforge.session import forget, written


def components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` that isn't the smallest of its component.

    Alternates large stars and small stars: a node's larger neighbours are
    linked to its smallest one, then its smaller ones are. Both are an
    aggregation by node and a join with its one-row result, so a hub with a
    third of all links is pre-aggregated and, in the join, split by adaptive
    execution. Each round is written to the shared folder; a run ends when a
    round changes nothing. The number of rounds grows with the logarithm of the
    longest path. Null ends are ignored.
    """
    spark = links.sparkSession
    schema = "u long, v long"
    now = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "links")
    if now.isEmpty():
        return spark.createDataFrame([], "node long, root long")
    mark, large = None, None
    for _ in range(most_rounds):
        last, before = now, large
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("hub"), F.least("u", "m").alias("m"))
        large = both.join(low, both["u"] == low["hub"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "links")
        small = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("hub"), "m")
        stars = large.join(small, large["u"] == small["hub"])
        now = written(stars.select("v", "m").where("v <> m").union(small).toDF("u", "v").distinct(), "links")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(last, before)  # what this round was made from
        if state == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = state
    raise RuntimeError(f"no fixed point after {most_rounds} rounds ({schema})")
