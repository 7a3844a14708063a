"""Mixing sources to target weights by hash thresholds, without a sort.

Sizes are summed by source and hash bucket. In each source the buckets below
the one where the running sum passes the budget are in, those above are out;
only that boundary bucket is looked into further, by the next bits of the hash,
until the budget lies between two hash values. A larger budget has a larger
threshold, so mixes are nested. The histograms have at most ``2 ** bits`` rows
a source, whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexforge.session import written

#: Hash bits of a level, and the number of levels: 48 bits of the hash are used.
BITS, LEVELS = 12, 4
#: A word, as in the whole subpackage: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """From (source, size): (source, source_size, target), one row a source.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    the sum of all sizes. No target is above ``most`` times its source's size:
    what is over is shared by weight among the others, until none is above.
    The fixed point is min(most * size, level * weight), with the level at which
    the targets sum to everything; it is found from running sums over the
    sources in order of size over weight. One row a source goes through it.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(order) - 1
    weighed = totals.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights)).cast("int")))
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    staged = weighed.select(
        "source", "source_size", "weight",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("capped"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("capped_weight"),
    )
    # with the sources before this one at their caps, the level of the rest; the first source that stays below its cap at that level fixes it
    level = (F.col("total") - most * F.col("capped")) / (F.col("all_weight") - F.col("capped_weight"))
    staged = staged.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= most * F.col("source_size"))
    staged = staged.withColumn("final", F.min_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.col("capped_weight"))).over(everything))
    target = F.when(F.col("final").isNull(), most * F.col("source_size")).otherwise(F.least(most * F.col("source_size"), F.col("final") * F.col("weight")))
    return staged.select("source", "source_size", target.cast("double").alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _hash(id_col: str, text_col: str) -> Column:
    """The first 48 bits of the MD5 of ``id|text``, a hash that other engines have too; nulls are empty."""
    both = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def source_limits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, hash) of every document, and the mix as one row a source: own, source_size, target, whole, bound.

    A document is taken ``whole`` times, and once more if its hash is below ``bound``.
    """
    narrow = written(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"), _hash(id_col, text_col).alias("hash")),
        "mix-sizes",
    )
    targets = source_targets(narrow, weights=weights, most=most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    state = written(state.withColumn("below", F.lit(0.0)).withColumn("prefix", F.lit(0).cast("long")), "mix-state")
    for at in range(LEVELS):
        left = BITS * (LEVELS - 1 - at)
        edge = state.select(F.col("source").alias("own"), "prefix")
        inside = narrow.join(edge, _same("source", "own") & (F.shiftrightunsigned("hash", left + BITS) == F.col("prefix"))) if at else narrow
        sums = inside.groupBy("source", F.shiftrightunsigned("hash", left).alias("bucket")).agg(F.sum("size").alias("size"))
        upto = sums.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))).withColumnRenamed("source", "own")
        # the boundary bucket is the first whose running sum passes the rest; there is none if everything fits
        found = upto.join(state.select("source", "rest", "below"), _same("own", "source")).where(F.col("below") + F.col("upto") > F.col("rest"))
        found = found.groupBy("own").agg(F.min_by(F.struct("bucket", (F.col("below") + F.col("upto") - F.col("size")).alias("sum"), "size"), F.col("bucket")).alias("edge"))
        state = state.join(found, _same("source", "own"), "left").select(
            "source", "source_size", "target", "whole", "rest",
            F.coalesce(F.col("edge.sum"), F.col("below")).alias("below"),
            F.coalesce(F.col("edge.bucket"), F.shiftleft("prefix", BITS) if at else F.lit(-1)).cast("long").alias("prefix"),
            F.col("edge.size").alias("edge_size"),
        )
        state = written(state, "mix-state")
    # what has the edge's hash is in if that comes nearer; with no edge the rest is the whole source, or nothing
    more = F.coalesce(F.col("below") + F.col("edge_size") - F.col("rest") <= F.col("rest") - F.col("below"), F.lit(False))
    bound = F.when(F.col("prefix") < 0, F.when(F.col("rest") > 0, F.lit(1 << BITS * LEVELS)).otherwise(0)).otherwise(F.col("prefix") + more.cast("long"))
    return narrow, state.select(F.col("source").alias("own"), "source_size", "target", "whole", bound.cast("long").alias("bound"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """For each row of ``docs``: doc_id, source, size, source_size, target and times, how often the mix takes it.

    Each document is taken floor(target / source_size) times, and once more if
    its hash is below its source's threshold; the threshold is where the sum
    comes nearest to the rest of the target. So no document is taken more than
    ``most`` times, and a source's sum misses its target by at most half of one
    document (or of a group of repeated rows, which share a hash). A null text
    has size 0, as has an empty one; a null source is a source of its own. The
    hash is of id and text, so reruns agree; texts of any length are counted
    whole. Other columns are ignored. An empty table gives an empty result. The
    targets come from windows over one row a source, which one task sorts: that
    holds for some millions of sources, not for one a document.
    """
    narrow, limits = source_limits(docs, **options)
    times = F.col("whole") + (F.col("hash") < F.col("bound")).cast("long")
    return narrow.join(limits, _same("source", "own")).select("doc_id", "source", "size", "source_size", "target", times.alias("times"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; rows that it takes 0 times are gone.

    All columns stay, whatever their names, in no set order; nulls, repeats, ties
    and long texts are as :func:`mix` has them.
    """
    names = {"id_col": "doc_id", "text_col": "text", "source_col": "source"} | options
    _, limits = source_limits(docs, **options)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[names["source_col"]].cast("string").alias("source"), _hash(names["id_col"], names["text_col"]).alias("hash"))
    times = F.col("whole") + (F.col("hash") < F.col("bound")).cast("long")
    kept = packed.join(limits, _same("source", "own")).select("row", times.cast("int").alias("times")).where("times > 0")
    return kept.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("copy")).select("row.*")
