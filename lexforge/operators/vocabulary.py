"""Vocabularies compared: overlap, membership, shape and closure. A piece is an array of glyphs; two pieces are the same if their arrays are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexforge.functions.lexing import piece_class, surface
from lexforge.operators import parts
from lexforge.session import written


def _sides(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, a, b): which sides each key is on. One shuffle of what each task has once, and no join; null is a key like any other."""
    told = [d.select(key, F.lit(of_a).alias("a"), F.lit(not of_a).alias("b")) for d, of_a in ((a, True), (b, False))]
    return told[0].union(told[1]).groupBy(key).agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))


def jaccard(a: DataFrame, b: DataFrame, key: str = "piece") -> DataFrame:
    """n_a, n_b, shared and the share of the union; null for two empty sets."""
    counts = _sides(a, b, key).agg(F.count_if("a").alias("n_a"), F.count_if("b").alias("n_b"), F.count_if(F.col("a") & F.col("b")).alias("shared"))
    return counts.withColumn("jaccard", F.try_divide(F.col("shared"), F.col("n_a") + F.col("n_b") - F.col("shared")))


def normalized(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """Counts as shares of their group's sum; none for a group whose sum is 0."""
    total = counts.groupBy(*by).agg(F.sum(n).alias("_total")) if by else counts.agg(F.sum(n).alias("_total"))
    joined = counts.join(total, by) if by else counts.join(F.broadcast(total))
    return joined.where("_total > 0").withColumn("weight", F.col(n) / F.col("_total")).drop("_total")


def weighted_jaccard(a: DataFrame, b: DataFrame, key: str = "piece", n: str = "n") -> DataFrame:
    """The sum of smaller over the sum of larger weights, over all pieces of either side."""
    told = [d.select(key, *[F.col(n).alias(c) if own else F.lit(None).alias(c) for c, own in (("a", of_a), ("b", not of_a))]) for d, of_a in ((a, True), (b, False))]
    both = told[0].union(told[1]).groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    totals = both.agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"))  # one row
    weight = lambda c: F.when((F.col(f"_{c}") > 0) & F.col(c).isNotNull(), F.col(c) / F.col(f"_{c}"))
    shares = both.crossJoin(F.broadcast(totals)).select(weight("a").alias("wa"), weight("b").alias("wb")).where("wa is not null or wb is not null").na.fill(0.0)
    return shares.agg(F.count_if((F.col("wa") > 0) & (F.col("wb") > 0)).alias("shared"), F.count(F.lit(1)).alias("n_union"), F.try_divide(F.sum(F.least("wa", "wb")), F.sum(F.greatest("wa", "wb"))).alias("weighted_jaccard"))


def restricted(counts: DataFrame, allowed: DataFrame, key: str = "piece") -> DataFrame:
    """The counts of allowed pieces; how many texts there were is kept apart, by the caller."""
    return counts.join(allowed.select(key).distinct(), key, "left_semi")


def multi_glyph(vocabulary: DataFrame) -> DataFrame:
    """The distinct pieces of two glyphs or more. What travels is their glyphs joined by a separator that none has, and their glyphs are made once: a filter below the grouping would make them again."""
    told = vocabulary.select(F.array_join("piece", "\x1f").alias("part"), F.size("piece").alias("n"))
    return told.groupBy("part").agg(F.max("n").alias("n")).where("n >= 2").select(F.split("part", "\x1f").alias("piece"))


def membership(a: DataFrame, b: DataFrame, key: str = "piece") -> DataFrame:
    """(piece, class): shared, a_only or b_only."""
    return _sides(a, b, key).select(key, F.when(~F.col("a"), "b_only").when(~F.col("b"), "a_only").otherwise("shared").alias("class"))


def membership_counts(j: float, n_a: int, n_b: int) -> tuple[int, int, int]:
    """(shared, a only, b only) from a Jaccard index and two sizes; an error if no whole number fits."""
    exact = j * (n_a + n_b) / (1 + j)
    if abs(exact - round(exact)) > 1e-6 * max(1, n_a + n_b):
        raise ValueError("no whole number of shared pieces has this index")
    return round(exact), n_a - round(exact), n_b - round(exact)


def symmetric_difference(a: DataFrame, b: DataFrame, key: str = "piece") -> DataFrame:
    """Pieces in one set only."""
    return membership(a, b, key).where(F.col("class") != "shared").select(key)


def fresh(lower: DataFrame, upper: DataFrame, key: str = "piece") -> DataFrame:
    """Pieces of the larger vocabulary that the smaller lacks."""
    return upper.select(key).distinct().join(lower.select(key), key, "left_anti")


def marginal_steps(vocabularies: DataFrame) -> DataFrame:
    """From (v, arm, piece), for each step between sizes: how many pieces are new in either arm, how many in both, and their Jaccard."""
    sizes = vocabularies.select("v").distinct().withColumn("lower", F.lag("v").over(Window.orderBy("v")))  # as many rows as sizes
    new = vocabularies.join(F.broadcast(sizes.where("lower is not null")), "v")
    old = vocabularies.select(F.col("v").alias("lower"), "arm", "piece")
    added = new.join(old, ["lower", "arm", "piece"], "left_anti").distinct()
    per_piece = added.groupBy("lower", "v", "piece").agg(F.bool_or(F.col("arm") == "a").alias("a"), F.bool_or(F.col("arm") == "b").alias("b"))
    return per_piece.groupBy("lower", "v").agg(F.count_if("a").alias("fresh_a"), F.count_if("b").alias("fresh_b"), F.count_if(F.col("a") & F.col("b")).alias("shared"), F.count(F.lit(1)).alias("n_union")).withColumn("jaccard", F.try_divide("shared", "n_union"))


def length_profile(vocabulary: DataFrame, length: Column | None = None) -> DataFrame:
    """n, mean, median and longest; zeros for an empty vocabulary."""
    n = F.size("piece") if length is None else length
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return vocabulary.select(n.alias("n")).agg(F.count("n").alias("n_pieces"), zero(F.avg("n")).alias("mean"), zero(F.median("n")).alias("median"), F.coalesce(F.max("n"), F.lit(0)).alias("longest"))


def length_histogram(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.groupBy(F.size("piece").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def rank_frequency(counts: DataFrame, by: list[str], key: str = "piece", n: str = "n") -> DataFrame:
    """Ranks from 1 by falling count, ties by piece; pieces that never fire are ranked too."""
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(n).desc(), key)))


def rank_all(counts: DataFrame, by: list[str], key: str = "piece", n: str = "n") -> DataFrame:
    """:func:`rank_frequency` of every piece, where a corpus may be far larger than a task.

    Rows are dealt out by ranges of the order itself; each range ranks its own, and what
    is in a corpus's ranges before is added. (Where only the first ranks are wanted, the plain
    window is cheaper: each task drops what can't be among them.)
    """
    order = [F.col(n).desc(), F.col(key)]
    ranged = written(counts.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    many = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_many"))  # a row for each range and corpus in it
    before = F.coalesce(F.sum("_many").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = many.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_range").alias("_own"), before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    same = F.col("_range") == F.col("_own")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return ranged.withColumn("_rank", own).join(offsets, same).select(*counts.columns, (F.col("_rank") + F.col("_before")).alias("rank"))


def ordered(vocabulary: DataFrame) -> DataFrame:
    """Surfaces by number of glyphs, then by surface."""
    return vocabulary.select(F.size("piece").alias("n_glyphs"), surface(F.col("piece")).alias("surface")).orderBy("n_glyphs", "surface")


def cooccurrence(vocabulary: DataFrame) -> DataFrame:
    """(a, b, n): how often two glyphs stand side by side in pieces."""
    pairs = F.arrays_zip(F.slice("piece", 1, F.size("piece") - 1).alias("a"), F.slice("piece", 2, F.size("piece")).alias("b"))
    return vocabulary.where(F.size("piece") >= 2).select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def composition(vocabulary: DataFrame, by: list[str]) -> DataFrame:
    """The share of each class of pieces in percent, rounded half to even."""
    counted = vocabulary.groupBy(*by, piece_class(F.col("piece"), with_bracket=False).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return normalized(counted, by).withColumn("percent", F.bround(F.col("weight") * 100, 0).cast("int")).drop("weight")


def closure(vocabulary: DataFrame, by: list[str]) -> DataFrame:
    """How closed vocabularies are under taking pieces apart.

    Of the pieces of two glyphs or more: c_bin, the share that splits into two
    pieces of the vocabulary; of those of three or more, c_orph, the share of
    orphans, with no proper part of two or more glyphs among the multi-glyph
    pieces; c_full, the share whose proper parts (of two or more glyphs) are all
    in. Parts are looked up by one join, each with where it lies. What is sent to it are only
    parts as long as some piece of the vocabulary, and of those what a filter of fixed size lets
    through (:mod:`lexforge.operators.parts`): few that aren't in the vocabulary, and all that are.
    What travels is the glyphs joined by a separator that none has, and the piece's name, or its
    SHA-256 if that is shorter.
    """
    key = lambda p: F.array_join(p, "\x1f")
    n = F.size("piece")
    own = written(vocabulary.select(*by, key(F.col("piece")).alias("part"), n.alias("len")).where("len > 0").distinct(), "pieces")
    name = F.when(F.length("part") > 64, F.sha2("part", 256)).otherwise(F.col("part"))
    multi = own.where("len >= 2").select(*by, name.alias("name"), F.col("len").alias("n"), F.split("part", "\x1f").alias("piece"))
    place = parts.likely(own.select(*by, "len", F.split("part", "\x1f").alias("piece")), by)
    placed = multi.select(*by, "name", "n", "piece", F.explode(place(F.col("piece"))).alias("p"))
    placed = placed.select(*by, "name", "n", "piece", F.shiftright("p", 32).cast("int").alias("len"), F.col("p").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("at"))
    found = placed.select(*by, "name", "n", "len", "at", key(F.slice("piece", F.col("at") + 1, F.col("len"))).alias("part"))
    held = found.join(own.select(*by, "part"), [*by, "part"], "left_semi").groupBy(*by, "name", "n").agg(
        F.count_if(F.col("len") >= 2).alias("known"),
        F.collect_set(F.when(F.col("at") == 0, F.col("len"))).alias("heads"),
        F.collect_set(F.when(F.col("at") + F.col("len") == F.col("n"), F.col("at"))).alias("tails"),
    )
    told = multi.select(*by, "name", "n", F.array_contains("piece", "[").alias("bracket")).join(held.drop("n"), [*by, "name"], "left")
    known, inner = F.coalesce("known", F.lit(0)), F.col("n").cast("long") * (F.col("n") - 1) / 2 - 1
    binary = F.coalesce(F.arrays_overlap("heads", "tails"), F.lit(False))
    counted = told.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_multi"), F.count_if(F.col("n") >= 3).alias("n_ge3"), F.count_if(binary).alias("n_bin_closed"), F.count_if((F.col("n") >= 3) & (known == 0)).alias("n_orphan"),
        F.count_if(known == inner).alias("n_full_closed"), F.count_if(F.col("bracket") & ~binary).alias("n_bracket_open"),
    )
    return counted.select("*", F.try_divide("n_bin_closed", "n_multi").alias("c_bin"), F.try_divide("n_orphan", "n_ge3").alias("c_orph"), F.try_divide("n_full_closed", "n_multi").alias("c_full"))
