"""What tokenizers emit, measured: fertility, distribution, absorption, nestedness, dead zones, scaffolds, locality, transfer, stability.

Tokens come one row a text, as an array of (start, end) glyph spans or of
pieces; what is counted by piece is long: (unit, piece, n).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lexforge.functions.arrays import let
from lexforge.functions.batches import parts as few, together
from lexforge.operators.molecules import BOND_CLASSES, functional_bonds as functional_bonds


def piece_counts(tokens: DataFrame, unit: str, pieces: str, *, least_glyphs: int = 1) -> DataFrame:
    """(unit, piece, n) of pieces with enough glyphs."""
    return tokens.select(unit, F.explode(pieces).alias("piece")).where(F.size("piece") >= least_glyphs).groupBy(unit, "piece").agg(F.count(F.lit(1)).alias("n"))


def without_specials(counts: DataFrame, specials: DataFrame, key: str = "token_id") -> DataFrame:
    """Counts less those of special ids."""
    return counts.join(F.broadcast(specials.select(key).distinct()), key, "left_anti")


def special_ids(named: DataFrame, added: DataFrame) -> DataFrame:
    """The named special ids and the added ones that are flagged, distinct."""
    return named.select("token_id").where("token_id is not null").union(added.where("special").select("token_id")).distinct()


def glyph_total(ids: Column, n_glyphs: Column) -> Column:
    """The glyphs of an id array by a map of glyph counts; an unknown id counts one."""
    return F.aggregate(ids, F.lit(0), lambda a, i: a + F.coalesce(F.try_element_at(n_glyphs, i), F.lit(1)))


def fertility(units: DataFrame, by: list[str]) -> DataFrame:
    """From (n_tokens, n_glyphs) a unit: n, sums, tokens a unit, glyphs a token, and the population variance of tokens."""
    return units.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens"), F.sum("n_glyphs").alias("glyphs"), F.avg("n_tokens").alias("fertility"),
        F.try_divide(F.sum("n_glyphs"), F.sum("n_tokens")).alias("glyphs_per_token"), F.var_pop("n_tokens").alias("variance"),
    )


def relative_gap(a: Column, b: Column) -> Column:
    """The difference of two values over their mean, without sign; null if that is 0."""
    return F.try_divide(F.abs(a - b), (a + b) / 2)


def pair_deltas(a: DataFrame, b: DataFrame, on: list[str], values: list[str], same: list[str] = ()) -> DataFrame:
    """Two arms joined: for each value both arms' and b less a; for each of ``same``, whether the arms agree on it."""
    left, right = (d.select(*on, *[F.col(v).alias(f"{v}_{s}") for v in [*values, *same]]) for d, s in ((a, "a"), (b, "b")))
    joined = left.join(right, on)
    return joined.select(*on, *[c for v in values for c in (f"{v}_a", f"{v}_b")], *[(F.col(f"{v}_b") - F.col(f"{v}_a")).alias(f"delta_{v}") for v in values], *[F.col(f"{v}_a").eqNullSafe(F.col(f"{v}_b")).alias(f"same_{v}") for v in same])


def arms_beside(rows: DataFrame, arm: str, on: list[str], values: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """:func:`pair_deltas` of two arms in one table, by one aggregation; keys that lack an arm go."""
    of = lambda v, which: F.max(F.when(F.col(arm) == which, F.col(v)))
    both = rows.groupBy(*on).agg(F.count_if(F.col(arm) == a).alias("_a"), F.count_if(F.col(arm) == b).alias("_b"), *[x for v in values for x in (of(v, a).alias(f"{v}_a"), of(v, b).alias(f"{v}_b"))])
    return both.where("_a > 0 and _b > 0").drop("_a", "_b").select("*", *[(F.col(f"{v}_b") - F.col(f"{v}_a")).alias(f"delta_{v}") for v in values])


def distribution(counts: DataFrame, by: list[str], size: Column | None = None, alpha: float = 2.5, n: str = "n") -> DataFrame:
    """From counts by piece, of a vocabulary of ``size`` (the live pieces, if not given): tokens, live pieces, imbalance D, normalised entropy eta and Renyi efficiency.

    D sums how far the shares are from uniform; a dead piece adds 1 / size, so
    dead pieces need no rows. All three are 0 for a vocabulary of one or none.
    """
    totals = counts.where(F.col(n) > 0).groupBy(*by).agg(F.sum(n).alias("tokens"), F.count(F.lit(1)).alias("live"))
    joined = counts.where(F.col(n) > 0).join(totals, by) if by else counts.where(F.col(n) > 0).crossJoin(F.broadcast(totals))
    v = (F.col("live") if size is None else size).cast("double")
    p = F.col(n) / F.col("tokens")
    sums = joined.withColumn("v", v).groupBy(*by, "tokens", "live", "v").agg(F.sum(F.abs(p - 1 / F.col("v"))).alias("away"), F.sum(-p * F.log2(p)).alias("bits"), F.sum(F.pow(p, F.lit(alpha))).alias("power"))
    small = F.col("v") <= 1
    return sums.select(
        *by, "tokens", "live",
        F.when(small, 0.0).otherwise(0.5 * (F.col("away") + (F.col("v") - F.col("live")) / F.col("v"))).alias("imbalance"),
        F.when(small, 0.0).otherwise(F.col("bits") / F.log2("v")).alias("entropy"),
        F.when(small, 0.0).otherwise(F.log2("power") / (1 - alpha) / F.log2("v")).alias("renyi"),
    )


def clearance(vocabulary: DataFrame | None, counts: DataFrame, by: list[str], thresholds: tuple[int, ...] = (50, 100, 200), key: str = "piece") -> DataFrame:
    """The share of a vocabulary that fires at least n times, pieces that never fire included; unsafe if under 0.95 fire 100 times. Without a vocabulary it is the pieces that are counted, and nothing is joined."""
    counts = counts.groupBy(*by, key).agg(F.sum("n").alias("n"))
    fired = counts if vocabulary is None else vocabulary.select(*by, key).distinct().join(counts, [*by, key], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    shares = [F.avg((F.col("n") >= t).cast("int")).alias(f"f_{t}") for t in thresholds]
    return fired.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pieces"), *shares).withColumn("unsafe", F.col("f_100") < 0.95 if 100 in thresholds else F.lit(None).cast("boolean"))


def threshold(counts: DataFrame, by: list[str], p: float, n_min: int) -> DataFrame:
    """From a row a piece with its n: how many fire n_min times, whether their share reaches p, and if not the first rank, by falling n, that doesn't fire so often: the one after those that do."""
    if not 0 < p <= 1:
        raise ValueError("p must be above 0 and at most 1")
    counted = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("n") >= n_min).alias("clearing"))
    crossed = F.coalesce(F.try_divide("clearing", "all") >= p, F.lit(False))
    return counted.select(*by, F.lit(p).alias("p"), F.lit(n_min).alias("n_min"), "clearing", crossed.alias("crossed"), F.when(~crossed & (F.col("clearing") < F.col("all")), F.col("clearing") + 1).cast("int").alias("first_rank_below"))


def non_atomic(vocabulary: DataFrame, atomic: DataFrame, surface_col: str = "surface") -> DataFrame:
    """Entries whose surface isn't in the alphabet: identity by string here, not by glyphs."""
    return vocabulary.join(atomic.select(surface_col).distinct(), surface_col, "left_anti")


def dead_zone(clearances: DataFrame, on: list[str], ps: tuple[float, ...] = (0.9, 0.95, 0.99), thresholds: tuple[int, ...] = (50, 100, 200)) -> DataFrame:
    """From both arms' clearance (columns f_50_a, f_50_b, ...): a row for each p and n with both shares, their difference, and which arms are below p."""
    grid = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(n).alias("n"), F.col(f"f_{n}_a").alias("f_a"), F.col(f"f_{n}_b").alias("f_b")) for p in ps for n in thresholds]))
    rows = clearances.select(*on, grid.alias("g")).select(*on, "g.*")
    return rows.select("*", (F.col("f_b") - F.col("f_a")).alias("delta"), ((F.col("f_a") < F.col("p")) | (F.col("f_b") < F.col("p"))).alias("any_unsafe"), ((F.col("f_a") < F.col("p")) & (F.col("f_b") < F.col("p"))).alias("both_unsafe"))


#: Places of a text are numbered after those of the texts before it.
_TEXT = 1 << 32


def _flat(rows: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, start and end of all parts of some texts: of spans, or of lengths, of which negative ones only take room."""
    counts = rows.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    row, values = np.repeat(np.arange(len(rows)), counts), rows.flatten()
    if pa.types.is_struct(values.type):
        start, end = (values.field(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("start", "end"))
        return row, start, end
    sizes = values.to_numpy(zero_copy_only=False).astype(np.int64)
    sums = np.concatenate(([0], np.cumsum(np.abs(sizes))))
    first = sums[:-1][np.minimum(np.cumsum(counts) - counts, max(0, len(sizes) - 1))] if len(sizes) else np.zeros(len(rows), np.int64)
    end = sums[1:] - first[row]
    real = sizes > 0
    return row[real], (end - np.abs(sizes))[real], end[real]


@F.arrow_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("n_chunks", "n_absorbed", "n_cross")]))
def _absorbed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for batch in batches:
        for chunks, tokens in together(list(batch)):
            (row, start, end), (of, begin, stop) = _flat(chunks), _flat(tokens)
            row, start, end = (x[start < end] for x in (row, start, end))
            at = np.searchsorted(of * _TEXT + begin, row * _TEXT + start, side="right") - 1  # the last token begun
            own = np.maximum(at, 0)
            there = (at >= 0) & (of[own] == row) if len(of) else np.zeros(len(row), bool)
            whole, inside = (there.copy() for _ in range(2))
            if len(of):
                whole &= (begin[own] == start) & (stop[own] == end)
                inside &= (end <= stop[own]) & (stop[own] - begin[own] > end - start)
            count = lambda x, none: pa.array(np.bincount(x, minlength=len(chunks)).astype(np.int32), mask=none)
            no_chunks, none = (x.is_null().to_numpy(zero_copy_only=False) for x in (chunks, tokens))
            yield pa.StructArray.from_arrays([count(row, no_chunks), count(row[whole], no_chunks | none), count(row[inside], no_chunks | none)], ["n_chunks", "n_absorbed", "n_cross"])


def _bare(xs: Column) -> Column:
    return F.transform(xs, lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end")))


def absorbed(chunks: Column, tokens: Column, cross: bool) -> Column:
    """(n_chunks, n_absorbed, n_cross) of a text: chunks that are one token, and (where tokens may cross chunks) that a longer one holds. Tokens are ascending and don't overlap. In Arrow batches, as :func:`cut_positions`."""
    return absorbed_lengths(_bare(chunks), _bare(tokens), cross)


def absorbed_lengths(chunks: Column, tokens: Column, cross: bool) -> Column:
    """:func:`absorbed` from the lengths of parts that follow each other; those that are no chunk, or no token, have theirs with a minus."""
    x = _absorbed(chunks, tokens)
    return F.struct(x["n_chunks"].alias("n_chunks"), x["n_absorbed"].alias("n_absorbed"), (x["n_cross"] if cross else F.lit(None).cast("int")).alias("n_cross"))


def absorption(units: DataFrame, by: list[str]) -> DataFrame:
    """Shares of absorbed and crossed chunks, from (n_chunks, n_absorbed, n_cross) a text; crossed is null where it isn't defined."""
    return units.groupBy(*by).agg(F.sum("n_chunks").alias("chunks"), F.try_divide(F.sum("n_absorbed"), F.sum("n_chunks")).alias("absorbed"), F.try_divide(F.sum("n_cross"), F.sum("n_chunks")).alias("crossed"))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _ends(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for rows in few(batch):
            counts = rows.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            sums = np.concatenate(([0], np.cumsum(rows.flatten().to_numpy(), dtype=np.int64)))
            edges = np.concatenate(([0], np.cumsum(counts)))
            ends = sums[1:] - np.repeat(sums[edges[:-1]], counts)
            inner = np.ones(len(ends), bool)
            inner[edges[1:][counts > 0] - 1] = False
            kept = np.concatenate(([0], np.cumsum(np.maximum(counts - 1, 0))))
            yield pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), pa.array(ends[inner].astype(np.int32)), mask=rows.is_null())


def cut_positions(lengths: Column) -> Column:
    """Where tokens of the given glyph counts end, but for the last. In Arrow batches: over thousands of tokens a text, running sums of array functions take three times as long."""
    return _ends(lengths)


def nestedness_of(a: Column, b: Column, glyphs: Column) -> Column:
    """Over the positions between glyphs, from ascending distinct cuts: both arms cut, only b cuts (a nests), only a cuts (conflict), neither cuts."""
    positions = F.greatest(glyphs - 1, F.lit(0))

    def told(cuts: Column) -> Column:
        x, y = cuts["a"], cuts["b"]
        both = F.size(F.array_intersect(x, y))
        return F.struct(positions.alias("positions"), both.alias("agree_cut"), (F.size(y) - both).alias("nest"), (F.size(x) - both).alias("conflict"), (positions - F.size(x) - F.size(y) + both).alias("agree_merge"))

    return let(F.struct(a.alias("a"), b.alias("b")), told)


def nestedness(units: DataFrame, by: list[str]) -> DataFrame:
    """Boundary Jaccard, rates of conflict, nesting and agreement, and the share of texts without conflict."""
    s = {c: F.sum(c) for c in ("positions", "agree_cut", "nest", "conflict", "agree_merge")}
    return units.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(s["agree_cut"], s["agree_cut"] + s["nest"] + s["conflict"]).alias("boundary_jaccard"),
        F.try_divide(s["conflict"], s["positions"]).alias("conflict_rate"), F.try_divide(s["nest"], s["positions"]).alias("nest_rate"),
        F.try_divide(s["agree_cut"] + s["agree_merge"], s["positions"]).alias("agree_rate"), F.avg((F.col("conflict") == 0).cast("int")).alias("nested"),
    )


def contrast(units: DataFrame, keep: list[str], a: str, b: str) -> DataFrame:
    """Both arms of each text from the glyph counts of their tokens: n_a, n_b, the relative gap between them, and where their boundaries agree."""
    sizes = lambda c: F.aggregate(F.col(c), F.lit(0), lambda s, n: (s + n).cast("int"))
    return _contrasted(units, keep, a, b, cut_positions(F.col(a)), cut_positions(F.col(b)), sizes(a))


def contrast_of_ends(units: DataFrame, keep: list[str], a: str, b: str) -> DataFrame:
    """:func:`contrast` from where tokens end."""
    inner = lambda c: F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))
    return _contrasted(units, keep, a, b, inner(a), inner(b), F.coalesce(F.try_element_at(F.col(a), F.lit(-1)), F.lit(0)))


def _contrasted(units: DataFrame, keep: list[str], a: str, b: str, cuts_a: Column, cuts_b: Column, total: Column) -> DataFrame:
    told = units.select(*keep, F.size(a).alias("n_a"), F.size(b).alias("n_b"), nestedness_of(cuts_a, cuts_b, total).alias("x"))
    return told.select(*keep, "n_a", "n_b", relative_gap(F.col("n_a"), F.col("n_b")).alias("gap"), "x.*")


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def _cut_inside(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for batch in batches:
        for spans, cuts in together(list(batch)):
            row, start, end = _flat(spans)
            of = np.repeat(np.arange(len(cuts)), cuts.value_lengths().fill_null(0).to_numpy().astype(np.int64))
            at = np.sort(of * _TEXT + cuts.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            after = np.append(at, np.iinfo(np.int64).max)[np.searchsorted(at, row * _TEXT + start, side="right")]  # the first cut behind its start
            edges = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(spans)))))
            none = pc.or_(spans.is_null(), cuts.is_null())
            yield pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(after < row * _TEXT + end), mask=none)


def cut_through(tokens: DataFrame, by: list[str], piece: str, spans: str, cuts: str, klass) -> DataFrame:
    """By class of piece: how many were emitted, and how many the other arm cuts inside. tokens: arrays of pieces and their spans (or lengths, where pieces follow each other), both in order, and the other arm's cuts. Counted in Arrow batches, as :func:`cut_positions`."""
    own = F.col(spans) if dict(tokens.dtypes)[spans] == "array<int>" else _bare(F.col(spans))
    rows = tokens.select(*by, F.explode(F.arrays_zip(F.col(piece).alias("piece"), _cut_inside(own, F.col(cuts)).alias("hit"))).alias("t"))
    return rows.groupBy(*by, klass(F.col("t.piece")).alias("class")).agg(F.count(F.lit(1)).alias("emitted"), F.count_if("t.hit").alias("cut_through"))


def locality_of(bonds: Column, cuts: Column) -> Column:
    """Bonds with whether they are local: no token boundary between the heteroatom and the bond's sign."""
    return F.transform(bonds, lambda b: F.struct(b["label"].alias("label"), (~F.array_contains(cuts, b["position"])).alias("local")))


def locality(units: DataFrame, by: list[str], bonds: str = "bonds") -> DataFrame:
    """Bonds and the share that is local, overall and by class."""
    rows = units.select(*by, F.explode(bonds).alias("b")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_bonds"), F.avg(F.col("b.local").cast("int")).alias("locality"),
        *[F.avg(F.when(F.col("b.label") == c, F.col("b.local").cast("int"))).alias(c) for c in BOND_CLASSES],
    )
    return rows


def transfer(units: DataFrame, by: list[str]) -> DataFrame:
    """From (n_tokens, n_glyphs, n_unknown) a text: fertility, glyphs a token, and the shares of unknown tokens and of texts with one."""
    return units.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("fertility"), F.try_divide(F.sum("n_glyphs"), F.sum("n_tokens")).alias("glyphs_per_token"),
        F.coalesce(F.try_divide(F.sum("n_unknown"), F.sum("n_tokens")), F.lit(0.0)).alias("oov_tokens"), F.avg((F.col("n_unknown") > 0).cast("int")).alias("oov_units"),
    )


def transfer_penalty(records: DataFrame) -> DataFrame:
    """From (train, eval, fertility): fertility over that of the corpus's own tokenizer, a row a train corpus, a column an eval corpus."""
    native = records.where("train = eval").select("eval", F.col("fertility").alias("native"))
    return records.join(native, "eval").withColumn("penalty", F.try_divide("fertility", "native")).groupBy("train").pivot("eval").agg(F.first("penalty"))


def multiset_jaccard(counts: DataFrame, by: list[str], key: str, a: str, b: str) -> DataFrame:
    """From counts of both sides by key: smaller over larger counts, summed; 1 for two empty ones."""
    x, y = F.coalesce(F.col(a), F.lit(0)), F.coalesce(F.col(b), F.lit(0))
    return counts.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(F.least(x, y)), F.sum(F.greatest(x, y))), F.lit(1.0)).alias("jaccard"))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _in_common(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for batch in batches:
        for base, *others in together(list(batch)):
            owns = [np.repeat(np.arange(len(x)), x.value_lengths().fill_null(0).to_numpy().astype(np.int64)) for x in (base, *others)]
            values = pc.dictionary_encode(pa.concat_arrays([x.flatten() for x in (base, *others)]), null_encoding="encode")
            codes = values.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            width = int(codes.max(initial=0)) + 1
            edges = np.cumsum([0, *map(len, owns)])
            bags = [np.unique(own * width + codes[a:b], return_counts=True) for own, a, b in zip(owns, edges, edges[1:])]
            low = []
            for keys, n in bags[1:]:
                _, i, j = np.intersect1d(bags[0][0], keys, assume_unique=True, return_indices=True)
                low.append(np.bincount(bags[0][0][i] // width, np.minimum(bags[0][1][i], n[j]), len(base)).astype(np.int32))
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(base) + 1, dtype=np.int32) * len(others)), pa.array(np.stack(low, 1).ravel()))


def bag_jaccards(base: Column, others: list[Column]) -> list[Column]:
    """:func:`bag_jaccard` of an array and each of some others, which are counted in Arrow batches: sorting by array functions takes several times as long."""
    low = _in_common(base, *others)
    return [F.coalesce(F.try_divide(n, F.size(base) + F.size(x) - n), F.when(base.isNotNull() & x.isNotNull(), F.lit(1.0))) for k, x in enumerate(others) for n in [F.get(low, F.lit(k))]]


def bag_jaccard(a: Column, b: Column) -> Column:
    """The multiset Jaccard of two arrays in a row; 1 for two empty ones, null if one is."""
    return bag_jaccards(a, [b])[0]


def orbit_readings(encoded: DataFrame) -> DataFrame:
    """From (id, axis, tokens): for each text and axis the mean relative change of length and the mean instability of the bag, against the canonical form; texts whose canonical form has no tokens are left out."""
    base = encoded.where("axis = 'canonical'").select("id", F.col("tokens").alias("base")).where(F.size("base") > 0)
    rows = encoded.where("axis <> 'canonical'").join(base, "id")
    return rows.groupBy("id", "axis").agg(F.avg(F.abs(F.size("tokens") - F.size("base")) / F.size("base")).alias("length_change"), F.avg(1 - bag_jaccard(F.col("tokens"), F.col("base"))).alias("bag_instability"))


def readings_beside(texts: DataFrame, keep: list[str], base: str, others: dict[str, str]) -> DataFrame:
    """:func:`orbit_readings` where a row has the tokens of the canonical form and of one spelling an axis (the columns in ``others``): no tokens are shuffled."""
    told = texts.where(F.size(base) > 0)
    change = lambda c: F.abs(F.size(c) - F.size(base)) / F.size(base)
    like = bag_jaccards(F.col(base), [F.col(c) for c in others.values()])
    each = F.array(*[F.struct(F.lit(axis).alias("axis"), change(c).alias("length_change"), (1 - x).alias("bag_instability")) for (axis, c), x in zip(others.items(), like)])
    return told.select(*keep, F.explode(each).alias("x")).select(*keep, "x.*")


def noncanonicity(readings: DataFrame, by: list[str]) -> DataFrame:
    """Means over the texts that have an axis."""
    return readings.groupBy(*by, "axis").agg(F.count(F.lit(1)).alias("n"), F.avg("length_change").alias("length_change"), F.avg("bag_instability").alias("bag_instability"))


def standalone(log: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(id, standalone) at the end of training: the sum of a log's deltas by id; asked-for ids that the log lacks have 0."""
    sums = log.select(F.explode("standalone").alias("d")).groupBy(F.get("d", F.lit(0)).alias("id")).agg(F.sum(F.get("d", F.lit(1))).alias("standalone"))
    return sums if only is None else only.select("id").join(sums, "id", "left").withColumn("standalone", F.coalesce("standalone", F.lit(0)))


def scaffolds(log: DataFrame, surviving: DataFrame) -> DataFrame:
    """Surviving ids that stand alone less often than the last merge's pair did. An empty log is an error."""
    last = log.agg(F.max_by("candidate_freq", "step").alias("limit"))
    if last.first()["limit"] is None:
        raise ValueError("the log has no merges")
    return standalone(log, surviving).join(F.broadcast(last)).where("standalone < limit").select("id", "standalone")
