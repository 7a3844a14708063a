"""Queries of bootstrap intervals, with SQL that makes the same weights and resamples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexforge.functions import lexing
from lexforge.operators import emission, resampling, tokenizers
from lexforge.plans.catalog import _WORDS, ARM_B, query, rounded, table, words
from lexforge.plans.lexing_queries import CHUNK
from lexforge.plans.molecule_queries import _FUNCTIONAL, _thirds, spelt
from lexforge.plans.token_queries import _LATTICE, scoring

SEED = 7
#: Resamples of the statistics that need a sum for each piece.
JOINT = 100
_LANG = "coalesce(lang, 'none')"


def _sums(resamples: int) -> str:
    """SQL: from v(key, unit, item, value), which comes before: sums(key, item, r, total)."""
    weight = " + ".join(f"(u >= {e!r}::DOUBLE)::INT" for e in resampling.poisson_edges())
    return f"""u AS MATERIALIZED (SELECT key, unit, r, ({weight}) AS w FROM (SELECT key, unit, r, ('0x' || substr(md5('{SEED}|' || r || '|' || unit), 1, 12))::BIGINT::DOUBLE / {1 << 48}::DOUBLE AS u
            FROM (SELECT DISTINCT key, unit FROM v), unnest(range(0, {resamples})) AS t(r))),
        sums AS MATERIALIZED (SELECT v.key, item, r, sum(w * value::DOUBLE) AS total FROM u JOIN v ON v.key = u.key AND v.unit = u.unit WHERE w > 0 GROUP BY ALL)"""


def _ratio(numerator: str, denominator: str, name: str = "x") -> str:
    """SQL: of sums, one item's total over another's."""
    return f"coalesce(sum(total) FILTER (item = '{numerator}'), 0) / nullif(sum(total) FILTER (item = '{denominator}'), 0) AS {name}"


def _ends(key: str, *names: str, plain: bool = False) -> str:
    """SQL: the interval's ends, from samples(key, r, names)."""
    columns = []
    for n in names:
        size, ranks = f"count({n})", f"list_sort(list({n}) FILTER ({n} IS NOT NULL))"
        low = f"least({size} - 1, floor(0.025 * {size})::BIGINT)"
        high = f"greatest({low}, greatest(0, least({size} - 1, floor(0.975 * {size})::BIGINT - 1)))"
        ends = ("low", "high") if plain else (f"{n}_low", f"{n}_high")
        columns += [f"round(({ranks})[1 + {low}], 6) AS {ends[0]}", f"round(({ranks})[1 + {high}], 6) AS {ends[1]}"]
    return f"SELECT key AS {key}, {', '.join(columns)} FROM samples GROUP BY key"


def _made(samples: DataFrame, key: str, *names: str, plain: bool = False) -> DataFrame:
    found = resampling.intervals(samples, *names)
    found = rounded(found, *[c for c in found.columns if c != "key"]).withColumnRenamed("key", key)
    return found.withColumnsRenamed({f"{names[0]}_low": "low", f"{names[0]}_high": "high"}) if plain else found


def _lengths(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), "doc_id", F.length("text").alias("g"), F.regexp_count("text", F.lit(ARM_B)).alias("t"))
    return resampling.columns(docs.withColumn("one", F.lit(1)), "lang", "doc_id", "g", "t", "one")


_V_LENGTHS = f"d AS (SELECT {_LANG} AS key, doc_id AS unit, coalesce(length(text), 0) AS g, coalesce(len(regexp_extract_all(text, '{ARM_B}')), 0) AS t FROM documents), v AS (SELECT key, unit, 'g' AS item, g AS value FROM d UNION ALL SELECT key, unit, 't', t FROM d UNION ALL SELECT key, unit, 'one', 1 FROM d)"


@query(f"WITH {_V_LENGTHS}, {_sums(1000)}, samples AS (SELECT key, r, {_ratio('g', 't')} FROM sums GROUP BY ALL) {_ends('lang', 'x', plain=True)}")
def bootstrap_poisson(spark, sf_dir):
    """Characters a word, by language."""
    return _made(resampling.ratio(resampling.poisson_sums(_lengths(spark, sf_dir), seed=SEED), "g", "t"), "lang", "x", plain=True)


@query(f"WITH {_V_LENGTHS}, {_sums(1000)}, samples AS (SELECT key, r, {_ratio('t', 'one')} FROM sums GROUP BY ALL) {_ends('lang', 'x', plain=True)}")
def interval_mean(spark, sf_dir):
    """Words a document, by language."""
    return _made(resampling.ratio(resampling.poisson_sums(_lengths(spark, sf_dir), seed=SEED), "t", "one"), "lang", "x", plain=True)


@query()
def bootstrap_ratio(spark, sf_dir):
    """Characters a word, by language, from multinomial draws dealt out over parts; tested against the form in one task."""
    values = _lengths(spark, sf_dir)
    return _made(resampling.ratio(resampling.multinomial_sums(values, values, part=1 << 12), "g", "t"), "lang", "x", plain=True)


@query(
    f"""{_LATTICE}, o AS (SELECT {_LANG} AS key, doc_id AS unit, unnest(regexp_extract_all(piece, '{CHUNK}')) AS c FROM ({_WORDS}) WHERE NOT regexp_matches(piece, 'Cl|Br')),
    each AS (SELECT key, unit, sum(e1) AS h, sum(length(c)) AS g FROM o JOIN r ON r.w = o.c AND r.i = length(r.w) GROUP BY ALL),
    v AS MATERIALIZED (SELECT key, unit, 'h' AS item, h::DOUBLE AS value FROM each UNION ALL SELECT key, unit, 'g', g::DOUBLE FROM each UNION ALL SELECT key, unit, 'one', 1 FROM each), {_sums(1000)},
    samples AS (SELECT key, r, {_ratio('h', 'one', 'per_text')}, {_ratio('h', 'g', 'per_glyph')} FROM sums GROUP BY ALL) {_ends('lang', 'per_text', 'per_glyph')}"""
)
def interval_entropy(spark, sf_dir):
    """Segmentation entropy a text and a glyph, by language, both from one draw."""
    rows = words(spark, sf_dir).where(~F.col("piece").rlike("Cl|Br")).withColumn("id", F.struct(F.coalesce("lang", F.lit("none")).alias("key"), F.col("doc_id").alias("unit")))
    each = tokenizers.segmentation_entropy(rows, "id", "piece", scoring())
    values = resampling.columns(each.select("id.key", "id.unit", F.col("entropy").alias("h"), F.col("n_glyphs").alias("g"), F.lit(1).alias("one")), "key", "unit", "h", "g", "one")
    sums = resampling.poisson_sums(values, seed=SEED)
    both = resampling.ratio(sums, "h", "one", "per_text").join(resampling.ratio(sums, "h", "g", "per_glyph"), ["key", "resample"])
    return _made(both, "lang", "per_text", "per_glyph")


@query(
    f"""{_FUNCTIONAL}, n AS (SELECT substr(t, 1, 1) AS key, t AS unit, count(*) FILTER (position % 3 <> 0) AS x, count(*) AS n FROM b GROUP BY ALL),
    v AS MATERIALIZED (SELECT key, unit, 'local' AS item, x AS value FROM n UNION ALL SELECT key, unit, 'bonds', n FROM n), {_sums(JOINT)},
    samples AS (SELECT key, r, {_ratio('local', 'bonds')} FROM sums GROUP BY ALL) {_ends('first', 'x', plain=True)}"""
)
def interval_locality(spark, sf_dir):
    """Locality of functional bonds, resampling molecules, by a spelling's first sign."""
    rows = spelt(spark, sf_dir).withColumn("g", lexing.glyphs(F.col("t")))
    bonds = rows.select("t", emission.locality_of(emission.functional_bonds(F.col("g")), _thirds(F.size("g"))).alias("bonds")).where(F.size("bonds") > 0)
    units = bonds.select(F.substring("t", 1, 1).alias("key"), "t", F.size(F.filter("bonds", lambda b: b["local"])).alias("local"), F.size("bonds").alias("bonds"))
    return _made(resampling.ratio(resampling.poisson_sums(resampling.columns(units, "key", "t", "local", "bonds"), seed=SEED, resamples=JOINT), "local", "bonds"), "first", "x", plain=True)


# two arms that cut words otherwise: their first letters, and their letters but for these
def _pieces(spark, sf_dir) -> DataFrame:
    """(key, unit, arm, piece, n)."""
    own = words(spark, sf_dir).select(F.coalesce("lang", F.lit("none")).alias("key"), F.col("doc_id").alias("unit"), F.lower("piece").alias("w"))
    arm = lambda name, letters: own.select("key", "unit", F.lit(name).alias("arm"), F.explode(F.filter(F.split(letters, ""), lambda x: x != "")).alias("piece"))
    return arm("a", F.substring("w", 1, 1)).unionByName(arm("b", F.expr("substring(w, 2)"))).groupBy("key", "unit", "arm", "piece").agg(F.count(F.lit(1)).alias("value"))


_V_PIECES = f"""w AS (SELECT {_LANG} AS key, doc_id AS unit, lower(piece) AS w FROM ({_WORDS})),
    x AS MATERIALIZED (SELECT key, unit, arm, piece, count(*) AS value FROM (SELECT key, unit, 'a' AS arm, w[1] AS piece FROM w UNION ALL SELECT key, unit, 'b', unnest(string_split(w[2:], '')) FROM w WHERE length(w) > 1) GROUP BY ALL)"""


@query(
    f"""WITH {_V_PIECES}, v AS MATERIALIZED (SELECT key, unit, arm || piece AS item, value FROM x), {_sums(JOINT)},
    p AS (SELECT key, r, item[2:] AS piece, coalesce(sum(total) FILTER (item[1] = 'a'), 0) AS a, coalesce(sum(total) FILTER (item[1] = 'b'), 0) AS b FROM sums GROUP BY ALL),
    q AS (SELECT *, a / sum(a) OVER (PARTITION BY key, r) AS x, b / sum(b) OVER (PARTITION BY key, r) AS y, sum(a) OVER (PARTITION BY key, r) > 0 AND sum(b) OVER (PARTITION BY key, r) > 0 AS ok FROM p),
    samples AS (SELECT key, r, sum(least(x, y)) / sum(greatest(x, y)) AS j FROM q WHERE ok GROUP BY ALL) {_ends('lang', 'j', plain=True)}"""
)
def interval_jaccard(spark, sf_dir):
    """The weighted Jaccard of two arms' pieces, by language, both arms on one draw of documents."""
    values = _pieces(spark, sf_dir).select("key", "unit", F.struct("arm", "piece").alias("item"), "value")
    return _made(resampling.overlap(resampling.poisson_sums(values, seed=SEED, resamples=JOINT), "j"), "lang", "j", plain=True)


@query(
    f"""WITH {_V_PIECES}, v AS MATERIALIZED (SELECT key, unit, piece AS item, value FROM x WHERE arm = 'b'), {_sums(JOINT)},
    p AS (SELECT key, r, total / sum(total) OVER (PARTITION BY key, r) AS p FROM sums WHERE total > 0),
    samples AS (SELECT key, r, 0.5 * (sum(abs(p - 1 / 128.0::DOUBLE)) + (128 - count(*)) / 128.0::DOUBLE) AS imbalance, -sum(p * log2(p)) / 7 AS entropy, log2(sum(pow(p, 2.5))) / -1.5 / 7 AS renyi FROM p GROUP BY ALL) {_ends('lang', 'imbalance', 'entropy', 'renyi')}"""
)
def interval_intrinsics(spark, sf_dir):
    """Imbalance, entropy and Renyi efficiency of an arm's pieces at a vocabulary of 128, by language, all from one draw."""
    values = _pieces(spark, sf_dir).where("arm = 'b'").select("key", "unit", F.col("piece").alias("item"), "value")
    return _made(resampling.intrinsics(resampling.poisson_sums(values, seed=SEED, resamples=JOINT), 128), "lang", "imbalance", "entropy", "renyi")
