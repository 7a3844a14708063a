"""Queries of tokenizers, with their SQL.

Two tokenizers are put together by hand, so that SQL can say what they do: the
merges of one never compete for a letter, and the pieces of the other score more
than what they are made of. Both then cut a chunk as an alternation of their pieces
does, from the left. The first merges of a trained one are those of a chain of
replacements.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, functions as F

from lexforge.functions import lexing
from lexforge.operators import bpe, emission, seeds, tokenizers
from lexforge.plans.catalog import _WORDS, _chunks, query, rounded, table, words
from lexforge.plans.lexing_queries import CHUNK, GLYPHS, notations
from lexforge.session import written

_BASE = [("[UNK]",), *[(g,) for g in sorted([*string.printable, "Cl", "Br"])]]
MERGES = [(("t",), ("h",)), (("t", "h"), ("e",)), (("i",), ("n",)), (("i", "n"), ("g",)), (("o",), ("u",))]
#: Pieces of the other arm, of two glyphs or more, the longer ones first.
PIECES = ["tion", "the", "ing", "ou", "an", "he"]
_MERGED = "the|th|ing|in|ou|Cl|Br|(?s:.)"
_SCORED = "tion|the|ing|ou|an|he|Cl|Br|(?s:.)"


def merging() -> tokenizers.Tokenizer:
    return tokenizers.Tokenizer("bpe", [*_BASE, *[a + b for a, b in MERGES]], merges=MERGES)


def scoring() -> tokenizers.Tokenizer:
    """A single glyph costs 10, a longer piece 11 less a little for each glyph: no two shorter ones cost as little."""
    scores = {p: -10.0 for p in _BASE[1:]} | {tuple(p): -11.0 - len(p) / 8 for p in PIECES}
    return tokenizers.Tokenizer("unigram", [*_BASE, *[tuple(p) for p in PIECES]], scores=scores)


def _tokens(pattern: str) -> str:
    return f"flatten(list_transform(regexp_extract_all(text, '{CHUNK}'), lambda c: regexp_extract_all(c, '{pattern}')))"


def _named(pieces: list) -> str:
    return "[" + ", ".join("'" + "".join(p).replace("'", "''") + "'" for p in pieces) + "]"


def _digest(tokens: str):
    return F.md5(F.array_join(F.transform(tokens, lambda t: F.array_join(t["piece"], "")), "|"))


@query(f"SELECT doc_id, len({_tokens(_MERGED)})::INT AS n_tokens, md5(array_to_string({_tokens(_MERGED)}, '|')) AS digest FROM documents")
def merged_tokens(spark, sf_dir):
    """Every document under the merges, by the BPE segmenter."""
    found = tokenizers.encode(table(spark, sf_dir, "documents"), "text", merging(), keep=["doc_id"], fields=("piece",))
    return found.select("doc_id", F.size("tokens").alias("n_tokens"), _digest("tokens").alias("digest"))


@query(f"SELECT doc_id, len({_tokens(_SCORED)})::INT AS n_tokens, md5(array_to_string({_tokens(_SCORED)}, '|')) AS digest FROM documents")
def scored_tokens(spark, sf_dir):
    """Every document under the scores, by the best path."""
    found = tokenizers.encode(table(spark, sf_dir, "documents"), "text", scoring(), keep=["doc_id"], fields=("piece",))
    return found.select("doc_id", F.size("tokens").alias("n_tokens"), _digest("tokens").alias("digest"))


@query(f"WITH k AS (SELECT doc_id, unnest({_tokens(_MERGED)}) AS p, generate_subscripts({_tokens(_MERGED)}, 1) AS i FROM documents), s AS (SELECT *, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS z FROM k) SELECT doc_id, count(*) AS n, max(i - 1)::INT AS last, sum((z - length(p)) * (i % 7))::BIGINT AS starts, sum(z * (i % 11))::BIGINT AS ends, sum(CASE WHEN p IN ('Cl', 'Br') THEN 1 ELSE length(p) END)::BIGINT AS n_glyphs FROM s GROUP BY doc_id")
def segment_spans(spark, sf_dir):
    """Places of all tokens of every document, in sums weighted by their numbers."""
    rows = tokenizers.segment_table(table(spark, sf_dir, "documents"), "doc_id", "text", merging())
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"), F.sum(F.col("start").cast("long") * ((F.col("pos") + 1) % 7)).alias("starts"), F.sum(F.col("end").cast("long") * ((F.col("pos") + 1) % 11)).alias("ends"), F.sum("n_glyphs").alias("n_glyphs"))


def _known(pieces: str) -> str:
    return f"list_filter({pieces}, lambda p: NOT list_contains({_named([*_BASE[1:], *[a + b for a, b in MERGES]])}, p))"


@query(f"SELECT lang, count(*) AS n, sum(len(k))::BIGINT AS tokens, sum(g)::BIGINT AS glyphs, round(avg(len(k)), 6) AS fertility, round(sum(g) / sum(len(k)), 6) AS glyphs_per_token, round(sum(len({_known('k')})) / sum(len(k)), 6) AS oov_tokens, round(avg((len({_known('k')}) > 0)::INT), 6) AS oov_units FROM (SELECT lang, {_tokens(_MERGED)} AS k, length(text) - (length(text) - length(regexp_replace(text, 'Cl|Br', 'x', 'g'))) AS g FROM documents) GROUP BY lang")
def encoded_fertility(spark, sf_dir):
    """Tokens, glyphs and unknown pieces of every document, and what the measures make of them by language."""
    found = tokenizers.encode(table(spark, sf_dir, "documents"), "text", merging(), keep=["lang"], fields=("piece", "id"))
    n_glyphs = F.aggregate("tokens", F.lit(0), lambda s, t: s + F.size(t["piece"]))
    units = written(found.select("lang", F.size("tokens").alias("n_tokens"), n_glyphs.alias("n_glyphs"), F.size(F.filter("tokens", lambda t: t["id"] == -1)).alias("n_unknown")), "units")
    shares = emission.transfer(units, ["lang"]).select("lang", "oov_tokens", "oov_units")
    return rounded(emission.fertility(units, ["lang"]).drop("variance").join(shares, "lang"), "fertility", "glyphs_per_token", "oov_tokens", "oov_units")


@query(f"SELECT lang, sum(n)::BIGINT AS chunks, round(sum(k) / sum(n), 6) AS absorbed FROM (SELECT lang, len(regexp_extract_all(text, '{CHUNK}')) AS n, len(list_filter(regexp_extract_all(text, '{CHUNK}'), lambda c: len(regexp_extract_all(c, '{_MERGED}')) = 1)) AS k FROM documents) GROUP BY lang")
def encoded_absorption(spark, sf_dir):
    """Chunks of every document that the merges make one token."""
    docs = table(spark, sf_dir, "documents")
    found = tokenizers.encode(docs, "text", merging(), keep=["lang", "text"], fields=("start", "end"))
    units = found.select("lang", emission.absorbed_lengths(F.transform(lexing.chunks(F.col("text")), lambda c: F.length(c)), F.transform("tokens", lambda t: t["end"] - t["start"]), False).alias("x")).select("lang", "x.*")
    return rounded(emission.absorption(units, ["lang"]).drop("crossed"), "absorbed")


def _boundaries(pattern: str) -> str:
    return f"SELECT doc_id, z FROM (SELECT doc_id, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS z, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS more FROM (SELECT doc_id, unnest({_tokens(pattern)}) AS p, generate_subscripts({_tokens(pattern)}, 1) AS i FROM documents)) WHERE more IS NOT NULL"


@query(f"WITH a AS ({_boundaries(_MERGED)}), b AS ({_boundaries(_SCORED)}), j AS (SELECT doc_id, count(*) FILTER (a.z IS NOT NULL AND b.z IS NOT NULL) AS agree, count(*) FILTER (a.z IS NULL) AS nest, count(*) FILTER (b.z IS NULL) AS conflict FROM a FULL JOIN b USING (doc_id, z) GROUP BY doc_id), n AS (SELECT doc_id, len({_tokens(_MERGED)}) AS n_a, len({_tokens(_SCORED)}) AS n_b, greatest(length(text) - 1, 0) AS positions FROM documents) SELECT doc_id, n_a::INT AS n_a, n_b::INT AS n_b, round(abs(n_a - n_b) / ((n_a + n_b) / 2), 6) AS gap, positions::INT AS positions, coalesce(agree, 0)::INT AS agree_cut, coalesce(nest, 0)::INT AS nest, coalesce(conflict, 0)::INT AS conflict, (positions - coalesce(agree, 0) - coalesce(nest, 0) - coalesce(conflict, 0))::INT AS agree_merge FROM n LEFT JOIN j USING (doc_id)")
def pair_contrast(spark, sf_dir):
    """Both arms on every document: how many tokens, and where their boundaries agree, by characters."""
    both = tokenizers.ends(table(spark, sf_dir, "documents"), "text", {"a": merging(), "b": scoring()}, keep=["doc_id"])
    return rounded(emission.contrast_of_ends(both, ["doc_id"], "a", "b"), "gap")


_IDS = _named(_BASE)


@query(f"SELECT DISTINCT piece, replace(piece, ' ', '') AS decoded, array_to_string(list_transform(regexp_extract_all(piece, '{_MERGED}'), lambda p: (list_position({_named([*_BASE, *[a + b for a, b in MERGES]])}, p) - 1)::VARCHAR), ' ') AS ids FROM (SELECT DISTINCT piece FROM ({_WORDS}) WHERE NOT regexp_matches(piece, '[0-9]'))")
def decoded_words(spark, sf_dir):
    """Ids of every distinct word without digits, and the word again from them."""
    own = merging()
    found = tokenizers.encode(words(spark, sf_dir).select("piece").where(~F.col("piece").rlike("[0-9]")).distinct(), "piece", own, keep=["piece"], fields=("id",)).select("piece", F.col("tokens.id").alias("ids"))
    back = F.pandas_udf(lambda ids: ids.map(lambda x: own.decode(list(x))), "string")
    return found.select("piece", back("ids").alias("decoded"), F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


_ALPHABET = _named([("[UNK]",), *[(g,) for g in sorted(lexing.GLYPHS)]])


@query(f"SELECT t, array_to_string(list_transform(g, lambda x: coalesce(list_position({_ALPHABET}, x) - 1, -1)::VARCHAR), ' ') AS ids FROM ({GLYPHS})")
def base_tokens(spark, sf_dir):
    """Every spelling under the tokenizer without merges; a sign that the alphabet lacks has id -1."""
    found = tokenizers.encode(notations(spark, sf_dir), "t", tokenizers.build("atomic"), keep=["t"], fields=("id",))
    return found.select("t", F.array_join(F.transform("tokens.id", lambda i: i.cast("string")), " ").alias("ids"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, '{''.join(a)}', '{''.join(b)}', '{''.join(a + b)}')" for k, (a, b) in enumerate(MERGES)) + ") AS m(rank, l, r, made)")
def merge_ranks(spark, sf_dir):
    """Merges by rank, their ids resolved over the vocabulary's table."""
    own = merging()
    pieces = own.vocabulary(spark).select("token_id", F.array_join("piece", "").alias("surface"))
    at = lambda c, name: pieces.select(F.col("token_id").alias(f"_{name}"), F.col("surface").alias(name))
    found = own.merge_table(spark)
    for c, name in (("left", "l"), ("right", "r"), ("new_id", "made")):
        found = found.join(at(c, name), F.col(c) == F.col(f"_{name}"))
    return found.select("rank", "l", "r", "made")


#: The lattice of the scoring arm, letter by letter: sums of the last four places, and their entropies.
_STEP = {n: "CASE " + " ".join(f"WHEN substr(w, i + 1 - {n - 1}, {n}) = '{p}' THEN {-11.0 - len(p) / 8}" for p in PIECES if len(p) == n) + " END" for n in (2, 3, 4)}
_WAYS = ["t1 - 10", *[f"CASE WHEN i + 1 >= {n} THEN t{n} + {_STEP[n]} END" for n in (2, 3, 4)]]
_TOP = f"greatest({', '.join(_WAYS)})"
_SUM = " + ".join(f"coalesce(exp({w} - m), 0)" for w in ("w1", "w2", "w3", "w4"))
_ENTROPY = " + ".join(f"coalesce(exp(w{k} - z) * (e{k} - (w{k} - z)), 0)" for k in (1, 2, 3, 4))
_LATTICE = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT DISTINCT c AS w FROM (SELECT unnest(regexp_extract_all(piece, '{CHUNK}')) AS c FROM ({_WORDS})) WHERE NOT regexp_matches(c, 'Cl|Br')),
    r(w, i, t1, t2, t3, t4, e1, e2, e3, e4) AS (
        SELECT w, 0, 0.0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM d
        UNION ALL
        SELECT w, i + 1, z, t1, t2, t3, {_ENTROPY}, e1, e2, e3 FROM (
            SELECT *, m + ln({_SUM}) AS z FROM (SELECT *, greatest(w1, w2, w3, w4) AS m FROM (SELECT *, {', '.join(f'{w}::DOUBLE AS w{k}' for k, w in enumerate(_WAYS, 1))} FROM r WHERE i < length(w))))
    )"""


@query(f"{_LATTICE} SELECT w AS chunk, round(e1, 6) AS entropy FROM r WHERE i = length(w)")
def chunk_entropies(spark, sf_dir):
    """The entropy over all segmentations of every distinct chunk of words."""
    counted = tokenizers.chunk_table(words(spark, sf_dir), "piece").withColumn("chunk", F.array_join("glyphs", "")).where(~F.col("chunk").rlike("Cl|Br"))
    return rounded(tokenizers.chunk_entropies(counted.select("chunk", "glyphs"), scoring()).select("chunk", "entropy"), "entropy")


@query(f"{_LATTICE}, o AS (SELECT lang, unnest(regexp_extract_all(piece, '{CHUNK}')) AS c FROM ({_WORDS}) WHERE NOT regexp_matches(piece, 'Cl|Br')) SELECT lang, round(sum(e1), 3) AS entropy, sum(length(c))::BIGINT AS n_glyphs FROM o JOIN r ON r.w = o.c AND r.i = length(r.w) GROUP BY lang")
def segmentation_entropy(spark, sf_dir):
    """Entropies summed over the words of each language, each distinct chunk's made once."""
    rows = words(spark, sf_dir).where(~F.col("piece").rlike("Cl|Br"))
    found = tokenizers.segmentation_entropy(rows, "lang", "piece", scoring())
    return found.select("lang", F.round("entropy", 3).alias("entropy"), "n_glyphs")


#: Merges of a trained tokenizer that the SQL follows.
FIRST = 16


def _chain(first: int) -> str:
    """SQL: words as ids with a space on either side; each step counts neighbours, takes the most frequent pair (of equal ones the smaller), and replaces it."""
    steps = [
        f"""w AS MATERIALIZED (SELECT piece, count(*) AS n FROM ({_WORDS}) GROUP BY piece), b AS MATERIALIZED (SELECT c, row_number() OVER (ORDER BY c) AS id FROM (SELECT DISTINCT unnest(string_split(piece, '')) AS c FROM w)),
        s0 AS MATERIALIZED (SELECT any_value(n) AS n, string_agg(' ' || id || ' ', '' ORDER BY i) AS s FROM (SELECT piece, n, unnest(string_split(piece, '')) AS c, generate_subscripts(string_split(piece, ''), 1) AS i FROM w) JOIN b USING (c) GROUP BY piece)"""
    ]
    for k in range(first):
        steps.append(f"p{k} AS MATERIALIZED (SELECT x[i]::INT AS l, x[i + 1]::INT AS r, sum(n)::BIGINT AS freq FROM (SELECT n, string_split(trim(s), '  ') AS x FROM s{k}), unnest(range(1, len(x))) AS u(i) GROUP BY ALL ORDER BY freq DESC, l, r LIMIT 1)")
        steps.append(f"s{k + 1} AS MATERIALIZED (SELECT n, replace(s, ' ' || l || '  ' || r || ' ', ' ' || ((SELECT count(*) FROM b) + {k + 1}) || ' ') AS s FROM s{k}, p{k})")
    rows = " UNION ALL ".join(f"SELECT {k + 1}::INT AS step, l AS a, r AS b, ((SELECT count(*) FROM b) + {k + 1})::INT AS new_id, freq FROM p{k}" for k in range(first))
    return f"WITH {', '.join(steps)} {rows}"


@query(_chain(64))
def distributed_merges(spark, sf_dir):
    """The first merges of a BPE tokenizer of all words, whose words stay distributed."""
    table_ = _chunks(spark, sf_dir)
    base = table_.select(F.explode("glyphs").alias("g")).distinct().count()
    own = bpe.train_bpe(table_, base + 1 + 64)
    return spark.createDataFrame([(r["step"], r["pair"][0], r["pair"][1], r["new_id"], r["candidate_freq"]) for r in own.log], "step int, a int, b int, new_id int, freq long")


@query(_chain(FIRST))
def first_merges(spark, sf_dir):
    """The first merges of a BPE tokenizer of all words: pairs, new ids and counts."""
    table_ = _chunks(spark, sf_dir)
    base = table_.select(F.explode("glyphs").alias("g")).distinct().count()
    own = tokenizers.build("bpe", table_, size=base + 1 + FIRST)
    return spark.createDataFrame([(r["step"], r["pair"][0], r["pair"][1], r["new_id"], r["candidate_freq"]) for r in own.log], "step int, a int, b int, new_id int, freq long")


@query(f"WITH w AS (SELECT piece, count(*) AS n FROM ({_WORDS}) GROUP BY piece) SELECT substr(piece, i, k) AS piece, sum(n)::BIGINT AS n FROM w, unnest(range(1, length(piece) + 1)) AS t(i), unnest(range(1, least(16, length(piece) - i + 1) + 1)) AS u(k) GROUP BY 1 HAVING sum(n) >= 2 OR length(substr(any_value(piece), any_value(i), any_value(k))) = 1")
def unigram_seeds(spark, sf_dir):
    """What a Unigram model is seeded with: the substrings of all words that occur twice, and single letters, with their counts."""
    found = seeds.substring_counts(_chunks(spark, sf_dir).select(F.col("glyphs").alias("run"), "n"))
    return found.select(F.array_join("piece", "").alias("piece"), "n")
