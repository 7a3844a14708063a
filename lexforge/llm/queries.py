"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexforge.llm import funnel, hamerly, langid, mixing, permindex, quality, secrets, simhash, spm, substring, suffix, syncmer, warc


#: The SentencePiece model of op9 and the pipeline.
MODEL = os.environ.get("LEXFORGE_SPM_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    read = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document: doc_id, held_out, lang_pred, score."""
    return langid.identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of fingerprints of 4-word shingles at 4 or fewer differing bits: doc_id, fingerprint, component_id."""
    found = simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4, width=1, radii=(4,), blocks=6, similarity=None)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated passages of 50 words: doc_id, n_words, n_removed, kept_sha256."""
    found = substring.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document: doc_id, score, accepted."""
    return quality.classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate in every document, scored: doc_id, start, length, value_sha256, score, is_secret."""
    found = secrets.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "start", "length", F.sha2(F.encode("value", "UTF-8"), 256).alias("value_sha256"), "score", "is_secret")


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint against its edited text's and its next document's."""
    found = syncmer.edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "in_place")


def op8_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector: query_id, rank, vec_id, score."""
    return permindex.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=20, k=20)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: doc_id, n_ids, ids_sha256 (of the ids joined by one space) and decoded_sha256 (of the decoded text)."""
    return spm.round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), MODEL)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: doc_id, size, source_size, target, taken."""
    mixed = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of 64 components in one of 8 clusters, after 10 rounds: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    return hamerly.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=8, rounds=10, components=64, seed="3")


def op12_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document's bytes without repeated strings of 50 bytes: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    found = suffix.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), least=50)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The funnels of op13, and how long an attempt may take in microseconds.
FUNNELS = [
    funnel.Funnel("A", ("view", "click", "view", "purchase"), ("error",)),
    funnel.Funnel("B", ("signup", "view", "click", "purchase"), ("error",)),
    funnel.Funnel("C", ("click", "click", "purchase", "view"), ("signup",)),
]
WITHIN = 5 * 60 * 1_000_000


def op13_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three funnels of four steps over all clicks: funnel, client_id, n1 to n4, deepest, t2 to t4, same_depth."""
    return funnel.counted(spark.read.parquet(f"{sf_dir}/clicks.parquet"), FUNNELS, percent=25, window=WITHIN).withColumnRenamed("client", "client_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_language_id": op2_language_id,
    "op3_simhash": op3_simhash,
    "op4_substring": op4_substring,
    "op5_quality": op5_quality,
    "op6_secrets": op6_secrets,
    "op7_syncmers": op7_syncmers,
    "op8_permutation_index": op8_permutation_index,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_mixing": op10_mixing,
    "op11_centroids": op11_centroids,
    "op12_suffix": op12_suffix,
    "op13_funnels": op13_funnels,
}

_FUNNEL_ROWS = ", ".join(f"('{f.name}', {list(f.steps)}, '{f.excluded[0]}')" for f in FUNNELS)


def _next_step(k: int) -> str:
    """SQL: of the attempts at step k, whether and when they reach the next."""
    return f"""
        a{k + 1} AS (
            SELECT a.*, CASE WHEN a.t{k} IS NOT NULL AND n.t - a.t1 <= {WITHIN} AND (x.t IS NULL OR x.t > n.t) THEN n.t END AS t{k + 1}
            FROM a{k} a ASOF LEFT JOIN e n ON n.client_id = a.client_id AND n.kind = a.steps[{k + 1}] AND a.t{k} < n.t
            ASOF LEFT JOIN e x ON x.client_id = a.client_id AND x.kind = a.bad AND a.t{k} < x.t
        )"""


def _round_sql(k: int) -> str:
    """SQL: the centroids after round k, from those before."""
    return f"""
        near{k} AS MATERIALIZED (
            SELECT v.n, min_by(c.cluster, {_AWAY} * 8 + c.cluster) AS cluster FROM v, c{k} c GROUP BY v.n
        ), sums{k} AS (
            SELECT cluster, i, sum(x[i]::HUGEINT) AS s, count(*) AS n FROM v JOIN near{k} USING (n), unnest(range(1, 65)) AS t(i) GROUP BY cluster, i
        ), means{k} AS (
            SELECT cluster, list(floor_div ORDER BY i) AS x FROM (SELECT cluster, i, ((s - ((s % n) + n) % n) // n)::DOUBLE AS floor_div FROM sums{k}) GROUP BY cluster
        ), c{k + 1} AS MATERIALIZED (
            SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN means{k} m USING (cluster)
        )"""


#: Squared distance in doubles, exact for whole numbers below 2 ** 53.
_AWAY = "(list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x))"

ORACLES: dict[str, str] = {
    "op1_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), h AS (
            SELECT payload_digest, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
        )
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, p.payload_digest,
               CASE WHEN page_id IS DISTINCT FROM head AND head IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM head THEN head END AS refers_to
        FROM p LEFT JOIN h ON h.payload_digest = p.payload_digest AND p.payload_bytes >= 1000
    """,
    "op4_substring": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), s AS (
            SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS win FROM w, unnest(range(1, len(words) - 48)) AS t(i)
        ), m AS (
            SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM s
        ), g AS (
            SELECT doc_id, list(DISTINCT i + k) AS gone FROM m, unnest(range(0, 50)) AS u(k) WHERE first < doc_id GROUP BY doc_id
        ), p AS (
            SELECT doc_id, words[j] AS word, j, coalesce(list_contains(gone, j), false) AS out
            FROM w LEFT JOIN g USING (doc_id), unnest(range(1, len(words) + 1)) AS v(j)
        ), k AS (
            SELECT doc_id, count(*) FILTER (out) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT out), '') AS kept FROM p GROUP BY doc_id
        )
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN k USING (doc_id)
    """,
    # the index itself, as one block holds it: pivots, posts, footrule over the files read, and the rerank
    "op8_permutation_index": f"""
        WITH v AS (
            SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), g AS (
            SELECT v, min(vec_id) AS id, count(*) OVER () AS n FROM v GROUP BY v
        ), p AS (
            SELECT v, row_number() OVER (ORDER BY md5(id::VARCHAR), id) AS k FROM g QUALIFY k <= {permindex.PIVOTS}
        ), l AS (
            SELECT g.id, k, row_number() OVER (PARTITION BY g.id ORDER BY list_inner_product(g.v, p.v) / sqrt(list_inner_product(g.v, g.v)) / sqrt(list_inner_product(p.v, p.v)) DESC, k) - 1 AS place
            FROM g, p QUALIFY place < {permindex.POST}
        ), q AS (
            SELECT vec_id AS query_id, v.v, id FROM v JOIN g ON g.v = v.v WHERE vec_id % 20 = 0
        ), a AS (
            SELECT query_id, c.id, sum(abs(c.place - f.place) - (least({permindex.POST}, (SELECT count(*) FROM p)) - f.place)) AS away
            FROM q JOIN l f ON f.id = q.id AND f.place < {permindex.READ} JOIN l c ON c.k = f.k GROUP BY ALL
        ), r AS (
            SELECT q.query_id, q.v AS q, g.v AS c FROM q CROSS JOIN g LEFT JOIN a ON a.query_id = q.query_id AND a.id = g.id
            QUALIFY rank() OVER (PARTITION BY q.query_id ORDER BY coalesce(away, 0)) <= {permindex.LEAST} * 20 + ceil({permindex.SHARE} * g.n)
        ), s AS (
            SELECT query_id, vec_id, list_sum(list_transform(list_zip(q, c), lambda z: z[1] * z[2])) AS score FROM r JOIN v ON v.v = r.c WHERE vec_id <> query_id
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
        QUALIFY rank <= 20
    """,
    "op10_mixing": """
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 12))::BIGINT AS hash
            FROM documents
        ), t AS (
            SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source
        ), w AS (
            SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM t
        ), c AS (
            SELECT *, sum(s) OVER ()::DOUBLE AS total, sum(weight) OVER () AS all_weight,
                   coalesce(sum(s) OVER b, 0)::DOUBLE AS capped, coalesce(sum(weight) OVER b, 0) AS capped_weight
            FROM w WINDOW b AS (ORDER BY s / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), l AS (
            SELECT *, (total - 3.0::DOUBLE * capped) / (all_weight - capped_weight) AS level FROM c
        ), f AS (
            SELECT min_by(level, capped_weight) AS final FROM l WHERE level * weight <= 3.0::DOUBLE * s
        ), g AS (
            SELECT source, s, CASE WHEN final IS NULL THEN 3.0::DOUBLE * s ELSE least(3.0::DOUBLE * s, final * weight) END AS target FROM l LEFT JOIN f ON true
        ), r AS (
            SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS whole FROM g
        ), p AS (
            SELECT source, hash, sum(size) AS own, sum(sum(size)) OVER (PARTITION BY source ORDER BY hash) AS upto FROM d GROUP BY source, hash
        ), e AS (
            SELECT p.source, hash, target - whole * s AS rest, upto <= target - whole * s AS fits,
                   upto - own <= target - whole * s AND upto > target - whole * s AND own > 0 AND upto - (target - whole * s) <= (target - whole * s) - (upto - own) AS nearer
            FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source
        ), x AS (
            SELECT source, max(hash) FILTER ((fits OR nearer) AND rest > 0) AS bound FROM e GROUP BY source
        )
        SELECT doc_id, size, s AS source_size, target, (size * (whole + (hash <= coalesce(bound, -1))::INT))::BIGINT AS taken
        FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN x ON x.source IS NOT DISTINCT FROM r.source
    """,
    "op11_centroids": f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS cluster, x FROM v WHERE vec_id IS NOT NULL QUALIFY cluster < 8
        ), {", ".join(_round_sql(k) for k in range(10))}, f AS (
            SELECT v.n, vec_id, min_by(c.cluster, {_AWAY} * 8 + c.cluster) AS cluster, min({_AWAY})::BIGINT AS distance FROM v, c10 c GROUP BY v.n, vec_id
        ), h AS (
            SELECT cluster, sha256(array_to_string(x::BIGINT[], ',')) AS centroid_sha256 FROM c10
        )
        SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
               (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM f JOIN h USING (cluster)
    """,
    "op12_suffix": """
        WITH d AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS b FROM documents
        ), c AS (
            SELECT doc_id, o, substr(b, 2 * o + 1, 698) AS b FROM d, unnest(range(0, strlen(b) // 2 - 49, 300)) AS t(o)
        ), w AS (
            SELECT doc_id, o + i AS i, min(doc_id) OVER (PARTITION BY substr(b, 2 * i + 1, 100)) AS first FROM c, unnest(range(0, least(300, strlen(b) // 2 - 49))) AS t(i)
        ), s AS (
            SELECT doc_id, i, i - lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) > 50 AS new FROM w WHERE first < doc_id
        ), g AS (
            SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM s
        ), r AS (
            SELECT doc_id, min(i) AS lo, max(i) + 50 AS hi FROM g GROUP BY doc_id, span
        ), p AS (
            SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS begin FROM r
        ), k AS (
            SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, string_agg(substr(b, 2 * begin + 1, 2 * (lo - begin)), '' ORDER BY lo) || substr(any_value(b), 2 * max(hi) + 1) AS kept
            FROM p JOIN d USING (doc_id) GROUP BY doc_id
        )
        SELECT doc_id, (strlen(b) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, b))) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)
    """,
    "op13_funnels": f"""
        WITH e AS (
            SELECT DISTINCT client_id, kind, epoch_us(arrived_at) AS t FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND arrived_at IS NOT NULL
        ), f(funnel, steps, bad) AS (
            VALUES {_FUNNEL_ROWS}
        ), a1 AS (
            SELECT funnel, steps, bad, client_id, t AS t1 FROM f JOIN e ON kind = steps[1]
        ), {", ".join(_next_step(k) for k in (1, 2, 3))}, g AS (
            SELECT funnel, client_id, count(t1) AS n1, count(t2) AS n2, count(t3) AS n3, count(t4) AS n4,
                   max(CASE WHEN t4 IS NOT NULL THEN 4 WHEN t3 IS NOT NULL THEN 3 WHEN t2 IS NOT NULL THEN 2 ELSE 1 END)::INT AS deepest,
                   list_sort(list(t2 - t1) FILTER (t2 IS NOT NULL)) AS d2, list_sort(list(t3 - t2) FILTER (t3 IS NOT NULL)) AS d3, list_sort(list(t4 - t3) FILTER (t4 IS NOT NULL)) AS d4
            FROM a4 GROUP BY funnel, client_id
        )
        SELECT funnel, client_id, n1, n2, n3, n4, deepest, d2[((25 * n2 + 99) // 100)::INT] AS t2, d3[((25 * n3 + 99) // 100)::INT] AS t3, d4[((25 * n4 + 99) // 100)::INT] AS t4,
               count(*) OVER (PARTITION BY funnel, deepest) AS same_depth
        FROM g
    """,
}
