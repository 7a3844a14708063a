"""Queries of sources and sinks, with their SQL: tables are written to the shared folder in a source's format and read back."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from lexforge.plans.catalog import query, table
from lexforge.session import shared_path
from lexforge.sources import artifacts, delimited, shard_writer, sinks

_LINE = r"regexp_replace(text, '[\t\n\r]', ' ', 'g')"


def _stamp() -> Column:
    return F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")


def _one_line(spark, sf_dir) -> DataFrame:
    """Documents whose texts have no tab or line end."""
    return table(spark, sf_dir, "documents").withColumn("text", F.regexp_replace("text", r"[\t\n\r]", " "))


def _written_lines(df: DataFrame, path: str, *columns: str, compression: str = "none") -> str:
    """Tab-separated lines as they are, without quotes."""
    df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])).write.option("compression", compression).text(path)
    return path


@query(f"SELECT doc_id::VARCHAR AS source_id, {_LINE} AS text, 'own' AS source FROM documents WHERE length(text) > 0")
def delimited_positional(spark, sf_dir):
    """A compressed file set, id first, without a header, read verbatim."""
    path = _written_lines(_one_line(spark, sf_dir), shared_path(spark, "tsv"), "doc_id", "text", compression="gzip")
    return delimited.ingest(spark, delimited.Delimited("own", path, verbatim=True), _stamp()).drop("ingest_ts")


@query(f"SELECT doc_id AS id, {_LINE} AS text FROM documents")
def delimited_text_first(spark, sf_dir):
    """The text first, the id as a number; empty texts come as nulls and are kept."""
    path = _written_lines(_one_line(spark, sf_dir), shared_path(spark, "tsv"), "text", "doc_id")
    found = delimited.scan(spark, delimited.Delimited("own", path, id_first=False, id_type="long", verbatim=True))
    return found.select("id", F.coalesce("text", F.lit("")).alias("text"))


@query(f"SELECT doc_id::VARCHAR AS source_id, {_LINE} AS text, 'own' AS source FROM documents WHERE length(text) > 0")
def delimited_named(spark, sf_dir):
    """Two columns by name out of four, names normalised."""
    path = shared_path(spark, "csv")
    _one_line(spark, sf_dir).select(F.col("lang").alias("The Lang"), F.col("text").alias("Text (raw)"), F.col("doc_id").alias("Doc-ID"), "source").write.options(sep="\t", header="true", escape='"').csv(path)
    own = delimited.Delimited("own", path, mode="named", header=True, id_column="doc_id", text_column="text_raw", normalize_names=True, options={"escape": '"'})
    return delimited.ingest(spark, own, _stamp()).drop("ingest_ts")


@query("SELECT lang, count(*) AS n_rows, count(*) FILTER (length(text) > 0) AS n_kept FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def file_set_tallies(spark, sf_dir):
    """A file set of one folder a language, in one scan."""
    path = shared_path(spark, "set")
    docs = _one_line(spark, sf_dir).where("lang is not null")
    docs.select("lang", F.concat_ws("\t", "doc_id", "text").alias("value")).write.partitionBy("lang").text(path)
    found = delimited.file_tallies(spark, delimited.Delimited("own", path, verbatim=True))
    return found.groupBy(F.regexp_extract("file", "lang=([^/]*)", 1).alias("lang")).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_kept").alias("n_kept"))


def _tranches(spark, sf_dir) -> tuple[DataFrame, dict[str, delimited.Delimited]]:
    """A list of tranches, one a source, and what to read for each."""
    docs, folder = _one_line(spark, sf_dir).where("source is not null"), shared_path(spark, "tranches")
    names = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    listed = names.select(F.concat_ws("\t", "source", F.lit("g1"), F.lit("H05"), F.lit("M100"), F.concat(F.lit(f"{folder}/source="), "source"), "n").alias("value"))
    head = "\t".join(c.split()[0] for c in delimited.TRANCHES.split(", "))
    path = sinks.put_text(spark, f"{shared_path(spark, 'list')}/tranches.tsv", "\n".join([head, *sorted(r["value"] for r in listed.collect())]) + "\n")
    docs.select("source", F.concat_ws("\t", "doc_id", "text").alias("value")).write.partitionBy("source").text(folder)
    table_ = delimited.tranche_list(spark, path)
    return table_, {r["tranche_id"]: delimited.Delimited(r["tranche_id"], r["url"], verbatim=True) for r in table_.collect()}


@query("SELECT source AS tranche_id, 'g1' AS generation, 'H05' AS heavy_atom_bin, 'M100' AS logp_bin, count(*) AS expected_bytes FROM documents WHERE source IS NOT NULL GROUP BY source")
def tranche_list(spark, sf_dir):
    return _tranches(spark, sf_dir)[0].drop("url")


@query(f"SELECT doc_id::VARCHAR AS source_id, {_LINE} AS text, source AS tranche_id FROM documents WHERE length(text) > 0 AND source IS NOT NULL AND source <> 'src0'")
def tranches(spark, sf_dir):
    """All tranches but one that is done; one that isn't there fails by itself."""
    _, sources = _tranches(spark, sf_dir)
    found, failed = delimited.tranches(spark, sources | {"absent": delimited.Delimited("absent", shared_path(spark, "absent"))}, done={"src0"}, ingest_ts=_stamp())
    if list(failed) != ["absent"]:
        raise ValueError(f"other tranches failed: {failed}")
    return found.select("source_id", "text", "tranche_id")


@query("SELECT DISTINCT source AS tranche_id FROM documents WHERE source IS NOT NULL AND source NOT IN (SELECT source FROM documents WHERE source IS NOT NULL AND lang = 'de' AND doc_id % 10 = 3) AND source NOT IN ('src1', 'src2')")
def unused_tranches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("tranche_id"), "lang", "doc_id")
    return delimited.unused(docs.select("tranche_id").distinct(), docs.where("lang = 'de' and doc_id % 10 = 3").select("tranche_id").distinct(), ["src1", "src2"])


def _published(spark, sf_dir) -> str:
    path = shared_path(spark, "stage")
    sinks.publish(spark, table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path, rows_per_shard=300, order=["doc_id"])
    return path


@query("SELECT doc_id, length(text)::INT AS n, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS seq FROM documents")
def published_in_sequence(spark, sf_dir):
    """A stage in shards, reread with the number of each row in the order of files and rows."""
    found = delimited.with_sequence(delimited.union(spark, [_published(spark, sf_dir)]))
    return found.select("doc_id", F.length("text").alias("n"), "seq")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def first_rows(spark, sf_dir):
    return delimited.first_rows(delimited.with_sequence(delimited.union(spark, [_published(spark, sf_dir)])), 100).select("doc_id")


@query("SELECT count(*) AS n_rows, count(*) AS in_shards, true AS complete FROM documents")
def stage_counts(spark, sf_dir):
    """Rows of a stage from its footers, from its shards, and whether its manifest is whole."""
    path = _published(spark, sf_dir)
    found = sinks.shards(spark, path)
    sinks.verify_shards(found, found)
    manifest = sinks.write_manifest(path, name="documents", schema="raw_v1", found=found, spark=spark)
    rows = [(delimited.row_count(spark, path), artifacts.manifest(f"{path}/{sinks.STATE}", spark)[1]["n_rows"], artifacts.complete(f"{path}/{manifest.name}", spark=spark))]
    return spark.createDataFrame(rows, "n_rows long, in_shards long, complete boolean")


@query("SELECT doc_id, floor(coalesce(sum(b) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 20000)::INT AS shard FROM (SELECT doc_id, length(to_json({'doc_id': doc_id, 'lang': lang})::VARCHAR) AS b FROM documents WHERE lang IS NOT NULL)")
def shards_by_bytes(spark, sf_dir):
    return sinks.by_bytes(table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", "lang"), 20_000, ["doc_id"]).select("doc_id", "shard")


@query("SELECT lang || '__' || source AS pair_key, count(*) AS n, avg(n_chars) AS x FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1")
def json_records(spark, sf_dir):
    """Records as JSON files, one that can't be parsed among them."""
    path = shared_path(spark, "records")
    pairs = table(spark, sf_dir, "documents").where("lang is not null and source is not null").groupBy(F.concat_ws("__", "lang", "source").alias("pair_key")).agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("x"))
    pairs.repartition(64, "pair_key").write.option("maxRecordsPerFile", 1).json(path)
    sinks.put_text(spark, f"{path}/broken.json", "{not json")
    found = artifacts.json_records(spark, path, "pair_key string, n long, x double").cache()
    if found.where("_corrupt_record is not null").count() != 1:
        raise ValueError("the broken record wasn't told")
    return found.where("_corrupt_record is null").drop("_corrupt_record")


@query("SELECT doc_id AS step, doc_id::INT AS new_id, lang AS new_token, n_chars AS candidate_freq, doc_id % 97 AS changed FROM documents WHERE lang IS NOT NULL")
def scaffold_log(spark, sf_dir):
    """Documents as the merges of a log, with its header line."""
    path = shared_path(spark, "log")
    docs = table(spark, sf_dir, "documents").where("lang is not null")
    rows = docs.select(F.col("doc_id").alias("step"), F.array((F.col("doc_id") % 7).cast("int"), F.lit(1)).alias("pair"), F.col("doc_id").cast("int").alias("new_id"), F.col("lang").alias("new_token"), F.col("n_chars").alias("candidate_freq"), F.array(F.array(F.col("doc_id") % 97, F.lit(-1).cast("long"))).alias("standalone"))
    rows.write.json(path)
    head = {"format": artifacts.SCAFFOLD_FORMAT, "min_frequency": 2, "vocab_size": 256, "merge_brackets": False, "base_alphabet": [[0, "C"], [1, "O"]]}
    sinks.put_text(spark, f"{path}/header.json", json.dumps(head))
    found, records = artifacts.scaffold_log(spark, path)
    if found["base_alphabet"] != [(0, "C"), (1, "O")] or found["vocab_size"] != 256:
        raise ValueError("the header differs")
    return records.select("step", "new_id", "new_token", "candidate_freq", F.col("standalone")[0][0].alias("changed"))


#: Letters as base pieces, each language's name made of its two letters, and twice that.
_ARTIFACT = "SELECT (row_number() OVER (ORDER BY c) - 1)::INT AS token_id, c AS surface, 1::INT AS n_glyphs FROM (SELECT DISTINCT unnest(string_split(lang, '')) AS c FROM documents WHERE lang IS NOT NULL)"
_NAMES = "SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL"


@query(f"WITH b AS ({_ARTIFACT}), n AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS k, (SELECT count(*) FROM b) AS base, count(*) OVER () AS many FROM ({_NAMES})) SELECT * FROM b UNION ALL SELECT (base + k)::INT, lang, 2::INT FROM n UNION ALL SELECT (base + many + k)::INT, lang || lang, 4::INT FROM n")
def bpe_artifact(spark, sf_dir):
    """An artifact of merges of merges, read as a table of pieces."""
    names = sorted(r[0] for r in table(spark, sf_dir, "documents").select("lang").where("lang is not null").distinct().collect())
    letters = sorted({c for n in names for c in n})
    first = len(letters)
    merges = [[letters.index(n[0]), letters.index(n[1])] for n in names] + [[first + k, first + k] for k in range(len(names))]
    text = json.dumps({"model": {"vocab": {c: i for i, c in enumerate(letters)}, "merges": merges}})
    return artifacts.bpe_vocabulary(spark, text).select("token_id", F.array_join("glyphs", "").alias("surface"), "n_glyphs")


@query("SELECT (row_number() OVER (ORDER BY lang) - 1)::INT AS token_id, lang AS surface, 2::INT AS n_glyphs, n / 8.0::DOUBLE AS score FROM (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang)")
def unigram_artifact(spark, sf_dir):
    counted = table(spark, sf_dir, "documents").where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()
    text = json.dumps({"model": {"type": "Unigram", "vocab": [{"glyphs": list(r["lang"]), "score": r["n"] / 8} for r in counted]}})
    return artifacts.unigram_vocabulary(spark, text).select("token_id", F.array_join("glyphs", "").alias("surface"), "n_glyphs", "score")


@query(f"SELECT {_LINE} AS line, count(*) AS n FROM documents GROUP BY 1")
def text_lines(spark, sf_dir):
    """Texts written one a line, and read again."""
    path = shared_path(spark, "lines")
    sinks.lines(_one_line(spark, sf_dir), "text", path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def cached_by_fingerprint(spark, sf_dir):
    """What is kept under a fingerprint is what is read, whatever is asked for later under it."""
    path, docs = shared_path(spark, "cache"), table(spark, sf_dir, "documents")
    counts = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sinks.cached_by(spark, counts, path, "f1")
    sinks.cached_by(spark, counts.where("false"), path, "f2")
    return sinks.cached_by(spark, counts.where("false"), path, "f1")


@query("WITH r AS (SELECT row_number() OVER (ORDER BY lang) AS i, '| ' || lang || ' | ' || n || ' | ' || printf('%.4f', x) || ' | — |' AS line FROM (SELECT lang, count(*) AS n, (sum(n_chars) / 16)::DOUBLE AS x FROM documents WHERE lang IS NOT NULL GROUP BY lang)) SELECT (i + 2)::INT AS i, line FROM r UNION ALL VALUES (1, '| lang | n | x | none |'), (2, '|---|---|---|---|')")
def rendered_table(spark, sf_dir):
    """A topic's table, line by line."""
    rows = table(spark, sf_dir, "documents").where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), (F.sum("n_chars") / 16).alias("x")).orderBy("lang").collect()
    text = sinks.markdown([r.asDict() | {"none": None} for r in rows], [("lang", ""), ("n", ""), ("x", ".4f"), ("none", ".4f")])
    return spark.createDataFrame(list(enumerate(text.splitlines(), 1)), "i int, line string")


@query("SELECT doc_id, length(text)::INT AS n_chars, md5(text) AS digest, 0 AS n_changed FROM documents")
def byte_shards(spark, sf_dir):
    """All documents written as shards of a megabyte, read back by the manifest, and shards that differ from it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = shared_path(spark, "byte-shards")
    shard_writer.write_shards(docs, folder, target_bytes=1 << 20)
    differ = len(shard_writer.changed(spark, folder))
    return shard_writer.listed(spark, folder, docs.schema).select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"), F.lit(differ).alias("n_changed"))
