"""A training-data pipeline over documents: quality, near-duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on everything that the one
before kept; what it returns is written as Parquet and read again. All but the
last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexforge.llm import mixing, quality, secrets, simhash, spm
from lexforge.llm.queries import MODEL
from lexforge.session import shared_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it is trained on the stage's own input.

    Null and empty texts have score 0 and go; repeated rows go or stay together, and
    a score at the limit stays. Texts of any length are judged whole. Any other column
    stays as it is, whatever its name, and an empty table stays empty.
    """
    return quality.keep_accepted(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (shingles of five words, similarity 0.8) the document with the smallest doc_id stays; of repeated rows of that id, one.

    Null ids stay where no other id is alike; all null and empty texts are alike.
    Of rows equal in id and text the first by its other columns stays. Texts of any
    length are compared whole; other columns stay, whatever their names. An empty
    table stays empty.
    """
    return simhash.keep_representatives(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; n_chars follows the new text. No document goes.

    Null and empty texts, null paths and repeated rows stay as they are; texts of any
    length are read whole, and a score at the limit is a secret's. Other columns
    stay, whatever their names, and an empty table stays empty.
    """
    redacted = secrets.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else redacted


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times; those it takes 0 times are gone.

    Null sources are a source of their own; texts without words have size 0 and
    are in as often as their source's other documents below the threshold. Equal
    hashes, as of repeated rows, are in alike. A text of any length counts whole; other columns stay,
    whatever their names, and an empty table stays empty. Without a column
    ``source`` it is an error.
    """
    return mixing.apply_mix(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document encoded: doc_id, source, n_ids, ids.

    A null or empty text has no ids; repeated rows are encoded alike, and texts of any
    length whole. An empty table gives no rows; other columns, whatever their
    names, are left out. Without a column ``source`` it is an error.
    """
    encoded = spm.encode(docs, MODEL, keep=("source",))
    return encoded.select("doc_id", "source", F.size("ids").alias("n_ids"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("secret scans", secrets_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", tokens_stage),
]

#: No stage but the secrets' pattern can be said in SQL: the pipeline is tested against brute force, stage by stage (tests/llm/test_brute_force.py).
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
