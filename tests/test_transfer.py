"""Transfers between languages, where a text has no word or two languages have one document id."""

from lexforge.plans import QUERIES


def test_a_language_without_words_has_no_vocabulary(spark, tmp_path):
    rows = [(1, "ab ab cd", "de"), (2, "ab xyz", "en"), (2, "cd", "de"), (3, "!!!", "xx"), (4, "ab", None), (5, "", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    matrix = {(r["train"], r["eval"]): (r["n"], r["oov_tokens"], r["oov_units"]) for r in QUERIES["transfer_matrix"](spark, str(tmp_path)).collect()}
    assert matrix == {("de", "en"): (1, 0.5, 1.0), ("en", "de"): (2, 0.5, 1.0)}
    found = QUERIES["ood_fertility"](spark, str(tmp_path))
    assert {(r["train"], r["eval"]): r["fertility"] for r in found.collect()} == {("de", "en"): 4.0, ("en", "de"): 3.0}


def test_few_molecules_are_many_tasks(spark, tmp_path):
    """Their bytes are few, so adaptive execution would give them to one task."""
    from lexforge.plans import molecule_queries

    spark.createDataFrame([(i, f"ab{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(200)], "client_id long, name string").write.parquet(f"{tmp_path}/clients.parquet")
    found = molecule_queries.sound(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
