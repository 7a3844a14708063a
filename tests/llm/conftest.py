import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and blank texts, one very long text, repeated rows and ids, and texts beyond ASCII."""
    prose = "Die Katze sitzt auf der Matte und sieht den Hund an, der im Garten liegt und schläft. "
    words = " ".join(f"w{i * 7919 % 1009}" for i in range(30_000))
    rows = [
        (1, prose * 3, "de", "a", 3), (2, prose * 3, "de", "a", 3), (3, None, "de", "b", None), (4, "", None, None, 0), (5, " \n\t ", "en", "b", 3),
        (None, "The cat sat on the mat and looked at the dog.", "en", "c", 4), (7, words, "en", "a", 5), (8, "日本語のテキスト。" * 20, "ja", None, 6), (1, prose * 3, "de", "a", 3),
        (9, "x", None, "c", 1), (10, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and more words here', "en", "c", 9), (11, prose * 3 + "Noch ein Satz.", "de", "a", 3), (12, "!!! ??? ***", "en", "b", 1),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def clashing(spark, awkward):
    """Columns with the names that operators use inside."""
    from pyspark.sql import functions as F

    names = ["own", "row", "at", "f0", "node", "score", "hash", "size", "times", "answers", "row_key", "slot", "fingerprint", "sketch", "component_id", "payload", "digest", "head", "_stays", "bucket", "_cell", "_place", "n", "ids", "part", "part", "found", "label"]
    return awkward.select("*", *[F.lit(i).alias(n) for i, n in enumerate(dict.fromkeys(names))])
