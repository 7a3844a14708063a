"""lexforge: Spark-native lexical analytics over very large string corpora."""

__version__ = "0.1.0"
