"""Documents for the operators' tests."""

import pytest

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated
    rows, and columns whose names clash with internal ones."""
    long = "alpha beta gamma delta epsilon " * 6000
    rows = [
        (1, "one two three four five six seven", "en", "a", 10),
        (2, "One two three four five six seven", None, "b", None),
        (3, "one two  three\nfour five six seven", "en", None, 10),
        (4, None, "en", "a", None), (5, "", "en", "a", 0), (6, " \t\n", None, None, 3),
        (7, long, "de", "c", len(long)), (8, long + "zeta", "de", "c", 1),
        (9, "x" * 50_000, "de", "a", 1), (10, "word", "en", "b", 4), (10, "word", "en", "b", 4),
        (11, "é́ ß Ω 　 <|endoftext|> 日本語 😀", "fr", "é", 1),
        (None, "a null id", "en", "a", 9), (12, "short text", "en", "", 1)]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    from pyspark.sql import functions as F
    for name in ("size", "key", "shard", "Target", "part", "row", "norm", "fp", "label", "score"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
