import os

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and columns with clashing names."""
    long = " ".join(f"w{i % 977} é{i % 13}" for i in range(60_000))
    rows = [
        (1, None, None, None, 5), (2, "", "en", "s", 5), (3, "one", "en", "s", None), (4, "one two", None, "s", 1), (5, long, "en", None, 1), (5, long, "en", None, 1), (6, long + " x", "fr", "s", 2),
        (None, "The same text here.", "en", "s", 1), (None, None, None, None, None), (7, "The same text here.", "en", "s", 1), (8, "THE SAME TEXT HERE.", "en", "s", 1), (9, "   \n\t ", "de", "s", 1),
        (10, "日本語 текст 123 \x00 é😀", "xx", "s", 1), (10, "another row of one id", "en", "s", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
