import pandas as pd
import pytest

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def table(docs):
    return docs.toPandas().sort_values("doc_id", ignore_index=True)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns named as the operators' own."""
    base = "the quick brown fox jumps over the lazy dog near the river bank today and sleeps under the old oak tree. "
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", None, None), (4, "one", "en", "b"), (5, base * 3, "en", "a"),
        (6, base * 3, "en", "b"), (6, base * 3, "en", "b"), (7, (base + "\n") * 3000, None, None), (8, "é日本😀 \x00 " * 50, "xx", "c"),
        (9, "password = abcdef123456 user: bob\n" + base, "en", "a"), (None, base, "en", None), (10, "one", "en", "b"), (11, "x" * 200000, "en", ""),
    ]
    pdf = [(a, b, c, d, len(b) if b else None, 1, 2, 3, "x", "y") for a, b, c, d in rows]
    return spark.createDataFrame(pdf, "doc_id long, text string, lang string, source string, n_chars long, pos int, size int, n int, bucket string, copies string").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")


def rows(df):
    return [tuple(r) for r in df.collect()]


def pandas(df) -> pd.DataFrame:
    return df.toPandas().sort_values("doc_id", ignore_index=True)
