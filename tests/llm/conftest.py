import pytest
from samples import prose


@pytest.fixture(scope="session")
def edge_documents(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows and ids, clashing extra columns."""
    long_text = prose(1, 30_000)
    rows = [
        (1, prose(2, 80), "en", "src", 3),
        (2, prose(2, 80), None, None, None),
        (3, None, "en", "src", 0),
        (4, "", "en", "src", 0),
        (5, " \t\n ", "en", "src", 3),
        (6, long_text, "de", "src", 1),
        (7, long_text, "de", "src", 1),
        (8, "one two", "en", "src", 7),
        (8, "one two", "en", "src", 7),
        (9, prose(3, 120), "en", "src", 7),
        (9, prose(4, 120), "en", "src", 7),
        (None, prose(5, 90), "en", "src", 7),
        (None, None, None, None, None),
        (10, "é" * 700 + " 漢字 😀 " + "x" * 5000, "fr", "src", 1),
        (11, "!!! 123 ???", "en", "src", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = "class_id kept shard slot size job _key _row n_words n_removed lang_pred_ fp ctx known phrases windows rid bag1".split()
    return df.selectExpr("*", *[f"doc_id AS {c}" for c in clash])


@pytest.fixture(scope="session")
def no_documents(edge_documents):
    return edge_documents.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
