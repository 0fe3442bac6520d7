import pytest

LONG = "long words in a row that are told again " * 20_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns that clash."""
    rows = [
        (0, None, None, "a", None, "x", 0.5), (1, "", "en", "a", 0, "x", 0.5), (2, " \t\n", "en", None, 3, None, None),
        (3, LONG, "en", "a", len(LONG), "x", 0.5), (4, "one two three", "en", "a", 13, "x", 0.5),
        (4, "one two three", "en", "a", 13, "x", 0.5), (5, "One two THREE", "de", "a", 13, "x", 0.5),
        (None, "a row without id", "en", "a", 16, "x", 0.5), (7, "éè \U0001f642 12 ... a", "fr", "b", 12, "x", 0.5),
        (8, "...", "fr", "b", 3, "x", 0.5), (9, "w" * 50_000, "en", "b", 50_000, "x", 0.5),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, score double"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
