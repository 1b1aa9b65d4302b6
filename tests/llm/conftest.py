import pytest

LONG = "alpha beta gamma delta " * 20_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with names that operators use."""
    rows = [
        (1, "The quick brown fox\njumps over the lazy dog.", "en", "a"), (1, "The quick brown fox\njumps over the lazy dog.", "en", "a"),
        (2, None, "en", "b"), (None, "No id, but words", None, None), (3, "", "de", "a"), (4, LONG, "en", None), (5, "é́ \U0001f600 日本", "fr", "c"),
        (6, "the QUICK brown fox jumps over the lazy dog.", "en", "a"), (7, "  \t\n ", None, "c"), (5, "another text of the same id", "fr", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "1 AS n_chars", "'x' AS size", "0.5 AS score", "'y' AS shard", "7 AS slot", "'f' AS fp", "'t' AS target", "3 AS taken", "'k' AS key", "'p' AS part")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
