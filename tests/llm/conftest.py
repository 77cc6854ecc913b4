"""Small tables with the awkward rows that every operator has to take."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, items string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like results."""
    long_text = " ".join(f"word{k % 997}" for k in range(120_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away from here today", "en", "a", 10, 5, 0.5, "x"),
        (1, "The quick brown fox jumps over the lazy dog and runs away from here today", "en", "a", 10, 5, 0.5, "x"),
        (2, None, None, None, None, None, None, None),
        (3, "", "en", "a", 0, 0, 0.0, ""),
        (4, "  \n\t ", "de", "b", 5, 0, 0.0, ""),
        (5, long_text, "en", "b", len(long_text), 0, None, None),
        (None, "no id here but words enough to be a window of ten words or more", "fr", "c", 3, 1, 1.0, "y"),
        (6, "1234 5678 !!! ???", None, "c", 3, 1, 1.0, "y"),
        (7, "ÀÉÎ über straße 日本語 😀 naïve", "fr", "c", 3, 1, 1.0, "y"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
