import pytest

# Columns that clash with names the operators use inside or return.
CLASHING = "score double, n_words long, component_id long, size int, label string, k1 long, bucket int, host string"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING
EXTRA = (0.5, 1, 2, 3, "x", 4, 5, "h")


def documents(spark, rows):
    """Documents from (doc_id, text, source), with clashing columns beside."""
    full = [(i, text, "en", source, None if text is None else len(text), *EXTRA) for i, text, source in rows]
    return spark.createDataFrame(full, COLUMNS)


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs in any column, empty and long texts, ties, repeated rows."""
    long = " ".join(f"w{n % 997}" for n in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs away", "a"),
        (2, "the quick brown fox jumps over the lazy dog and runs away", "b"),
        (3, None, "a"),
        (4, "", None),
        (5, " \t\n ", "b"),
        (6, long, "a"),
        (7, "one", None),
        (7, "one", None),
        (None, "a text without an id", "a"),
        (None, None, None),
        (8, "ünïcödé 漢字 \U0001f600 text", "c"),
    ]
    return documents(spark, rows)


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)
