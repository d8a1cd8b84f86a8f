import pytest

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(6000))
COMMON = " ".join(f"shared{i}" for i in range(60))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, repeated ids, clashing extra columns."""
    rows = [
        (1, "the cat sat on the mat and the dog lay by the door of the old house today", "en", "s"),
        (2, "the cat sat on the mat and the dog lay by the door of the old house today", "en", "s"),
        (2, "the cat sat on the mat and the dog lay by the door of the old house today", "en", "s"),
        (3, None, None, None), (4, "", "en", "s"), (5, " \t\n ", "de", "s"), (None, "no id here but some words", "en", "s"), (6, "one two", "xx", "s"),
        (7, f"before {COMMON} after one", "en", "s"), (8, f"other start {COMMON} and another end", "fr", "s"), (9, LONG, "es", "s"), (9, "the same id with another text", "en", "s"),
        (10, "Äöü ßß 日本語 \U0001F600 don't  stop...\n\n\nline line", "de", "s"), (14, LONG + " tail", "es", "s"),
    ]
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars int, kept string, node int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
