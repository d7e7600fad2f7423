import pytest
from llm_words import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string, size string, host string, score string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    long = prose(1, 60_000)
    rows = [
        (1, prose(2, 50), "en", "a"), (2, prose(2, 50), "en", "a"), (2, prose(2, 50), "en", "a"), (3, None, "en", "a"), (4, "", None, "b"), (None, prose(3, 30), "de", None),
        (None, None, None, None), (5, long, "en", "b"), (6, long + " tail", "en", "b"), (7, "one two", "fr", "c"), (8, "ONE  two", "fr", "c"), (9, " \t\n ", "fr", "c"),
        (10, "é ü\u00a0x ñ", "es", None), (11, prose(4, 400), "en", "a"), (12, prose(4, 400) + " extra", "en", "a"), (13, "x " * 3000, "en", "c"), (14, prose(5, 200), "en", "a"),
    ]
    return spark.createDataFrame([(*r, None, "s", "t", "z", "h", "q") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
