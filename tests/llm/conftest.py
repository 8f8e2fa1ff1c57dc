import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their own columns, or inside.
CLASHES = ["score", "predicted", "id", "fp", "key", "rate", "copy", "n_words", "hit_spans", "perplexity", "kept", "token", "items", "digest", "_id", "_key", "_head", "_lang", "_bytes", "_NLL", "_fp", "_cdf", "_limit"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty, blank and very long texts, ties, repeated rows, and characters of several planes."""
    long_text = "the quick brown fox " * 20_000
    rows = [
        (1, "released under the MIT License, (c) idiot", "en", "a", 10), (1, "released under the MIT License, (c) idiot", "en", "a", 10), (2, None, "en", "a", None),
        (3, "", None, None, 0), (4, " \t\n", "xx", "b", 3), (5, long_text, "en", "b", len(long_text)), (None, "no id here at all", "de", "c", 1), (None, None, None, None, None),
        (6, "É😀 \u2028 K İ ß", "fr", "a", 9), (7, "a", "en", "a", 1), (8, "no id here at all", "de", "c", 1), (9, "\x00\x01 a\x00b", "en", "a", 5),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    from pyspark.sql import functions as F

    return odd_docs.withColumns({c: F.lit("x") for c in CLASHES})
