"""Texts meet labels before they are cut into tokens, once."""

from pyspark.sql import functions as F

from boolsieve.catalog import QUERIES, learning, registry
from boolsieve.functions.text import has_token, tokens
from boolsieve.plans import trees


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_word_among_tokens(spark):
    texts = ["he", "He said", "the", "she-he", "he-", "-he", "--he--", "he-man", "x-he", "x -he", "he--x", "a-b-he", "9he", "he9", "é he é", "éhe", "he\nX", "HE-", "", None, "clown. he", "a--he-", "he-.b"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", has_token(F.col("text"), "he", "clown").alias("got"), F.arrays_overlap(tokens(F.col("text")), F.array(F.lit("he"), F.lit("clown"))).alias("want"))
    assert [r.got for r in rows.collect()] == [r.want for r in rows.collect()]


def test_sweep_makes_no_tokens(spark, sf):
    assert "regexp_extract_all" not in _plan(QUERIES["threshold_sweep"](spark, sf))


def test_only_labelled_texts_are_read_for_terms(spark, sf):
    for df in (registry.labelled_postings(spark, sf), registry.searched(spark, sf)):
        text = _plan(df)
        assert 0 <= text.index("regexp_extract_all") < text.index("Join")  # the join comes first


def test_levels_read_written_postings(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(trees, "grow_levels", lambda post, docs, p: seen.append(_plan(post)) or [])
    learning.tree_by_levels(spark, sf)
    assert "regexp_extract_all" not in seen[0] and "Generate" not in seen[0]
