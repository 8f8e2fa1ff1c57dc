"""What is written and read goes by the vocabulary or by a bound, not by documents."""

from pyspark.sql import functions as F

from boolsieve.catalog import text as catalog_text
from boolsieve.operators import lexicon
from boolsieve.plans import classifiers


def test_lemmas_are_counted_without_a_table_of_documents(spark, sf, monkeypatch):
    monkeypatch.setattr(lexicon, "lemma_forms", None)
    monkeypatch.setattr(catalog_text, "cut", None)
    assert catalog_text.lemma_lexicon(spark, sf).count() > 100


def test_rows_that_share_an_id_are_one_document(spark):
    docs = spark.createDataFrame([(1, "mice and cats"), (1, "mouse cat dogs"), (2, "dog cats"), (None, "owls"), (3, None)], "doc_id long, text string")
    got = {r.lemma: (r.forms, r.df) for r in lexicon.lemma_counts(docs).collect()}
    assert got["mouse"] == (["mice", "mouse"], 1) and got["cat"] == (["cat", "cats"], 2) and got["dog"] == (["dog", "dogs"], 2) and got["owl"] == (["owls"], 0)


def test_a_long_vocabulary_makes_more_partitions(spark):
    rows = spark.range(100).select(F.col("id").alias("doc_id")).coalesce(1)
    assert classifiers.dealt(rows, 1000, 80_000).rdd.getNumPartitions() == 5
    assert classifiers.dealt(rows, 1000).rdd.getNumPartitions() == 1 and classifiers.dealt(rows, 1000, 80_000).count() == 100
