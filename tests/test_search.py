"""The flagship searches every document."""

from boolsieve.catalog import QUERIES


def test_learned_query_runs_over_unlabelled_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    found = QUERIES["learned_query_matches"](spark, sf)
    assert found.select("doc_id").exceptAll(docs).isEmpty() and docs.exceptAll(found.select("doc_id")).isEmpty()
