"""Every registered query against its SQL, or at least that it gives rows."""

import pytest

from boolsieve.catalog import ORACLE_SQL, QUERIES
from oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    compare(QUERIES[name](spark, sf), ORACLE_SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"tree_by_levels"}))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert set(df.columns) == {"doc_id", "query", "matched", "toxic"} and df.count() > 0


@pytest.mark.parametrize("name", ["bool_query_filter", "bool_query_not_branch", "rule_coverage", "rule_any_coverage", "tree_predict_nested", "learned_query_matches"])
def test_documents_without_a_label_are_searched(spark, sf, name):
    sf = sf.replace("sf0.001", "sf0.01")
    found = QUERIES[name](spark, sf).select("doc_id").distinct()
    assert found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left_anti").count() > 0
