"""What physical plans must and must not have."""

import re

import pytest

from boolsieve.catalog import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name, columns",
    [("doc_term_df", {"doc_id", "text"}), ("group_mean_std", {"l_returnflag", "l_linestatus", "l_quantity", "l_discount"}), ("dedupe_first", {"user_id", "event_type", "event_id", "value"}), ("spread_by_ratio", {"l_tax", "l_extendedprice"})],
)
def test_scans_read_what_is_asked_for(spark, sf, name, columns):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES[name](spark, sf)))
    assert read and all({c.split(":")[0] for c in r.split(",")} <= columns for r in read)


def test_filters_reach_the_scan(spark, sf):
    assert "GreaterThan(value,1.0)" in plan(QUERIES["run_time_stats"](spark, sf))
    assert "IsNotNull" in plan(QUERIES["resume_anti_join"](spark, sf))


@pytest.mark.parametrize("name", ["doc_term_df", "rule_coverage", "split_gain_all_terms", "group_mean_std", "qrels_stats", "bool_query_filter", "pseudo_label_ramps"])
def test_no_python_and_no_product(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "Python" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize("name", ["doc_term_df", "group_mean_std", "rule_coverage"])
def test_counts_are_partial_before_they_are_dealt(spark, sf, name):
    assert "partial_" in plan(QUERIES[name](spark, sf))
