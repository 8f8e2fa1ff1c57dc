"""Places, running sums and quantiles of hot groups against plain Python."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from boolsieve.catalog import QUERIES
from boolsieve.operators import analytics, quantiles, ranking, scans


def test_places_and_sums(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else None if i % 7 == 0 else f"g{i % 5}", int(rng.integers(0, 50)), i, float(i % 4) if i % 6 else None, "x") for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, o int, id int, v double, place string").repartition(9)
    got = scans.prefixes(df, ["g"], [F.desc("o"), F.col("id")], "place", {"s": "v", "c": F.when(F.col("v") > 1, 1)})
    assert got.columns == ["g", "o", "id", "v", "place", "s", "c"]
    by = {}
    for g, o, i, v, _ in sorted(rows, key=lambda r: (str(r[0]), -r[1], r[2])):
        by.setdefault(g, []).append((i, v))
    want = {}
    for g, items in by.items():
        s = c = 0
        for at, (i, v) in enumerate(items):
            s, c = s + (v or 0), c + int((v or 0) > 1)
            want[i] = (at, s, c)
    assert {r.id: (r.place, r.s, r.c) for r in got.collect()} == want
    assert scans.prefixes(df.limit(0), ["g"], ["o"]).collect() == []


def test_ties_and_repeated_rows_all_stay(spark):
    df = spark.createDataFrame([("a", 1)] * 50 + [("b", 1)], "g string, o int")
    assert sorted(r.place for r in scans.prefixes(df, ["g"], ["o"]).filter("g = 'a'").collect()) == list(range(50))


@pytest.mark.parametrize("name", ["rank_panel", "running_mean", "stratified_documents", "tnr_at_recall", "k_at_recall"])
def test_no_window_over_a_whole_group(spark, sf, name):
    """Windows are over a range of a group, over ranges, or over a row a query."""
    text = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for w in re.findall(r"Window \[.*?\], \[(.*?)\], \[", text):
        assert "_range" in w, w


SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def exact(spark, groups, bins=1024, listed=1000):
    old = quantiles.BINS, quantiles.LISTED
    quantiles.BINS, quantiles.LISTED = bins, listed
    try:
        rows = [(g, v) for g, vs in groups.items() for v in vs]
        got = quantiles.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", SHARES).collect()
    finally:
        quantiles.BINS, quantiles.LISTED = old
    return {(r.g, r.share): r.q for r in got}


def check(got, groups):
    want = {}
    for g, vs in groups.items():
        vs = sorted(v for v in vs if v is not None and np.isfinite(v))
        for s in SHARES if vs else ():
            at = (len(vs) - 1) * s
            lo = int(np.floor(at))
            want[g, s] = vs[lo] * (1 - (at - lo)) + vs[min(lo + 1, len(vs) - 1)] * (at - lo)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-12, abs=1e-300), k


def test_quantiles_of_odd_groups(spark):
    groups = {"one": [5.0], "two": [1.0, 2.0], "ties": [3.0] * 40 + [4.0], "none": [None, float("nan"), float("inf")], None: [1.0, None, 2.0, float("-inf")], "neg": [-1.5, -2.5, 0.0, -0.0]}
    check(exact(spark, groups), groups)


def test_quantiles_by_refinement(spark):
    """Skewed, tied, tiny and huge values, over many passes."""
    rng = np.random.default_rng(3)
    groups = {
        "even": rng.random(700).tolist(), "skewed": np.exp(rng.normal(0, 12, 400)).tolist(), "tied": rng.integers(0, 4, 900).astype(float).tolist(), "far": [-1e308, 1e308, 0.0, 1.0, 2.0, 5e-324] * 9,
        "hot": [7.0] * 800 + rng.normal(7, 1e-9, 100).tolist(),
    }
    check(exact(spark, groups, 256, 5), groups)


def test_quantiles_without_groups_and_rows(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    assert [(r.share, r.q) for r in quantiles.quantiles(df, [], "v", [0.5]).collect()] == [(0.5, 5.0)]
    assert quantiles.quantiles(df.limit(0), [], "v", [0.5]).collect() == []
    assert analytics.quantile_buckets(df, "v", "v", 2).count() == 2


@pytest.mark.parametrize("name", ["bin_percentiles", "qcut_means", "run_time_stats"])
def test_no_buffer_grows_with_the_data(spark, sf, name):
    assert "percentile" not in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().replace("bin_percentiles", "")


def test_running_mean(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("a", 3, 4.0), ("b", 1, None)], "g string, s int, v double")
    assert {(r.g, r.s): r.running for r in analytics.running_mean(df, "g", "s", "v").collect()} == {("a", 1): 2.0, ("a", 2): 2.0, ("a", 3): 3.0, ("b", 1): None}


def test_ranks_with_and_without_judgements(spark):
    scores = spark.createDataFrame([("q", d, s) for d, s in enumerate([0.5, 0.9, 0.9, 0.1])], "query_id string, doc_id long, score double")
    qrels = spark.createDataFrame([("q", 2, 1), ("q", 3, 2), ("q", 0, 0)], "query_id string, doc_id long, rel int")
    both = [ranking.ranked(scores, qrels=qrels), ranking.relevance(ranking.ranked(scores), qrels)]
    for got in both:
        assert sorted((r["rank"], r.doc_id, r.rel, r.hits) for r in got.collect()) == [(0, 1, 0, 0), (1, 2, 1, 1), (2, 0, 0, 1), (3, 3, 1, 2)]
    assert sorted((r["rank"], r.doc_id) for r in ranking.ranked(scores, 2).collect()) == [(0, 1), (1, 2)]
