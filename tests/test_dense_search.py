"""Exact search by blocks of queries against a row for each pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from boolsieve.catalog import ORACLE_SQL, QUERIES, derived
from boolsieve.operators import ranking
from oracle import compare


@pytest.fixture()
def vectors(spark):
    rng = np.random.default_rng(5)
    own = rng.normal(size=(40, 6)).round(1)
    own[7] = 0
    rows = [(i, own[i % 40].tolist(), i % 3) for i in range(160)]  # every vector four times: many ties
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)


def _rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("k", [1, 7, 500, None])
@pytest.mark.parametrize("skip_self", [True, False])
def test_same_scores_ranks_and_ties(vectors, k, skip_self, monkeypatch):
    monkeypatch.setattr(ranking, "QUERY_TASK", 3)
    queries = vectors.filter("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    qrels = vectors.join(queries.select("query_id")).select("query_id", F.col("vec_id").alias("doc_id"), F.when((F.col("label") == 1) & (F.col("query_id") > 0), 1).otherwise(0).alias("rel"))
    own = vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    for q in (None, qrels):
        for least in (None, 0.3):
            got = ranking.search(vectors, queries, k, least, skip_self=skip_self, qrels=q)
            assert _rows(got) == _rows(ranking._search_rows(own, queries, k, least, skip_self, q)) != []


def test_odd_vectors_take_part_as_before(spark, vectors):
    odd = spark.createDataFrame([(900, None, 0), (901, [1.0, None, 2.0, 0.0, 0.0, 0.0], 0), (902, [float("nan")] * 6, 0), (903, [1.0], 0)], vectors.schema)
    both = vectors.unionByName(odd)
    queries = vectors.filter("vec_id < 2").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    assert {r.doc_id for r in ranking.search(both, queries).collect()} >= {900, 901, 902, 903}
    assert ranking.search(vectors.limit(0), queries, 3).count() == 0
    assert ranking.search(vectors, queries.limit(0), 3).count() == 0


@pytest.mark.parametrize("name", ["dense_topk", "k_at_recall", "micro_macro_pr", "min_k_for_recall", "min_threshold_for_recall", "rank_metrics_at_k", "rank_panel", "tnr_at_recall", "cutoffs", "judged_precision", "pseudo_label_ramps"])
def test_no_row_for_each_pair_is_sorted(spark, sf, name):
    """Pairs are rated and ranked where they are made: no cosine as a row expression, and no range shuffle of scores."""
    text = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in text and "rangepartitioning" not in text and "FullOuter" not in text and ("MapInArrow" in text or name == "pseudo_label_ramps")


def test_edges_are_searched_once(spark, sf):
    assert "MapInArrow" not in derived._edges(spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("k", [7, None])
def test_labels_say_what_judged_pairs_do(vectors, k):
    """The same hits by labels as by a table of pairs; of whole rankings relevant rows and the last keep their ranks."""
    queries = vectors.filter("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    qrels = vectors.join(queries.select("query_id", F.col("label").alias("asked"))).filter("label = asked").select("query_id", F.col("vec_id").alias("doc_id"), F.lit(1).alias("rel"))
    whole = ranking.search(vectors, queries, k, qrels=qrels)
    assert _rows(ranking.search(vectors, queries, k, label="label")) == _rows(whole)
    own = vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"), "label")
    assert _rows(ranking._search_rows(own, queries, k, None, True, None, "label")) == _rows(whole)
    told = whole if k else whole.filter("rel = 1 or rank < 2 or rank = 158")
    assert _rows(ranking.search(vectors, queries, k, label="label", first=None if k else 2)) == _rows(told)


def test_falling_keeps_the_order_of_ties():
    rng = np.random.default_rng(1)
    for scores in (rng.integers(0, 40, 500) / 7, rng.normal(size=500), np.zeros(9), np.zeros(0), np.array([1, np.nan, 1, 2])):
        assert ranking._falling(scores).tolist() == np.argsort(-scores, kind="stable").tolist()


@pytest.mark.parametrize("name", ["k_at_recall", "min_k_for_recall", "min_threshold_for_recall", "rank_metrics_at_k", "rank_panel", "judged_precision", "pseudo_label_ramps"])
def test_no_table_of_pairs_is_joined(spark, sf, name, monkeypatch):
    """Judgements are labels of both sides, not a row for each pair; a query without any relevant vector stays."""
    met = []
    monkeypatch.setattr(ranking, "_judged", lambda rows, qrels: met.append(name))
    text = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not met and "collect_set" not in text and text.count("NestedLoop") <= (1 if name == "pseudo_label_ramps" else 2)
    assert name != "pseudo_label_ramps" or "try_element_at" in text or "element_at" in text


def test_a_query_without_relevant_vectors_has_its_row(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist(), 5 if i == 20 else None if i == 40 else i % 2) for i in range(50)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("rank_panel", "k_at_recall", "tnr_at_recall", "cutoffs", "micro_macro_pr", "rank_metrics_at_k"):
        compare(QUERIES[name](spark, str(tmp_path)), ORACLE_SQL[name].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'"), str(tmp_path / "none"))


def test_vectors_are_not_sent_for_each_block(spark, vectors, monkeypatch):
    """However many blocks of queries there are, no row for each block and vector goes to a shuffle; a task reads the vectors' one checkpoint."""
    monkeypatch.setattr(ranking, "QUERY_TASK", 1)
    queries = vectors.filter("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    plan = ranking.search(vectors, queries, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "explode" not in plan.lower() and "Generate" not in plan


def test_each_query_has_its_own_threshold(spark, vectors):
    queries = vectors.filter("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), (F.col("vec_id") / 200).alias("least"))
    own = vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    whole = ranking.search(vectors, queries.drop("least")).drop("rank").join(queries.select("query_id", "least"), "query_id").filter("score >= least").drop("least")
    assert _rows(ranking.search(vectors, queries, threshold="least").drop("rank")) == _rows(whole) != []
    assert _rows(ranking._search_rows(own, queries, None, "least", True, None)) == _rows(ranking.search(vectors, queries, threshold="least"))


def test_a_rising_curve_is_read_once(spark):
    rows = [(1, k, v) for k, v in ((1, 0.0), (2, 0.5), (3, 0.5), (4, 0.9), (5, 1.0))] + [(2, 1, 0.8), (3, 1, 0.1), (3, 2, 0.2)] + [(4, k, float("nan")) for k in (1, 2)]
    curve = spark.createDataFrame(rows, "query_id int, k int, v double")
    got = ranking.k_at_recall(curve, 0.7, rising=True)
    assert _rows(got) == _rows(ranking.k_at_recall(curve, 0.7)) and got.count() == 4
    assert got._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
