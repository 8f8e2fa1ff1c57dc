import numpy as np
import pytest
from pyspark.sql import functions as F

from boolsieve.functions import text
from boolsieve.operators import ablation, analytics, lexicon, ranking
from boolsieve.plans import reports, study, trees


def test_lexicon_merge_golden():
    got = lexicon.merge_lexicon({"a": {"b"}, "b": {"c"}, "c": {"x"}, "A": {"A", "B", "X"}, "X": {"X", "Y"}, "Y": {"X", "Z"}, "K": {"Y"}})
    assert got["a"] == {"b", "c", "x"}
    assert set(got) == {"a", "K"} or set(got) == {"a", "A"}
    assert {"B", "X", "Y", "Z"} <= set().union(*got.values())


def test_pseudo_labels_equal_a_loop(spark):
    docs = spark.createDataFrame([(i,) for i in range(60)], "doc_id long")
    order = np.random.default_rng(1).permutation(60)[:45]
    rank = spark.createDataFrame([("q", int(d), k, 1.0 - k / 100) for k, d in enumerate(order)], "query_id string, doc_id long, rank int, score double")
    k = spark.createDataFrame([("q", 7.0)], "query_id string, k double")
    got = {r.doc_id: (r.y, r.w) for r in ranking.pseudo_labels(docs, rank, k, top=1.4, dont_care=1.0, max_weight=1.5).collect()}
    n = 10
    want = {i: (0, 150) for i in range(60)}
    for r, d in enumerate(order):
        if r <= n:
            want[int(d)] = (1, max(1, round(50 * (1 - r / n) + 100)))
        elif r < 2 * n:
            want[int(d)] = (0, 0)
        elif r < 3 * n:
            want[int(d)] = (0, max(1, round(50 * (r - 2 * n) / n + 100)))
    assert got == want
    with pytest.raises(Exception, match="no document"):
        ranking.pseudo_labels(docs.filter("doc_id <> %d" % order[0]), rank, k).collect()


def test_allocation_and_curve(spark):
    assert ranking.stratified_allocation({"a": 50, "b": 30, "c": 20}, 10) == {"a": 5, "b": 3, "c": 2}
    assert sum(ranking.stratified_allocation({"a": 5, "b": 3, "c": 3}, 10).values()) == 10
    assert sum(ranking.stratified_allocation({"a": 1, "b": 1}, 10).values()) == 2
    rows = ranking.smooth_curve(spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0)], "x double, y double"))
    assert [r.smooth for r in rows.orderBy("x").collect()] == [1.0, 2.5, 2.5]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "query_id string, doc_id long, rank int, score double")
    some = spark.createDataFrame([("q", 3)], "query_id string, positives long")
    assert ranking.cutoffs(none, some).first()["k_cosine"] == 0
    qrels = spark.createDataFrame([], "query_id string, doc_id long, rel int")
    assert ranking.panel(ranking.relevance(none, qrels), some).first()["average_precision"] == 0.0
    assert analytics.qrels_stats(qrels).first()["queries"] == 0


def test_clusters(spark):
    v = spark.createDataFrame([("g", "a", [1.0, 0.0]), ("g", "b", [0.9, 0.1]), ("g", "c", [0.0, 1.0])], "group string, word string, vector array<double>")
    assert {r.word: r.canonical for r in lexicon.cluster_words(v, 0.9).collect()} == {"a": "a", "b": "a", "c": "c"}


def test_study_is_repeatable_and_prunes(spark):
    def measure(p, topic):
        return p["a"], 1.0 - p["a"] / 2

    make = lambda: study.Study("s", 1.0, ["t1", "t2", "t3"], measure, {"a": ("float", 0.1, 0.9), "b": ("choice", [1, 2])}, warm=[{"a": 0.5, "b": 1}, {"a": 0.5, "b": 1}])
    rows = make().run(15)
    assert rows == make().run(15)
    states = {r[1]: r[2] for r in rows}
    assert states[1] == "DUPLICATE" and "PRUNED" in states.values() and "COMPLETE" in states.values()
    best = study.best_per_beta(study.trial_means(study.trials_table(spark, rows), [1.0])).first()
    assert best["topics"] == 3
    assert study.known_only({"a": 1}, {"a": 2, "z": 3}) == {"a": 2}
    assert study.ablation_grid(spark, {"a": 1}, {"x": {"a": 2}, "y": {}}, ["t"], 2).count() == 4


def test_text_helpers(spark):
    df = spark.createDataFrame([("Well-known, X's  --  test 12 nan",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.terms(df.t)).collect()] == [["known"], [], []] or [r[0] for r in df.select(text.terms(df.t)).collect()] == [["test", "well-known"], [], []]
    assert df.select(text.surface_form(df.t)).first()[0] == "well-known x s test 12 nan"
    assert text.strip_outer_brackets("((a OR b))") == "a OR b" and text.strip_outer_brackets("(a) OR (b)") == "(a) OR (b)"


def test_embeddings_have_length_one(spark):
    from boolsieve.operators import embedding

    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, "a b c")], "doc_id long, text string")
    rows = {r.doc_id: np.array(r.embedding) for r in embedding.embed(docs, embedding.hashed_words(16), batch=2).collect()}
    assert np.isclose(np.linalg.norm(rows["1"]), 1) and (rows["1"] == rows["3"]).all() and not rows["2"].any()
    assert embedding.known_ids(docs).count() == 3


def test_tree_json():
    tree = trees.Node(2, 3, 0.6, [4, 1], trees.Node(0, 3, 1.0), trees.Node(2, 0, 0.0))
    assert trees.from_json(trees.to_json(tree)) == tree
    assert trees.describe(tree, list("abcde")).splitlines()[0] == "any of e, b (3 of 5)"


def test_figures_if_they_can_be_drawn(spark):
    pytest.importorskip("matplotlib")
    rows = spark.createDataFrame([(1, 2.0, "a"), (2, 3.0, "a"), (1, 1.0, "b")], "x int, y double, s string")
    for kind in ("line", "bar", "scatter"):
        assert reports.figure(rows, kind, "x", "y", "s") is not None


def test_report_strings(spark):
    from boolsieve.functions import rules

    assert reports.annotated('"a b" OR cd AND ef', {"a b": 1200, "ef": 7}) == '"a b" (1.2k) OR cd AND ef (7)'
    assert reports.label("pubmed_f3") == "Pubmed F3" and reports.highlight("ab OR abc", {"ab"}) == "**ab** OR abc"
    df = spark.createDataFrame([('(a OR "b"[mh]) NOT c[tiab]', [[(["a", "b"], True), (["c"], False)]]), ("", [])], f"q string, r array<{rules.RULE_TYPE}>")
    got = df.select(text.heading_share(df.q).alias("h"), rules.mean_literal_length(df.r).alias("m")).collect()
    assert [(round(r.h, 3), r.m) for r in got] == [(0.333, 1.5), (0.0, 0.0)]


def test_lemmas(spark):
    words = ["studies", "eies", "trees", "houses", "does", "glass", "virus", "gas", "cells", "mice", "women", "cell", "ties", "x-rays"]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.l for r in rows.select("w", text.lemma(F.col("w")).alias("l")).collect()}
    assert got == {"studies": "study", "eies": "eies", "trees": "trees", "houses": "house", "does": "does", "glass": "glass", "virus": "virus", "gas": "gas", "cells": "cell",
                   "mice": "mouse", "women": "woman", "cell": "cell", "ties": "ty", "x-rays": "x-ray"}
    assert rows.select(text.lemma(F.col("w"), {}).alias("l")).filter("l = 'mice'").count() == 1


def test_lemma_forms(spark):
    docs = spark.createDataFrame([(1, "Cell cells CELLS, mice and a mouse 42"), (2, None), (3, ""), (4, "the cells"), (4, "the cells")], "doc_id long, text string")
    got = {(r.doc_id, r.lemma): r.forms for r in lexicon.lemma_forms(docs).collect()}
    assert got == {(1, "cell"): ["cell", "cells"], (1, "mouse"): ["mice", "mouse"], (4, "cell"): ["cells"]}
    assert lexicon.lemma_forms(docs.limit(0)).count() == 0


def test_plane_equals_numpy(spark):
    v = np.random.default_rng(3).normal(size=(80, 6)) * [5, 1, 1, 3, 1, 0.5]
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    _, axes = np.linalg.eigh(np.cov(v.T))
    axes = axes[:, ::-1].T[:2]
    axes = axes * np.sign(axes[[0, 1], np.abs(axes).argmax(1)])[:, None]
    for r in ranking.plane(table).collect():
        assert np.allclose((r.x, r.y), axes @ v[r.vec_id])
    nodes, edges = ranking.star_graph(table, table.filter("vec_id = 0").selectExpr("vec_id AS query_id", "embedding AS q"), -1.0, 10, projected=True)
    assert nodes.columns == ["doc_id", "x", "y"] and nodes.count() == edges.count() == 10


def test_random_pairs(spark):
    terms = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 1, "b")], "query_id int, clause int, literal int, term string")
    vectors = spark.createDataFrame([(w, [1.0, float(i)]) for i, w in enumerate("abcde")], "term string, vector array<double>")
    count = lambda n: {r.kind: r.n for r in ablation.pair_similarities(terms, vectors, n, 1).collect()}
    assert count(0) == {"or": 1} and count(1) == {"or": 1, "random": 1} and count(9) == {"or": 1, "random": 2}


def test_thresholds_by_what_a_search_finds():
    leaves = [(0.9, 10, 9), (0.5, 10, 5), (0.0, 80, 0)]
    assert trees.threshold_of(leaves, "precision") == (0.9, 0.9)
    assert trees.threshold_of(leaves, "precision", retrieved=lambda t: 900 if t > 0.6 else 28) == (0.5, 0.5)
    assert trees.threshold_of(leaves, "precision", retrieved=lambda t: 0) == (0.9, 0.9)


def test_markup_of_operators_and_shades():
    assert reports.outer_operators('(a OR b) AND "c AND d" NOT e') == '(a OR b) **AND** "c AND d" **NOT** e'
    assert [reports.shade(x, 0.0, 1.0) for x in (None, -1.0, 0.0, 0.39, 1.0, 2.0)] == [None, 0, 0, 1, 4, 4] and reports.shade(3.0, 1.0, 1.0) == 0
