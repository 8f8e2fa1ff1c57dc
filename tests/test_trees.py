import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from boolsieve.functions import boolean as b
from boolsieve.functions.rules import rule
from boolsieve.functions.text import strip_outer_brackets
from boolsieve.operators import coverage, splits
from boolsieve.plans import learn, rules, shards, trees
from boolsieve.plans.shards import Matrix, Part, Shards
from boolsieve.plans.trees import Forest, Node, Params, Plan
from test_boolean import FORMULAS


def random_matrix(rng, n=60, terms=12, p=0.3):
    x = rng.random((n, terms)) < p
    row, term = np.nonzero(x)
    return x, Matrix.of(term, row, terms, n)


def brute_impurity(hit, y, w):
    total = w.sum()
    out = 0.0
    for side in (hit, ~hit):
        if w[side].sum() == 0:
            return 1.0
        p = (w * y)[side].sum() / w[side].sum()
        out += w[side].sum() / total * 2 * p * (1 - p)
    return out


def test_matrix_sums_and_columns():
    rng = np.random.default_rng(0)
    x, m = random_matrix(rng)
    v = rng.random(60)
    assert np.allclose(m.sums(v), v @ x)
    assert np.allclose(m.only(np.array([3, 0])).sums(v), (v @ x)[[3, 0]])
    assert (m.any_of([1, 4]) == x[:, [1, 4]].any(axis=1)).all()


def test_root_split_is_the_best_one():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x, m = random_matrix(rng)
        y, w = (rng.random(60) < 0.4).astype(int), rng.integers(1, 4, 60)
        tree = trees.grow(m, y, w, Params(max_depth=1, min_rows=3, prefer_positive=None, max_or=1))
        gains = [brute_impurity(x[:, t], y, w) if 3 <= x[:, t].sum() <= 57 else 9 for t in range(12)]
        if tree:
            assert tree.features[0] == int(np.argmin(np.round(gains, 12)))


def test_or_expansion_follows_the_rule():
    rng = np.random.default_rng(2)
    x, m = random_matrix(rng, 200, 10, 0.15)
    y = (x[:, 0] | x[:, 1] | x[:, 2]).astype(int)
    w = np.full(200, 100)
    tree = trees.grow(m, y, w, Params(max_depth=1, prefer_positive=None))
    assert set(tree.features) == {0, 1, 2}
    chosen = [tree.features[0]]
    for t in tree.features[1:]:
        here = brute_impurity(x[:, chosen].any(axis=1), y, w)
        drops = {c: here - brute_impurity(x[:, [*chosen, c]].any(axis=1), y, w) for c in range(10) if c not in chosen}
        assert np.isclose(drops[t], max(drops.values()))
        chosen.append(t)


def test_prediction_zero_without_any_term_and_thresholds():
    x, m = random_matrix(np.random.default_rng(3), 40, 3, 0.5)
    tree = Node(1, 1, 0.5, [0], Node(1, 1, 0.9), Node(1, 1, 0.4, [1], Node(1, 1, 0.7), Node(1, 1, 0.6)))
    want = np.where(x[:, 0], 0.9, np.where(x[:, 1], 0.7, 0.0))
    assert (trees.predict(tree, m) == want).all()
    y = x[:, 0].astype(int)
    assert trees.best_threshold(tree, m, y, "precision")[0] == 0.9
    assert trees.best_threshold(tree, m, y, "precision", ("recall", 2.0))[0] in (0.6, 0.7, 0.9)
    assert trees.paths(tree, 0.65) == {rule([((0,), True)]), rule([((0,), False), ((1,), True)])}
    assert trees.paths(tree, 0.95) == set()
    assert trees.from_rows(trees.to_rows(tree)) == tree


def test_feature_subset_sizes():
    rng = np.random.default_rng(0)
    assert [trees.subset_size(100, k, None, rng) for k in (None, 7, 0.5, "sqrt", "log2", 500)] == [100, 7, 50, 10, 6, 100]
    assert all(10 <= trees.subset_size(100, "sqrt", 0.9, rng) <= 100 for _ in range(50))
    with pytest.raises(ValueError):
        trees.subset_size(5, "most", None, rng)


def test_class_weight():
    assert splits.class_weight(90, 10, None) == {0: 1, 1: 1}
    assert splits.class_weight(90, 10, "balanced") == {0: 1, 1: 9}
    assert splits.class_weight(90, 10, 0.5) == {0: 1, 1: 3}
    with pytest.raises(ValueError):
        splits.class_weight(3, 0, 1.0)


def pieces(m, y, w, n, rng):
    """A matrix as several shards."""
    to = rng.integers(0, n, m.n_rows)
    parts = []
    for k in range(n):
        rows = np.flatnonzero(to == k)
        new = np.full(m.n_rows, -1)
        new[rows] = np.arange(len(rows))
        on = new[m.rows] >= 0
        parts.append(Part(Matrix.of(m.term[on], new[m.rows[on]], m.n_terms, len(rows)), y[rows], w[rows], rows))
    return Shards(m.n_terms, parts, None, n)


def test_any_number_of_shards_grows_the_same_forest():
    rng = np.random.default_rng(9)
    x, m = random_matrix(rng, 300, 40, 0.2)
    y, w = ((x[:, 0] | x[:, 3]) & ~x[:, 7] | (rng.random(300) < 0.05)).astype(int), rng.integers(1, 4, 300)
    p = Params(max_depth=3, min_rows=2, min_share=0.0, max_features="sqrt", feature_exponent=0.9, top_candidates=15)
    whole = trees.fit_forest(Shards.of(m, y, w), p, Forest(n_trees=6))
    assert len(whole) >= 4 and len({str(t) for t in whole.values()}) > 3
    for n in (2, 5):
        dealt = pieces(m, y, w, n, rng)
        assert trees.fit_forest(dealt, p, Forest(n_trees=6)) == whole
        assert trees.leaf_counts(dealt, whole) == trees.leaf_counts(Shards.of(m, y, w), whole)
    small = Shards.of(m, y, w)
    small.__class__ = type("Narrow", (Shards,), {"block": 7})
    assert trees.fit_forest(small, p, Forest(n_trees=6)) == whole


def test_rows_are_drawn_as_poisson_numbers():
    n = 20_000
    part = Part(Matrix.of(np.zeros(0, int), np.zeros(0, int), 0, n), np.zeros(n, int), np.ones(n, int), np.arange(n))
    for mean in (1.0, 0.3, 40.0):
        w = trees.row_weights(part, Plan(3, Params(), 1, mean))
        assert abs(w.mean() - mean) < 5 * np.sqrt(mean / n) and abs(w.var() / mean - 1) < 0.1
    one, other = (trees.row_weights(part, Plan(k, Params(), 1, 1.0)) for k in (1, 2))
    assert abs(np.corrcoef(one, other)[0, 1]) < 0.05


def test_nodes_look_at_as_many_terms_as_wanted():
    o = trees._Open(Plan(1, Params(max_features=0.25), 5), 0, np.zeros(4), frozenset(), 40_000)
    assert abs(trees._looked_at(o, np.arange(40_000)).sum() - 10_000) < 500


SETTINGS = learn.Settings(
    min_df=1, max_df=1.0, params=Params(max_depth=5, min_rows=1, min_share=0.0, class_weight="balanced"), forest=Forest(n_trees=20), goal="f1", min_tree_occ=0.0, min_rule_occ=0.0,
    min_precision=0.5, cover_beta=1.0, cost_factor=0.002, max_rules=12,
)


@pytest.mark.parametrize("formula", FORMULAS)
def test_learned_query_equals_the_formula(spark, formula):
    """Ten thousand documents of a thousand filler words: the query says what the formula says, in its words, and no longer."""
    docs = learn.synthetic_corpus(spark, formula, 10_000, pool=1000, mean_length=60).cache()
    found = learn.learn(docs.select("doc_id", F.explode("terms").alias("term")), docs.select("doc_id", "y"), SETTINGS)
    got = learn.evaluate(found.query, docs, F.col("terms"), F.col("y")).first()
    docs.unpersist()
    assert got["f1"] == 1.0, found.query
    learned, size = b.parse(found.query), found.size
    assert {t.text for t in b.terms_of(learned)} == {t.text for t in b.terms_of(b.parse(formula))}
    assert b.counts(learned) == {"AND": size["ANDs"], "NOT": size["NOTs"], "OR": size["ORs"] + size["added_ORs"]}
    plain = strip_outer_brackets(re.sub(r'\[tiab\]|"', "", found.query))
    assert len(plain) <= len(formula), plain


def test_levels_grow_the_same_tree(spark):
    rng = np.random.default_rng(5)
    x = rng.random((80, 15)) < 0.25
    y = ((x[:, 0] | x[:, 3]) & ~x[:, 7]).astype(int)
    names = [f"t{i:02d}" for i in range(15)]
    post = spark.createDataFrame([(int(i), names[t]) for i, t in zip(*np.nonzero(x))], "doc_id long, term string")
    docs = spark.createDataFrame([(i, int(v), 100) for i, v in enumerate(y)], "doc_id long, y int, w int")
    row, term = np.nonzero(x)
    p = Params(max_depth=2, min_rows=2, top_candidates=20, max_or=4)
    tree = trees.grow(Matrix.of(term, row, 15, 80), y, np.full(80, 100), p)
    got = {r["node"]: r for r in trees.grow_levels(post, docs, p)}

    def check(n, k):
        assert [names[f] for f in n.features] == got[k]["features"]
        assert (n.n0, n.n1) == (got[k]["n0"], got[k]["n1"])
        if n.features:
            check(n.left, 2 * k + 1)
            check(n.right, 2 * k + 2)

    check(tree, 0)


def test_pruning_and_choice():
    assert rules.choose([{"kind": "or", "negated": False, "tp_gain": -0.5, "f": 0.9}]) == (None, False)
    assert rules.choose([{"kind": "or", "negated": False, "tp_gain": -0.05, "f": 0.9}, {"kind": "and", "negated": False, "precision_gain": 0.0, "f": 0.2}]) == (1, True)
    x, m = random_matrix(np.random.default_rng(6), 300, 6, 0.4)
    y = x[:, 0].astype(int)
    scores = rules.Scores(Shards.of(m, y), 0.1)
    long_rule = rule([((0, 4), True), ((1,), True)])
    history = rules.prune(long_rule, scores)
    assert rule([((0,), True)]) in history
    assert rules.prune(rule([((0,), True)]), rules.Scores(Shards.of(m, np.zeros(300, int)), 0.1)) == []


def test_rare_terms_go():
    found = {rule([((0, 9), True), ((1,), False)]): {0, 1}, rule([((0,), True)]): {1, 2}, rule([((9,), True)]): {0}}
    kept = rules.prune_rare(found, 3, 0.5, 0.5)
    assert kept == {rule([((0, 9), True)]): {0, 1}, rule([((0,), True)]): {1, 2}, rule([((9,), True)]): {0}}
    by_tree, by_rule = rules.frequencies(found, 3)
    assert by_tree[0] == 1.0 and by_tree[9] == 2 / 3 and by_rule[1] == 1 / 3


def test_local_search_beats_every_neighbour_and_matches_recount():
    rng = np.random.default_rng(7)
    cover = rng.random((12, 200)) < 0.1
    y = (rng.random(200) < 0.3).astype(int)
    row, term = np.nonzero(cover.T)
    held = Shards.of(Matrix.of(term, row, 12, 200), y)
    pool = rules.Pool([rule([((i,), True)]) for i in range(12)], np.full(12, 3.0), [[0], [1, 2]])
    chosen, value = rules.select_local(held, pool, 2.0, 0.002, max_rules=4)

    def full(s):
        hit = cover[list(s)].any(axis=0)
        tp = (hit & (y == 1)).sum()
        return float(rules.objective(tp, hit.sum() - tp, y.sum(), pool.costs[list(s)].sum(), 2.0, 0.002))

    assert np.isclose(value, full(chosen))
    for s in itertools.chain.from_iterable(itertools.combinations(range(12), k) for k in (1, 2)):
        if len(set(s) ^ set(chosen)) <= 1 and s:
            assert full(s) <= value + 1e-9
    ga, score = rules.select_genetic(held, pool, 2.0, 0.002, max_rules=4, rounds=30)
    assert np.isclose(score, full(ga)) and len(ga) <= 4


def test_moves_equal_recount(spark):
    rng = np.random.default_rng(8)
    cover = rng.random((5, 40)) < 0.3
    y = (rng.random(40) < 0.4).astype(int)
    df = spark.createDataFrame([(int(r), int(d)) for r, d in zip(*np.nonzero(cover))], "rule_id long, doc_id long")
    lab = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, y int")
    costs = spark.createDataFrame([(i, 1.0 + i) for i in range(5)], "rule_id long, cost double")
    selected = spark.createDataFrame([(0,), (1,)], "rule_id long")
    for r in coverage.move_scores(df, lab, selected, costs, 2.0, 0.01).collect():
        s = ({0, 1} - {r.r_out}) | ({r.r_in} - {None})
        hit = cover[sorted(s)].any(axis=0)
        assert (r.tp, r.fp) == ((hit & (y == 1)).sum(), (hit & (y == 0)).sum())
        assert np.isclose(r.cost, sum(1.0 + i for i in s))


def test_learning_end_to_end(spark):
    docs = learn.synthetic_corpus(spark, "(cats OR dogs) AND bowl NOT house", 600, pool=120, mean_length=12)
    post = docs.select("doc_id", F.explode("terms").alias("term"))
    settings = learn.Settings(min_df=2, max_df=1.0, params=Params(max_depth=6, class_weight=None, min_share=0.0), forest=Forest(n_trees=4), cover_beta=1.0, cost_factor=0.0005)
    found = learn.learn(post, docs.select("doc_id", "y"), settings)
    got = learn.evaluate(found.query, docs, F.col("terms"), F.col("y")).first()
    assert got["f1"] == 1.0
    assert {t.text for t in b.terms_of(b.parse(found.query))} == {"cats", "dogs", "bowl", "house"}
    with pytest.raises(ValueError):
        learn.learn(post, docs.select("doc_id", F.lit(1).alias("y")), settings)


@pytest.mark.parametrize("genetic", [False, True])
def test_learning_is_the_same_in_the_driver_and_in_tasks(spark, monkeypatch, genetic):
    docs = learn.synthetic_corpus(spark, "(cats OR dogs) AND (bowl OR box) NOT house", 300, pool=40, mean_length=8)
    post = docs.select("doc_id", F.explode("terms").alias("term"))
    settings = learn.Settings(min_df=2, max_df=1.0, params=Params(max_depth=3, class_weight=None, min_share=0.0, max_or=3, top_candidates=20), forest=Forest(n_trees=3), genetic=genetic)
    if genetic:
        monkeypatch.setattr(rules.select_genetic, "__defaults__", (2.0, 0.002, 10, 30, 3, 1))
    here = learn.learn(post, docs.select("doc_id", "y"), settings)
    monkeypatch.setattr(shards, "SHARD_POSTINGS", 700)
    assert learn.learn(post, docs.select("doc_id", "y"), settings, driver_postings=0) == here
