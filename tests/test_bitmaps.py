"""Compressed sets against plain ones, rules rated on them, and sums that never gather all shards."""

import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boolsieve.functions.bitmaps import BITS, ROWS, RUNS, SIZE, Bitmap, union
from boolsieve.functions.rules import rule
from boolsieve.operators import bitmaps, coverage
from boolsieve.plans import rules, shards, trees
from boolsieve.plans.shards import Matrix, Part, Shards
from boolsieve.plans.trees import Forest, Params

#: Sets whose blocks take each form, at both ends of blocks.
SHAPES = {
    "none": [], "one": [0], "edge": [SIZE - 1, SIZE], "last": [2**32 - 1], "few": range(5, 60_000, 97), "run": range(100, 70_000), "full": range(3 * SIZE),
    "odd": range(1, SIZE, 2), "runs": [x for a in range(0, 2 * SIZE, 1000) for x in range(a, a + 700)], "mixed": [0, 2, 9, *range(SIZE, SIZE + 9000, 2), *range(2 * SIZE + 5, 2 * SIZE + 60_000)],
    "holes": [x for x in range(SIZE) if x % 5000], "random": np.unique(np.random.default_rng(1).integers(0, 4 * SIZE, 90_000)).tolist(),
}


@pytest.mark.parametrize("a", SHAPES)
def test_sets_of_every_form(a):
    x = set(SHAPES[a])
    m = Bitmap.of(SHAPES[a])
    assert len(m) == len(x) and set(m.rows().tolist()) == x and Bitmap.loads(m.dumps()) == m and len(m.dumps()) <= m.nbytes + 4 + 9 * len(m.blocks)
    for b in SHAPES:
        y, n = set(SHAPES[b]), Bitmap.of(SHAPES[b])
        for made, want in ((m & n, x & y), (m | n, x | y), (m - n, x - y)):
            assert len(made) == len(want) and set(made.rows().tolist()) == want, (a, b)
            assert all(len(v) for _, v in made.blocks.values())
        assert m.common(n) == len(x & y)


def test_forms_are_the_smallest():
    kinds = {k: {v[0] for v in Bitmap.of(SHAPES[k]).blocks.values()} for k in SHAPES}
    assert kinds["few"] == {ROWS} and kinds["full"] == {RUNS} == kinds["run"] and kinds["odd"] == {BITS} and kinds["mixed"] == {ROWS, BITS, RUNS}
    assert Bitmap.of(range(1_000_000)).nbytes == 4 * 16 and Bitmap.of(range(0, 1_000_000, 1000)).nbytes == 2000  # by what is in it
    assert Bitmap.span(3 * SIZE) == Bitmap.of(SHAPES["full"]) and Bitmap.span(0) == Bitmap.of([]) and len(Bitmap.span(70_001)) == 70_001
    assert Bitmap.of([3, 1, 3]).rows().tolist() == [1, 3]
    for bad in ([-1], [2**32]):
        with pytest.raises(ValueError):
            Bitmap.of(bad)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3 * SIZE), st.integers(1, 9000), st.integers(1, 4)), max_size=6), st.lists(st.tuples(st.integers(0, 3 * SIZE), st.integers(1, 9000), st.integers(1, 4)), max_size=6))
def test_any_two_sets(a, b):
    x, y = ({v for at, n, step in s for v in range(at, at + n, step)} for s in (a, b))
    m, n = Bitmap.of(sorted(x)), Bitmap.of(sorted(y))
    assert set((m & n).rows().tolist()) == x & y and set((m | n).rows().tolist()) == x | y and set((m - n).rows().tolist()) == x - y and m.common(n) == len(x & y)


def test_union():
    assert union([]) == Bitmap.of([]) and union([Bitmap.of([1]), Bitmap.of([70_000]), Bitmap.of([1, 2])]).rows().tolist() == [1, 2, 70_000]


RULES = [rule([(("a", "b"), True), (("c",), False)]), rule([(("c",), True)]), rule([(("zz",), True)]), rule([(("d",), False)]), rule([(("a",), True), (("d", "e"), True)])]


def corpus(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), t) for i in range(400) for t, p in zip("abcde", (0.3, 0.1, 0.5, 0.9, 0.05)) if rng.random() < p]
    return spark.createDataFrame(rows, "doc_id long, term string"), spark.createDataFrame([(i,) for i in range(400)], "doc_id long"), {i: {t for d, t in rows if d == i} for i in range(400)}


@pytest.mark.parametrize("shard_rows", [37, 1 << 18])
def test_rules_on_sets_equal_a_recount(spark, shard_rows):
    post, docs, have = corpus(spark)
    labels = spark.createDataFrame([(i, i % 3 == 0 and 1 or 0) for i in range(0, 400, 2)] + [(9999, 1), (1, None)], "doc_id long, y int")
    held = bitmaps.bitmap_table(post.unionAll(post.limit(5)), bitmaps.numbered_rows(docs.unionAll(docs), shard_rows), labels)
    fits = lambda r, t: all(bool(set(f) & t) == pos for f, pos in r)
    hit = [{i for i, t in have.items() if fits(r, t)} for r in RULES]
    good = {i for i in range(0, 400, 2) if i % 3 == 0}
    assert sorted(map(tuple, bitmaps.rule_counts(held, RULES).collect())) == [(k, len(h), len(h & good)) for k, h in enumerate(hit)]
    for r in bitmaps.move_counts(held, RULES, [0, 4]).collect():
        now = set().union(*[hit[k] for k in ({0, 4} - {r.r_out}) | ({r.r_in} - {None})])
        assert (r.tp, r.returned) == (len(now & good), len(now))
    assert {r.term: r.df for r in bitmaps.term_counts(held).collect()} == {t: sum(t in h for h in have.values()) for t in "abcde"}


def test_rules_of_nothing(spark):
    post, docs, _ = corpus(spark)
    held = bitmaps.bitmap_table(post.limit(0), bitmaps.numbered_rows(docs.limit(0)))
    assert [tuple(r) for r in bitmaps.rule_counts(held, RULES[:2]).orderBy("rule_id").collect()] == [(0, 0, 0), (1, 0, 0)]


def test_sets_equal_the_join(spark, sf):
    """The same documents as ``coverage`` finds with joins."""
    from boolsieve.catalog.registry import postings
    from boolsieve.catalog.text import RULES as known

    post = postings(spark, sf).cache()
    joined = {r.rule_id: r.n for r in coverage.coverage(post, coverage.rule_table(spark, known)).groupBy("rule_id").agg(F.count("*").alias("n")).collect()}
    held = bitmaps.bitmap_table(post, bitmaps.numbered_rows(spark.read.parquet(f"{sf}/documents.parquet"), 50))
    assert {r.rule_id: r.returned for r in bitmaps.rule_counts(held, known).collect() if r.returned} == joined
    post.unpersist()


# --- sums over shards


def test_sums_hold_one_value_at_a_time():
    """Five thousand shards' sums of a key come to 400 MB; adding them up takes a few of them."""

    def rows(sparse):
        for k in range(5000):
            ids = np.arange(2500) * 2 + k % 2
            yield "a" if k < 2500 else "b", np.stack([ids, ids, ids, np.full(2500, k)]) if sparse else np.full(10_000, k)

    for sparse in (False, True):
        for add in (lambda r, s: shards.add_sorted(r, s), lambda r, s: shards.add_up(r, s, 1 << 20)):
            tracemalloc.start()
            done = 0
            for _, value in add(rows(sparse), sparse):
                done += int(value[-1].sum() if sparse else value[0])
                assert not sparse or (np.diff(value[0]) > 0).all()
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            assert done == 5000 * 4999 // 2 * (2500 if sparse else 1)
            assert peak < 8 << 20, peak


def test_sparse_matrix_takes_no_memory_by_the_vocabulary():
    wide = Matrix.of(np.array([5, 10**9, 5]), np.array([2, 0, 1]), 10**10, 3)
    assert wide.column(5).tolist() == [1, 2] and wide.column(10**9).tolist() == [0] and wide.column(7).tolist() == [] and wide.ids.nbytes + wide.starts.nbytes < 100
    assert wide.any_of([10**9, 7]).tolist() == [True, False, False]
    assert wide.only(np.array([7, 10**9, 5])).sums(np.array([1, 10, 100])).tolist() == [0, 1, 110]
    assert Part.loads(Part(wide, np.zeros(3), np.ones(3), np.arange(3)).dumps()).x.column(5).tolist() == [1, 2]


def test_five_thousand_shards_grow_the_same_forest(spark):
    """More shards than meet in a task: sums go by salts over two levels."""
    rng = np.random.default_rng(11)
    n, terms = 10_000, 30
    x = rng.random((n, terms)) < 0.15
    y = ((x[:, 0] | x[:, 3]) & ~x[:, 7]).astype(int)
    row, term = np.nonzero(x)
    post = spark.createDataFrame(list(zip(row.tolist(), term.tolist())), "doc_id long, term_id long")
    docs = spark.createDataFrame([(i, int(v), 100) for i, v in enumerate(y)], "doc_id long, y int, w int")
    few = shards.build(post, docs, terms)
    old, shards.SHARD_POSTINGS = shards.SHARD_POSTINGS, 8
    try:
        many = shards.build(post, docs, terms, driver_postings=0)
    finally:
        shards.SHARD_POSTINGS = old
    assert many.n_shards > 5000 and many.parts is None and few.parts is not None
    p, f = Params(max_depth=1, min_share=0.0, max_or=2, top_candidates=10), Forest(n_trees=2)
    forest = trees.fit_forest(few, p, f)
    assert trees.fit_forest(many, p, f) == forest and len(forest) == 2
    asked = [rule([((0, 3), True), ((7,), False)]), rule([((1,), True)])]
    assert [rules.Scores(s, 1.0).of(r) for s in (few, many) for r in asked[:1]] == [rules.Scores(few, 1.0).of(asked[0])] * 2
