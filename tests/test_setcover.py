"""Lazy greedy covering against choosing one term after another."""

import numpy as np
import pytest

from boolsieve.operators import setcover


def plain(post, y, steps, min_total, min_new):
    has, open_, out, total_covered = {}, {d for d, v in y.items() if v == 1}, [], 0
    for d, t in post:
        if d in y:
            has.setdefault(t, set()).add(d)
    for step in range(steps):
        rated = [(-len(ds & open_) / len(ds), -len(ds & open_), t.encode(), t) for t, ds in has.items() if len(ds) >= min_total and len(ds & open_) >= min_new]
        if not rated:
            break
        _, fresh, _, term = min(rated)
        total_covered -= fresh
        out.append({"step": step, "term": term, "fresh": -fresh, "total": len(has[term]), "covered": total_covered})
        open_ -= has[term]
    return out


def corpus(seed, n_docs=400, n_terms=150):
    rng = np.random.default_rng(seed)
    shares = rng.pareto(1.2, n_terms) * 0.02 + 0.005
    y = {d: int(rng.random() < 0.4) for d in range(n_docs)}
    post = [(d, f"t{t}é" if t % 7 == 0 else f"t{t}") for d in range(n_docs + 50) for t in range(n_terms) if rng.random() < min(shares[t], 0.9) * (1.6 if y.get(d) else 0.7)]
    return post, y


@pytest.mark.parametrize("leaders,held", [(64, 4096), (4, 16), (1, 1)])
def test_the_same_choices(spark, leaders, held):
    post, y = corpus(leaders)
    rows = spark.createDataFrame(post, "doc_id long, term string")
    labels = spark.createDataFrame([(d, v) for d, v in y.items()] + [(9999, None)], "doc_id long, y int")
    steps = 12 if leaders > 1 else 4
    got, passes = setcover.lazy_cover(rows, labels, steps, 5, 2, leaders, held)
    assert got == plain(post, y, steps, 5, 2) and len(got) >= 4
    if leaders == 64:
        assert passes < len(got)  # several choices a pass


def test_terms_that_do_not_meet_are_one_pass(spark):
    post = [(d, f"w{d // 10:02d}") for d in range(300)]
    rows = spark.createDataFrame(post, "doc_id long, term string")
    labels = spark.createDataFrame([(d, 1) for d in range(300)], "doc_id long, y int")
    got, passes = setcover.lazy_cover(rows, labels, 100, 5, 5)
    assert [g["term"] for g in got] == [f"w{i:02d}" for i in range(30)] and got[-1]["covered"] == 300 and passes == 1


def test_nothing_to_cover(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, term string")
    none = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, y int")
    assert setcover.lazy_cover(rows, none, 5, 1, 1) == ([], 0)
    assert setcover.greedy_cover(rows.limit(0), none.limit(0), 5, 1, 1) == []
