"""Search with skipping against scoring all documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from boolsieve.operators import ranking, textsearch


def plain(terms, k):
    by = {}
    for t in terms:
        for d, w in zip(t.docs.tolist(), t.weights.tolist()):
            by[d] = by.get(d, 0.0) + w
    return sorted(((-round(s, 9), d) for d, s in by.items()))[:k]


@pytest.mark.parametrize("k", [1, 7, 5000])
@pytest.mark.parametrize("block", [1, 8, 64])
def test_best_of_terms(k, block):
    rng = np.random.default_rng(k + block)
    for n in (1, 2, 4):
        terms = []
        for _ in range(n):
            docs = np.flatnonzero(rng.random(3000) < rng.random() * 0.5 + 0.001)
            docs = docs if len(docs) else np.array([3])
            terms.append(textsearch.Postings(rng.permutation(docs), np.round(rng.exponential(1, len(docs)), 2), block))  # rounded: many ties
        docs, scores, rated = textsearch.best_of(terms, k)
        assert [(-round(float(s), 9), int(d)) for d, s in zip(docs, scores)] == [(pytest.approx(s), d) for s, d in plain(terms, k)]
        assert rated <= sum(len(t.docs) for t in terms)


def test_most_postings_are_skipped():
    """Where good documents are few, most stretches are never looked at."""
    rng = np.random.default_rng(1)
    terms = [textsearch.Postings(np.arange(0, 200_000, s), rng.pareto(1.5, -(-200_000 // s))) for s in (1, 2, 5)]
    docs, scores, rated = textsearch.best_of(terms, 10)
    assert [int(d) for d in docs] == [d for _, d in plain(terms, 10)]
    skipped = 1 - rated / sum(len(t.docs) for t in terms)
    print(f"skipped {skipped:.0%} of the postings")
    assert skipped > 0.5


def corpus(spark):
    rng = np.random.default_rng(2)
    rows = [(int(d), t, int(rng.integers(1, 9))) for d in range(3000) for t, p in zip("abcd", (0.5, 0.1, 0.02, 0.9)) if rng.random() < p]
    lengths = spark.createDataFrame([(d, int(rng.integers(5, 400))) for d in range(3000)], "doc_id long, length int")
    queries = spark.createDataFrame([(0, "a"), (0, "b"), (0, "b"), (1, "c"), (1, "zz"), (2, "zz"), (3, "d"), (3, "a")], "query_id long, term string")
    return spark.createDataFrame(rows, "doc_id long, term string, tf int"), lengths, queries


@pytest.mark.parametrize("shard_postings", [400, 500_000])
def test_the_rows_of_scoring_all(spark, shard_postings):
    post, lengths, queries = corpus(spark)
    every = ranking.bm25(post, lengths, queries.distinct()).withColumn("score", F.round("score", 9))
    want = ranking.ranked(every, 10)
    got = textsearch.top_documents(post, lengths, queries, 10, shard_postings=shard_postings)
    key = lambda df: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 7)) for r in df.collect())
    assert key(got) == key(want) and got.count() == 30
    stats = textsearch.shard_best(post, lengths, queries, 10, block=8).groupBy("query_id").agg(F.max("postings").alias("p"), F.max("rated").alias("r")).collect()
    assert all(0 < s.r <= s.p for s in stats) and min(s.r / s.p for s in stats) < 0.9


def test_nothing_is_found(spark):
    post, lengths, queries = corpus(spark)
    assert textsearch.top_documents(post.limit(0), lengths.limit(0), queries, 10).collect() == []
    assert textsearch.top_documents(post, lengths, queries.limit(0), 10).collect() == []
