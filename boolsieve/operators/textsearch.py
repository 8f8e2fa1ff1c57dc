"""Top-k text search that skips what can't be among the best.

Documents are dealt to shards. In a shard the postings of each term stand in blocks of documents, each with its largest
weight. A query looks at stretches of documents between the edges of its terms' blocks, those of the largest possible
score first, and stops when the rest can't reach its k-th best. Each shard gives its k best, which are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boolsieve.operators.ranking import ranked
from boolsieve.session import Shared, small

#: Postings of the queries' terms in a shard, on average, and in a block.
SHARD_POSTINGS, BLOCK = 500_000, 64
#: Digits that scores are rounded to, so that the order of a sum does not decide a tie.
DIGITS = 9

_FOUND = "query_id long, doc_id long, score double, postings long, rated long"


class Postings:
    """A term's documents in order, their weights, and of each block the first document and the largest weight."""

    def __init__(self, docs: np.ndarray, weights: np.ndarray, block: int = BLOCK) -> None:
        order = np.argsort(docs, kind="stable")
        self.docs, self.weights = docs[order], weights[order]
        starts = np.arange(0, len(docs), block)
        self.first = self.docs[starts]
        self.most = np.maximum.reduceat(self.weights, starts)

    def bound(self, edges: np.ndarray) -> np.ndarray:
        """The largest weight that the block at each edge, or after it before the next one, has."""
        at = np.searchsorted(self.first, edges, side="right") - 1
        return np.where(at >= 0, self.most[np.maximum(at, 0)], 0.0)


def best_of(terms: list[Postings], k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents and scores of the k best by the sum of their weights, ties to the smaller id; and the postings that were rated."""
    edges = np.unique(np.concatenate([t.first for t in terms]))  # within a stretch each term has one block
    bound = sum(t.bound(edges) for t in terms)
    ends = np.append(edges[1:], np.iinfo(np.int64).max)
    order = np.argsort(-bound, kind="stable")
    docs, scores, rated, least, step = np.zeros(0, np.int64), np.zeros(0), 0, -np.inf, 4
    at = 0
    while at < len(order) and bound[order[at]] + 1e-6 >= least:
        some = order[at : at + step]
        some = some[bound[some] + 1e-6 >= least]
        at, step = at + step, min(step * 2, 256)
        parts = []
        for t in terms:
            a, b = np.searchsorted(t.docs, edges[some]), np.searchsorted(t.docs, ends[some])
            n = b - a
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            parts.append((t.docs[place], t.weights[place]))
        rated += sum(len(d) for d, _ in parts)
        own, to = np.unique(np.concatenate([d for d, _ in parts]), return_inverse=True)
        sums = np.round(np.bincount(to, np.concatenate([w for _, w in parts]), len(own)), DIGITS)
        docs, scores = np.concatenate([docs, own]), np.concatenate([scores, sums])
        keep = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[keep], scores[keep]
        least = scores[-1] if len(scores) == k else -np.inf
    return docs, scores, rated


def shard_best(post: DataFrame, lengths: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, shard_postings: int = SHARD_POSTINGS, block: int = BLOCK) -> DataFrame:
    """(query_id, doc_id, score, postings, rated): the k best of each shard, and of it and the query all and the rated postings."""
    spark = post.sparkSession
    asked: dict[int, list[str]] = {}
    for r in queries.select("query_id", "term").distinct().collect():  # a stated set of queries
        asked.setdefault(r["query_id"], []).append(r["term"])
    names = sorted({t for ts in asked.values() for t in ts})
    number = {t: i for i, t in enumerate(names)}
    terms = spark.createDataFrame(list(number.items()), "term string, number int")
    hits = post.join(small(terms), "term")
    df = hits.groupBy("number").agg(F.count("*").alias("df"))
    total = df.agg(F.sum("df")).first()[0] or 0
    shards = max(1, -(-total // shard_postings))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    rows = hits.join(small(df), "number").join(lengths, "doc_id").join(F.broadcast(stats))  # one row of stats
    weighted = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), "number", F.col("doc_id").cast("long").alias("doc_id"), weight.alias("weight"))
    shared = Shared(spark, {q: [number[t] for t in ts] for q, ts in asked.items()})

    def run(table: pa.Table) -> pa.Table:
        own, docs, weights = (table[c].to_numpy() for c in ("number", "doc_id", "weight"))
        order = np.argsort(own, kind="stable")
        own, docs, weights = own[order], docs[order], weights[order]
        cuts = np.flatnonzero(np.diff(own)) + 1
        held = {int(n[0]): Postings(d, w, block) for n, d, w in zip(np.split(own, cuts), np.split(docs, cuts), np.split(weights, cuts))}
        out = []
        for q, numbers in shared.value.items():
            found = [held[n] for n in numbers if n in held]
            if found:
                best, scores, rated = best_of(found, k)
                n = len(best)
                out.append(pa.table([pa.array(np.full(n, q)), pa.array(best), pa.array(scores), pa.array(np.full(n, sum(len(f.docs) for f in found))), pa.array(np.full(n, rated))], [c.split()[0] for c in _FOUND.split(", ")]))
        return pa.concat_tables(out)

    return weighted.groupBy("shard").applyInArrow(run, _FOUND)


def top_documents(post: DataFrame, lengths: DataFrame, queries: DataFrame, k: int, **how: float) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query by BM25, the rows that scoring all of them gives.

    post: (doc_id, term, tf); lengths: (doc_id, length); queries: (query_id, term), numbered, a stated set. Ids are whole
    numbers. Only postings of the queries' terms are dealt.
    """
    return ranked(shard_best(post, lengths, queries, k, **how).select("query_id", "doc_id", "score"), k)
