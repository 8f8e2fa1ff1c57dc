"""Greedy covering of positive documents by terms."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boolsieve.functions.safe import ratio
from boolsieve.session import cut

#: Terms whose counts are refreshed in one pass; each task hands on the square of it, 4,096 numbers.
LEADERS = 64
#: Terms that the driver holds at a time, the best by their last known counts.
HELD = 4096


def candidates(post: DataFrame, labels: DataFrame, covered: DataFrame | None = None, min_total: int = 10, min_new: int = 10) -> DataFrame:
    """(term, total, fresh, score): terms with enough documents and enough new positives, by the share of the latter."""
    total = post.join(labels.select("doc_id"), "doc_id", "left_semi").groupBy("term").agg(F.count("*").alias("total"))
    open_ = labels.filter("y = 1").select("doc_id")
    if covered is not None:
        open_ = open_.join(covered, "doc_id", "left_anti")
    fresh = post.join(open_, "doc_id", "left_semi").groupBy("term").agg(F.count("*").alias("fresh"))
    rows = total.filter(F.col("total") >= min_total).join(fresh.filter(F.col("fresh") >= min_new), "term")
    return rows.withColumn("score", ratio(F.col("fresh"), F.col("total")))


def greedy_cover(post: DataFrame, labels: DataFrame, max_steps: int, min_total: int = 10, min_new: int = 10) -> list[dict]:
    """The chosen terms in order, with new and all covered positives: at each step the best of ``candidates``, ties by fresh, then term."""
    return lazy_cover(post, labels, max_steps, min_total, min_new)[0]


def lazy_cover(post: DataFrame, labels: DataFrame, max_steps: int, min_total: int = 10, min_new: int = 10, leaders: int = LEADERS, held: int = HELD) -> tuple[list[dict], int]:
    """(the rows of ``greedy_cover``, passes over the documents).

    What a term newly covers only falls while others are chosen, so an old count bounds it from above and is refreshed only
    when it leads. A pass counts the leading terms and all pairs of them over open documents; the pairs tell what is left of
    a term after one choice exactly, and after more within bounds, so a pass makes choices as long as these leave no doubt.
    Documents are a row each with their terms: covered ones drop out by a filter, without a join.
    """
    bounds = cut(candidates(post, labels, None, min_total, min_new).select("term", "total", "fresh", "score"))
    positives = post.join(labels.filter("y = 1").select("doc_id"), "doc_id", "left_semi").join(bounds.select("term"), "term", "left_semi")
    docs = cut(positives.groupBy("doc_id").agg(F.collect_list("term").alias("terms")))
    heap: list[tuple] = []  # (-score, -fresh, term as bytes, total), an upper bound of each
    last, more, out, passes = None, True, [], 0
    while len(out) < max_steps:
        if more and (last is None or not heap or heap[0][:3] > last or len(heap) < leaders):
            rows = _best(bounds, last, held)
            for row in rows:
                heapq.heappush(heap, row)
            more = len(rows) == held
            last = rows[-1][:3] if rows else last
            continue
        lead = [heapq.heappop(heap) for _ in range(min(leaders, len(heap)))]
        if not lead:
            break
        passes += 1
        both = _pairs(docs, [p["term"] for p in out], [t.decode() for _, _, t, _ in lead])
        rest = min([heap[0][:3]] if heap else [], default=None)
        rest = min([k for k in (rest, last if more else None) if k], default=None)
        low = both.diagonal().copy()
        high = low.copy()
        alive = [i for i in range(len(lead)) if high[i] >= min_new]
        while alive and len(out) < max_steps:
            key = lambda i: (-high[i] / lead[i][3], -int(high[i]), lead[i][2])
            best = min(alive, key=key)
            if low[best] != high[best] or rest is not None and key(best) > rest:
                break
            fresh = int(high[best])
            out.append({"step": len(out), "term": lead[best][2].decode(), "fresh": fresh, "total": lead[best][3], "covered": fresh + (out[-1]["covered"] if out else 0)})
            first = both.diagonal()
            low = np.maximum(low - both[best], 0)
            high = np.minimum(high, first - both[best])
            alive = [i for i in alive if i != best and high[i] >= min_new]
        for i in alive:
            heapq.heappush(heap, (-high[i] / lead[i][3], -int(high[i]), lead[i][2], lead[i][3]))
    return out, passes


def _best(bounds: DataFrame, last: tuple | None, n: int) -> list[tuple]:
    """The next ``n`` rows of the order in which terms are chosen, after the key ``last``."""
    if last is not None:
        score, fresh, term = -last[0], -last[1], last[2].decode()
        after = (F.col("fresh") < fresh) | ((F.col("fresh") == fresh) & (F.col("term") > term))
        bounds = bounds.filter((F.col("score") < score) | ((F.col("score") == score) & after))
    rows = bounds.orderBy(F.desc("score"), F.desc("fresh"), "term").limit(n).collect()
    return [(-r["score"], -r["fresh"], r["term"].encode(), r["total"]) for r in rows]


def _pairs(docs: DataFrame, chosen: list[str], lead: list[str]) -> np.ndarray:
    """How many documents without a chosen term have both of two leading terms. A task adds up its documents first."""
    place = {t: i for i, t in enumerate(lead)}
    n = len(lead)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n, n), np.int64)
        for b in batches:
            found = [[place[t] for t in terms] for terms in b.column("terms").to_pylist()]
            has = np.zeros((len(found), n), np.float64)  # counts of a batch are exact in it, and its product is quick
            for row, at in zip(has, found):
                row[at] = 1
            sums += (has.T @ has).astype(np.int64)
        i, j = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(sums[i, j])], ["i", "j", "n"])

    if chosen:
        docs = docs.filter(~F.arrays_overlap("terms", F.array(*map(F.lit, chosen))))
    terms = F.array_intersect("terms", F.array(*map(F.lit, lead)))
    rows = docs.select(terms.alias("terms")).filter(F.size("terms") > 0).mapInArrow(run, "i long, j long, n long")
    out = np.zeros((n, n), np.int64)
    for r in rows.groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # at most LEADERS squared
        out[r["i"], r["j"]] = r["n"]
    return out
