"""Splits of a tree's nodes on "has any of these terms", as aggregations over postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boolsieve.functions.safe import gini, ratio
from boolsieve.session import small


def node_totals(state: DataFrame) -> DataFrame:
    """(node, n, w, w1) of the rows (doc_id, node, y, w) of open nodes."""
    return state.groupBy("node").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("w1"))


def term_totals(post: DataFrame, state: DataFrame) -> DataFrame:
    """(node, term, n_l, w_l, w1_l): what each term takes to the left in each node."""
    return post.join(state, "doc_id").groupBy("node", "term").agg(F.count("*").alias("n_l"), F.sum("w").alias("w_l"), F.sum(F.col("w") * F.col("y")).alias("w1_l"))


def weighted_impurity(n_l: Column, w_l: Column, w1_l: Column, n: Column, w: Column, w1: Column) -> Column:
    """Mean impurity of both sides, by weight."""
    left, right = ratio(w1_l, w_l), ratio(w1 - w1_l, w - w_l)
    return ratio(w_l * gini(left) + (w - w_l) * gini(right), w)


def rated(totals: DataFrame, nodes: DataFrame, root_weight: float, min_rows: int, min_share: float, prefer: float | None = None) -> DataFrame:
    """Valid splits with ``impurity``, ``gain`` and ``positive`` (the left side has the higher share).

    Each side needs ``min_rows`` rows, ``min_share`` of the root's weight, and some weight. ``prefer`` multiplies the gain
    of positive splits.
    """
    joined = totals.join(small(nodes), "node")
    w_r = F.col("w") - F.col("w_l")
    valid = (F.col("n_l") >= min_rows) & (F.col("n") - F.col("n_l") >= min_rows) & (F.col("w_l") > 0) & (w_r > 0)
    valid = valid & (F.col("w_l") >= min_share * root_weight) & (w_r >= min_share * root_weight)
    out = joined.filter(valid).withColumn("impurity", weighted_impurity(*[F.col(c) for c in ("n_l", "w_l", "w1_l", "n", "w", "w1")]))
    out = out.withColumn("positive", ratio(F.col("w1_l"), F.col("w_l")) > ratio(F.col("w1") - F.col("w1_l"), w_r))
    gain = gini(ratio(F.col("w1"), F.col("w"))) - F.col("impurity")
    return out.withColumn("gain", F.when(F.col("positive"), gain * prefer).otherwise(gain) if prefer else gain)


def best_terms(splits: DataFrame, k: int) -> DataFrame:
    """The k splits of the highest gain in each node, with ``rank`` from 1; ties by term."""
    order = Window.partitionBy("node").orderBy(F.desc("gain"), "term")
    return splits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def best_split(splits: DataFrame) -> DataFrame:
    """(node, term, impurity, gain) of the best split of each node, by a partial aggregate."""
    first = F.min_by(F.struct("term", "impurity", "gain"), F.struct((-F.col("gain")).alias("g"), "term"))
    return splits.groupBy("node").agg(first.alias("b")).select("node", "b.term", "b.impurity", "b.gain")


def or_candidates(post: DataFrame, state: DataFrame, chosen: DataFrame, candidates: DataFrame, root_weight: float, min_rows: int, min_share: float) -> DataFrame:
    """Splits on the chosen terms of each node and one candidate more: (node, term, impurity, drop).

    ``chosen`` is (node, term), ``candidates`` (node, term). The totals of a union are those of the chosen terms' documents
    and of the candidate's documents outside them, so one aggregation over what is not covered yet rates all candidates.
    """
    covered = post.join(small(chosen), "term").join(state.select("doc_id", "node"), ["doc_id", "node"]).select("doc_id", "node").distinct()
    base = covered.join(state, ["doc_id", "node"]).groupBy("node").agg(F.count("*").alias("n_c"), F.sum("w").alias("w_c"), F.sum(F.col("w") * F.col("y")).alias("w1_c"))
    rest = state.join(covered, ["doc_id", "node"], "left_anti")
    more = post.join(small(candidates), "term").join(rest, ["doc_id", "node"]).groupBy("node", "term")
    more = more.agg(F.count("*").alias("n_m"), F.sum("w").alias("w_m"), F.sum(F.col("w") * F.col("y")).alias("w1_m"))
    nodes = node_totals(state)
    zero = F.lit(0)
    union = candidates.join(more, ["node", "term"], "left").join(small(base), "node").select(
        "node", "term", *[(F.col(f"{c}_c") + F.coalesce(f"{c}_m", zero)).alias(f"{c}_l") for c in ("n", "w", "w1")], *[F.col(f"{c}_c") for c in ("n", "w", "w1")]
    )
    out = rated(union, nodes, root_weight, min_rows, min_share)
    before = weighted_impurity(*[F.col(c) for c in ("n_c", "w_c", "w1_c", "n", "w", "w1")])
    return out.select("node", "term", "impurity", (before - F.col("impurity")).alias("drop"))


def class_weight(n0: int, n1: int, alpha: float | str | None) -> dict[int, float]:
    """Weights of both classes: None 1 and 1; a number or "balanced" (1) raises class 1 by (n0 / n1) ** alpha, rounded half to even."""
    if not n0 or not n1:
        raise ValueError("both classes are needed")
    if isinstance(alpha, dict):
        return alpha
    if alpha is None:
        return {0: 1, 1: 1}
    alpha = 1.0 if alpha == "balanced" else float(alpha)
    return {0: 1, 1: max(1, round((n0 / n1) ** alpha))}
