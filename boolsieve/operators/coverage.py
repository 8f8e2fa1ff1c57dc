"""Which documents rules cover, and what that is worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boolsieve.functions.rules import RULE_TYPE, Rule
from boolsieve.functions.safe import f_beta, precision, recall
from boolsieve.session import literal, small


def rule_table(spark, rules: list[Rule]) -> DataFrame:
    """(rule_id, rule): rules by their place in the list."""
    rows = [(i, [{"feats": list(f), "pos": p} for f, p in r]) for i, r in enumerate(rules)]
    return literal(spark, rows, f"rule_id long, rule {RULE_TYPE}")


def rule_terms(rules: DataFrame) -> DataFrame:
    """(rule_id, lit, pos, term): one row for each term of each literal."""
    lits = rules.select("rule_id", F.posexplode("rule").alias("lit", "x"))
    return lits.select("rule_id", "lit", F.col("x.pos").alias("pos"), F.explode("x.feats").alias("term"))


def coverage(post: DataFrame, rules: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(rule_id, doc_id): the documents that have a term of every positive literal and none of a negative one.

    Postings meet the rules' terms in one join; a document fits a rule if as many of the positive literals as there are
    were hit, and no negative one. Rules without a positive literal need ``docs`` and are subtracted from it.
    """
    terms = rule_terms(rules)
    need = rules.select("rule_id", F.size(F.filter("rule", lambda x: x["pos"])).alias("need"))
    hits = post.join(small(terms), "term").groupBy("rule_id", "doc_id").agg(
        F.count_distinct(F.when(F.col("pos"), F.col("lit"))).alias("got"), F.max(~F.col("pos")).alias("bad")
    )
    fits = hits.join(small(need), "rule_id").filter("need > 0 and got = need and not bad").select("rule_id", "doc_id")
    if docs is not None:
        only_not = need.filter("need = 0").select("rule_id")
        every = docs.select("doc_id").join(small(only_not))  # a stated rule set against all documents
        fits = fits.unionByName(every.join(hits.filter("bad").select("rule_id", "doc_id"), ["rule_id", "doc_id"], "left_anti").select("rule_id", "doc_id"))
    return fits


def covers(rule: Rule, terms: Column) -> Column:
    """A rule as a condition on an array of terms."""
    out = F.lit(True)
    for feats, pos in rule:
        hit = F.arrays_overlap(terms, F.array(*[F.lit(f) for f in feats]))
        out = out & (hit if pos else ~hit)
    return out


def any_covers(rules: list[Rule], terms: Column) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | covers(r, terms)
    return out


def mask_metrics(rows: DataFrame, hit: Column, y: Column, *by: str, betas: tuple[float, ...] = (1.0,)) -> DataFrame:
    """tp, returned, positives, precision, recall and F of a condition, in one aggregation (by groups, if any are named)."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = rows.groupBy(*by).agg(n(hit & (y == 1)).alias("tp"), n(hit).alias("returned"), n(y == 1).alias("positives"))
    out = out.withColumn("precision", precision(F.col("tp"), F.col("returned"))).withColumn("recall", recall(F.col("tp"), F.col("positives")))
    for b in betas:
        out = out.withColumn(f"f{b:g}", f_beta(F.col("precision"), F.col("recall"), b))
    return out


def rule_metrics(cover: DataFrame, labels: DataFrame, rules: DataFrame, beta: float = 1.0) -> DataFrame:
    """(rule_id, tp, returned, precision, recall, f) of every rule, also of those that cover nothing."""
    total = labels.agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("positives"))
    got = cover.join(labels, "doc_id").groupBy("rule_id").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("tp"), F.count("*").alias("returned"))
    out = rules.select("rule_id").join(got, "rule_id", "left").fillna(0, ["tp", "returned"]).join(F.broadcast(total))  # one row
    out = out.withColumn("precision", precision(F.col("tp"), F.col("returned"))).withColumn("recall", recall(F.col("tp"), F.col("positives")))
    return out.withColumn("f", f_beta(F.col("precision"), F.col("recall"), beta)).drop("positives")


def cover_counts(cover: DataFrame, selected: DataFrame) -> DataFrame:
    """(doc_id, c): by how many selected rules each document is covered."""
    return cover.join(small(selected), "rule_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("c"))


def move_scores(cover: DataFrame, labels: DataFrame, selected: DataFrame, costs: DataFrame, beta: float, cost_factor: float) -> DataFrame:
    """(r_in, r_out, tp, fp, fn, cost, score) of adding, removing and swapping rules, all in one job.

    Adding gains the documents that nothing covers; removing loses those that only the removed rule covers; a swap does
    both, and keeps those that only the removed rule covers and the new one covers too.
    """
    counts = cover_counts(cover, selected)
    rows = cover.join(labels, "doc_id").join(counts, "doc_id", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    p = F.when(F.col("y") == 1, 1).otherwise(0)
    mine = F.broadcast(selected.withColumn("mine", F.lit(True)))
    rows = rows.join(mine, "rule_id", "left").withColumn("mine", F.coalesce("mine", F.lit(False)))
    add = rows.filter("not mine and c = 0").groupBy("rule_id").agg(F.sum(p).alias("gp"), F.count("*").alias("gn"))
    drop = rows.filter("mine and c = 1").groupBy("rule_id").agg(F.sum(p).alias("lp"), F.count("*").alias("ln"))
    single = rows.filter("mine and c = 1").select("doc_id", F.col("rule_id").alias("r_out"))
    both = rows.filter("not mine and c = 1").select("doc_id", F.col("rule_id").alias("r_in"), "y").join(single, "doc_id")
    both = both.groupBy("r_in", "r_out").agg(F.sum(p).alias("op"), F.count("*").alias("on"))
    now = labels.join(counts, "doc_id", "left").agg(
        F.sum(F.when(F.col("c") > 0, p).otherwise(0)).alias("tp"), F.sum(F.when(F.col("c") > 0, 1 - p).otherwise(0)).alias("fp"), F.sum(p).alias("pos")
    )
    rules_in = costs.join(mine, "rule_id", "left_anti").join(add, "rule_id", "left").select(F.col("rule_id").alias("r_in"), F.col("cost").alias("c_in"), "gp", "gn")
    rules_out = costs.join(mine, "rule_id", "left_semi").join(drop, "rule_id", "left").select(F.col("rule_id").alias("r_out"), F.col("cost").alias("c_out"), "lp", "ln")
    cost_now = costs.join(mine, "rule_id", "left_semi").agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost_now"))
    none = F.lit(None).cast("long")
    adds = rules_in.withColumn("r_out", none).withColumn("c_out", F.lit(0.0)).withColumn("lp", none).withColumn("ln", none)
    removes = rules_out.withColumn("r_in", none).withColumn("c_in", F.lit(0.0)).withColumn("gp", none).withColumn("gn", none)
    swaps = rules_in.join(F.broadcast(rules_out))  # at most max_rules rows on one side
    names = ["r_in", "r_out", "c_in", "c_out", "gp", "gn", "lp", "ln"]
    moves = adds.select(names).unionByName(removes.select(names)).unionByName(swaps.select(names)).join(both, ["r_in", "r_out"], "left").fillna(0, ["gp", "gn", "lp", "ln", "op", "on"])
    d_p = F.col("gp") - F.col("lp") + F.col("op")
    d_n = F.col("gn") - F.col("ln") + F.col("on")
    out = moves.join(F.broadcast(now)).join(F.broadcast(cost_now))  # one row each
    out = out.select("r_in", "r_out", (F.col("tp") + d_p).alias("tp"), (F.col("fp") + d_n - d_p).alias("fp"), (F.col("pos") - F.col("tp") - d_p).alias("fn"), (F.col("cost_now") + F.col("c_in") - F.col("c_out")).alias("cost"))
    f = f_beta(precision(F.col("tp"), F.col("tp") + F.col("fp")), recall(F.col("tp"), F.col("tp") + F.col("fn")), beta)
    return out.withColumn("score", f - F.lit(cost_factor) * F.col("cost"))


def variable_frequencies(rule_trees: DataFrame, n_trees: int) -> DataFrame:
    """(term, tree_freq, rule_freq) from (rule_id, rule, trees): the share of trees and of rules that have a term."""
    rows = rule_trees.select("rule_id", "trees", F.explode(F.array_distinct(F.flatten(F.transform("rule", lambda x: x["feats"])))).alias("term"))
    n_rules = rule_trees.agg(F.count_distinct("rule_id").alias("n_rules"))
    trees = rows.select("term", F.explode("trees").alias("tree")).groupBy("term").agg(F.count_distinct("tree").alias("t"))
    counted = rows.groupBy("term").agg(F.count_distinct("rule_id").alias("r")).join(trees, "term").join(F.broadcast(n_rules))  # one row
    return counted.select("term", (F.col("t") / F.lit(float(n_trees))).alias("tree_freq"), (F.col("r") / F.col("n_rules")).alias("rule_freq"))


def one_step_variations(rules: DataFrame) -> DataFrame:
    """(rule_id, mode, in_negated, removed, variant): each rule without one term of a larger literal, or without one literal.

    Variants without a positive literal are left out; variants are in canonical order.
    """
    lits = rules.select("rule_id", "rule", F.posexplode("rule").alias("at", "lit"))
    without = F.filter("rule", lambda x, i: i != F.col("at"))
    several = F.size("rule") > 1
    drops = lits.filter(several).select("rule_id", F.lit("and").alias("mode"), (~F.col("lit.pos")).alias("in_negated"), F.col("lit.feats").alias("removed"), without.alias("variant"))
    each = lits.filter(F.size("lit.feats") > 1).select("*", F.explode("lit.feats").alias("f"))
    fewer = F.struct(F.filter(F.col("lit.feats"), lambda x: x != F.col("f")).alias("feats"), F.col("lit.pos").alias("pos"))
    ors = each.select("rule_id", F.lit("or").alias("mode"), (~F.col("lit.pos")).alias("in_negated"), F.array("f").alias("removed"), F.concat(without, F.array(fewer)).alias("variant"))
    ordered = F.transform(F.array_sort(F.transform("variant", lambda x: F.struct((~x["pos"]).alias("neg"), x["feats"].alias("feats")))), lambda x: F.struct(x["feats"].alias("feats"), (~x["neg"]).alias("pos")))
    return ors.unionByName(drops).filter(F.exists("variant", lambda x: x["pos"])).withColumn("variant", ordered)
