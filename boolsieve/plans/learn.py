"""From labelled documents to a Boolean query: vocabulary, forest, rules, selection, string, and what it retrieves."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boolsieve.functions import boolean
from boolsieve.functions.rules import Rule, cost, render, rule
from boolsieve.operators import coverage, vocabulary
from boolsieve.operators.splits import class_weight
from boolsieve.plans import rules as rule_plans
from boolsieve.plans import trees as tree_plans
from boolsieve.plans.shards import build
from boolsieve.plans.trees import Forest, Params
from boolsieve.session import cut


# fixed values: the defaults
@dataclass(frozen=True)
class Settings:
    """A learning run. Bounds of the vocabulary, trees, forest, and how rules are pruned, selected and written."""

    min_df: float = 3
    max_df: float = 0.5
    params: Params = Params()
    forest: Forest = Forest()
    goal: str = "f1"
    min_tree_occ: float = 0.05
    min_rule_occ: float = 0.02
    min_precision: float = 0.01
    pruning_beta: float = 0.1
    cover_beta: float = 2.0
    cost_factor: float = 0.002
    max_rules: int = 10
    genetic: bool = False
    tiab: bool = False
    mh_noexp: bool = False
    expansions: dict = field(default_factory=dict, hash=False)


@dataclass
class Learned:
    """The query, its rules over terms, its size and cost, and the objective on the training rows."""

    query: str
    rules: list[Rule]
    size: dict
    cost: float
    objective: float


def weighted(labels: DataFrame, alpha: float | str | None) -> DataFrame:
    """(doc_id, y, w) of labels (doc_id, y): one row an id, weights by class. Ids with a null id or label are left out."""
    rows = cut(labels.filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").cast("int").alias("y")))
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    w = class_weight(n.get(0, 0), n.get(1, 0), alpha)
    return rows.withColumn("w", F.when(F.col("y") == 1, F.lit(int(w[1] * 100))).otherwise(F.lit(int(w[0] * 100))))


def learn(post: DataFrame, labels: DataFrame, settings: Settings = Settings(), driver_postings: int | None = None) -> Learned:
    """The query for labels (doc_id, y) or weighted ones (doc_id, y, w), from postings (doc_id, term).

    Only labelled documents count. Their rows are dealt to shards, and the forest, thresholds, pruning and selection are sums
    over the shards, in the driver for few postings and in tasks for more: the rules are the same. Raises ValueError if
    there is one class only, or nothing splits it.
    """
    docs = cut(labels.select("doc_id", "y", "w") if "w" in labels.columns else weighted(labels, settings.params.class_weight))
    own = cut(post.join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id", "term"))
    vocab = cut(vocabulary.vocabulary(own, docs.count(), settings.min_df, settings.max_df))
    shards = build(vocabulary.restrict(own, vocab), docs, vocab.count(), driver_postings=driver_postings)
    trees = tree_plans.fit_forest(shards, settings.params, settings.forest)
    if not trees:
        raise ValueError("nothing splits the classes")
    limits = {k: tree_plans.threshold_of(leaves, settings.goal)[0] for k, leaves in tree_plans.leaf_counts(shards, trees).items()}
    trees = {k: t for k, t in trees.items() if limits[k] is not None}
    found = rule_plans.forest_rules(trees, limits)
    kept = rule_plans.prune_rare(found, max(1, len(trees)), settings.min_tree_occ, settings.min_rule_occ) or found
    scores = rule_plans.Scores(shards, settings.pruning_beta)
    pool = rule_plans.pool(kept, scores, settings.min_precision)
    if not pool.rules:
        raise ValueError("no rule is precise enough")
    if len(pool.rules) == 1:
        chosen, value = [0], float("nan")
    elif settings.genetic:
        chosen, value = rule_plans.select_genetic(shards, pool, settings.cover_beta, settings.cost_factor, settings.max_rules)
    else:
        chosen, value = rule_plans.select_local(shards, pool, settings.cover_beta, settings.cost_factor, max_rules=settings.max_rules)
    used = sorted({f for i in chosen for feats, _ in pool.rules[i] for f in feats})
    name = {r["term_id"]: r["term"] for r in vocab.filter(F.col("term_id").isin(used)).collect()}
    rules = sorted(rule([([name[f] for f in feats], pos) for feats, pos in pool.rules[i]]) for i in chosen)
    query, size = render(rules, None, settings.expansions, settings.tiab, settings.mh_noexp)
    return Learned(query, rules, size, cost(size), value)


def evaluate(query: str, docs: DataFrame, tokens: Column, y: Column) -> DataFrame:
    """tp, returned, positives, precision, recall, F1, F3 and F50 of a query on documents."""
    return coverage.mask_metrics(docs, boolean.to_column(boolean.parse(query), tokens), y, betas=(1.0, 3.0, 50.0))


def synthetic_corpus(spark: SparkSession, formula: str, n_docs: int = 0, pool: int = 1000, mean_length: int = 60, share: float = 1.0, error: float = 0.0, seed: int = 42, ids: DataFrame | None = None) -> DataFrame:
    """(doc_id, terms, y): documents over all assignments of a formula's variables, with random filler terms.

    Documents are numbered from 0, or are those of ``ids`` (id). ``share`` of the assignments are used, ``error`` of the labels flipped. All randomness is a hash of seed and row.
    """
    node = boolean.parse(formula)
    variables = sorted({t.text for t in boolean.terms_of(node)})
    n = len(variables)
    bit = lambda i, k: F.pmod(F.floor(i / F.lit(float(1 << k))), F.lit(2)) == 1
    hashed = lambda *x: F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in x]).cast("binary"))
    uniform = lambda *x: F.conv(F.substring(hashed(*x), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    used = max(1, round((1 << n) * share))
    row = F.col("id")
    assigned = F.pmod(row, F.lit(used)) * F.lit(((1 << n) // used) or 1)
    own = F.filter(F.array(*[F.when(bit(assigned, k), F.lit(v)) for k, v in enumerate(variables)]), lambda t: t.isNotNull())
    filler = F.floor(uniform(row, F.lit("length")) * F.lit(max(1, 2 * mean_length - n))).cast("int")
    words = F.when(filler > 0, F.transform(F.sequence(F.lit(1), F.greatest(filler, F.lit(1))), lambda k: F.concat(F.lit("r"), F.floor(uniform(row, k) * max(1, pool - n)).cast("string")))).otherwise(F.array().cast("array<string>"))
    truth = boolean.fold(node, lambda t: bit(assigned, variables.index(t.text)), lambda a, b: a & b, lambda a, b: a | b, lambda a: ~a)
    flipped = truth != (uniform(row, F.lit("flip")) < error)
    return (spark.range(n_docs) if ids is None else ids).select(row.alias("doc_id"), F.array_distinct(F.concat(own, words)).alias("terms"), flipped.cast("int").alias("y"))
