"""Parameter studies: search space, sampler, pruning, and the best trials by measure."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import product
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boolsieve.functions.safe import f_beta, ratio

# fixed values: the parameters of a learning run that a study varies, name: (kind, low, high, step) or ("choice", values)
SPACE: dict[str, tuple] = {
    "max_depth": ("int", 3, 10, 1), "min_weight_fraction_leaf": ("float", 0.0, 0.002, 0.0001), "top_k": ("float", 0.1, 2.0, 0.1), "dont_cares": ("float", 0.0, 5.0, 0.25),
    "rank_weight": ("float", 1.0, 10.0, 0.5), "max_features": ("float", 0.01, 1.0, 0.01), "min_impurity_decrease_range_start": ("float", 0.001, 0.05, 0.0035),
    "min_impurity_decrease_range_end": ("float", 0.001, 0.05, 0.0035), "class_weight": ("float", 0.0, 1.0, 0.1), "top_k_or_candidates": ("int", 500, 3000, 500),
    "randomize_max_feature": ("float", 0.0, 3.0, 0.3), "randomize_min_impurity_decrease_range": ("float", 0.0, 3.0, 0.3), "min_tree_occ": ("float", 0.0, 0.2, 0.02),
    "min_rule_occ": ("float", 0.0, 0.1, 0.01), "cover_beta": ("float", 0.1, 2.0, 0.1), "pruning_beta": ("float", 0.05, 1.0, 0.05), "term_expansions": ("choice", (True, False)),
    "mh_noexp": ("choice", (True, False)), "tiab": ("choice", (True, False)),
}

TRIAL_SCHEMA = "study string, trial int, state string, params string, topic string, step int, precision double, recall double, value double"


def draw(space: dict[str, tuple], rng: np.random.Generator, good: list[dict] | None = None) -> dict[str, Any]:
    """A parameter set; with some good ones, half of the values are taken near those of one of them."""
    near = good[int(rng.integers(len(good)))] if good else None
    out: dict[str, Any] = {}
    for name, spec in space.items():
        if spec[0] == "choice":
            out[name] = near[name] if near and rng.random() < 0.5 else spec[1][int(rng.integers(len(spec[1])))]
            continue
        kind, low, high, *step = spec
        a, b = (math.log(low), math.log(high)) if kind == "log" else (low, high)
        x = rng.uniform(a, b)
        if near is not None and rng.random() < 0.5:
            middle = math.log(near[name]) if kind == "log" else near[name]
            x = min(max(rng.normal(middle, (b - a) / 10), a), b)
        x = math.exp(x) if kind == "log" else x
        if step:
            x = min(low + round((x - low) / step[0]) * step[0], high)
        out[name] = round(x) if kind == "int" else round(x, 6)
    return out


@dataclass
class Study:
    """Trials one after another: draw, skip what was tried, measure topic by topic, give up below the median.

    ``measure(params, topic)`` gives (precision, recall). ``rows`` holds a row for each measured topic.
    """

    name: str
    beta: float
    topics: list[str]
    measure: Callable[[dict, str], tuple[float, float]]
    space: dict[str, tuple]
    seed: int = 1
    warm: Iterable[dict] = ()

    def run(self, n_trials: int) -> list[tuple]:
        rng = np.random.default_rng(self.seed)
        queue = list(self.warm)
        seen: set[str] = set()
        done: list[tuple[float, dict]] = []
        running: dict[int, list[float]] = {}
        rows: list[tuple] = []
        for trial in range(n_trials):
            good = [p for _, p in sorted(done, key=lambda x: -x[0])[: max(1, len(done) // 4)]] if len(done) >= 4 else None
            params = queue.pop(0) if queue else draw(self.space, rng, good)
            key = json.dumps(params, sort_keys=True)
            if key in seen:
                rows.append((self.name, trial, "DUPLICATE", key, None, None, None, None, None))
                continue
            seen.add(key)
            values: list[float] = []
            own: list[tuple] = []
            state = "COMPLETE"
            for step, topic in enumerate(self.topics):
                p, r = self.measure(params, topic)
                b2 = self.beta**2
                values.append((1 + b2) * p * r / (b2 * p + r) if b2 * p + r else 0.0)
                own.append((topic, step, p, r, values[-1]))
                mean = sum(values) / len(values)
                others = running.setdefault(step, [])
                if len(others) >= 4 and step < len(self.topics) - 1 and mean < sorted(others)[len(others) // 2]:
                    state = "PRUNED"
                others.append(mean)
                if state == "PRUNED":
                    break
            if state == "COMPLETE":
                done.append((sum(values) / len(values), params))
            rows += [(self.name, trial, state, key, *x) for x in own]
        return rows


def trials_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, TRIAL_SCHEMA)


def trial_means(trials: DataFrame, betas: list[float]) -> DataFrame:
    """(study, trial, params, beta, avg_fbeta, avg_precision, avg_recall, topics) of complete trials."""
    grid = trials.sparkSession.createDataFrame([(float(b),) for b in betas], "beta double")
    rows = trials.filter("state = 'COMPLETE'").join(F.broadcast(grid))  # a stated list of betas
    b2 = F.col("beta") * F.col("beta")
    f = ratio((1 + b2) * F.col("precision") * F.col("recall"), b2 * F.col("precision") + F.col("recall"))
    return rows.groupBy("study", "trial", "params", "beta").agg(F.avg(f).alias("avg_fbeta"), F.avg("precision").alias("avg_precision"), F.avg("recall").alias("avg_recall"), F.count("*").alias("topics"))


def best_per_beta(means: DataFrame) -> DataFrame:
    """The best trial of each beta; ties by study and trial."""
    order = F.struct((-F.col("avg_fbeta")).alias("v"), "study", "trial")
    row = F.struct("study", "trial", "params", "avg_fbeta", "avg_precision", "avg_recall", "topics")
    return means.groupBy("beta").agg(F.min_by(row, order).alias("b")).select("beta", "b.*")


def merge_best(best: DataFrame) -> DataFrame:
    """(params, avg_precision, avg_recall, topics, betas): parameter sets once, with the betas they are best for."""
    rows = best.groupBy("params").agg(
        F.first("avg_precision").alias("avg_precision"), F.first("avg_recall").alias("avg_recall"), F.first("topics").alias("topics"),
        F.array_sort(F.collect_list(F.struct("beta", "avg_fbeta"))).alias("b"),
    )
    return rows.select("params", "avg_precision", "avg_recall", "topics", F.map_from_entries("b").alias("betas"))


def best_with_recall(means: DataFrame, least: float) -> DataFrame:
    """The best trial of each beta among those with enough mean recall."""
    return best_per_beta(means.filter(F.col("avg_recall") >= least))


def ablation_grid(spark: SparkSession, base: dict, overrides: dict[str, dict], topics: list[str], trials: int = 1) -> DataFrame:
    """(name, params, topic, trial): every named change of the base parameters for every topic and trial."""
    rows = [(name, json.dumps(base | change, sort_keys=True), t, k) for (name, change), t, k in product(overrides.items(), topics, range(trials))]
    return spark.createDataFrame(rows, "name string, params string, topic string, trial int")


def known_only(base: dict, tuned: dict) -> dict:
    """The base parameters with the tuned values of those that it has."""
    return base | {k: v for k, v in tuned.items() if k in base}


def known_rows(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """``known_only`` of tables (name, value)."""
    return base.join(tuned.select("name", F.col("value").alias("_tuned")), "name", "left").select("name", F.coalesce("_tuned", "value").alias("value"))


def mean_by_value(trials: DataFrame, name: str) -> DataFrame:
    """(value, mean, n): the mean measure of every value of one parameter."""
    value = F.get_json_object("params", f"$.{name}")
    return trials.filter("value is not null").groupBy(value.alias("value")).agg(F.avg("value").alias("mean"), F.count("*").alias("n")).orderBy("value")


def best_run(rows: DataFrame, beta: float = 50.0, min_positives: int = 50) -> DataFrame:
    """(file, precision, recall, f): of result rows by file the one with the best F of mean precision and mean recall; ties by file."""
    means = rows.filter(F.col("num_positive") >= min_positives).groupBy("file").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))
    rated = means.withColumn("f", f_beta(F.col("precision"), F.col("recall"), beta))
    return rated.agg(F.min_by(F.struct("file", "precision", "recall", "f"), F.struct((-F.col("f")).alias("v"), "file")).alias("b")).select("b.*")
