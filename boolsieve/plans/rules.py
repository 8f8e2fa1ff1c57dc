"""From the rules of a forest to a small set of them: rare terms out, greedy pruning, local or genetic selection."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

from boolsieve.functions.bitmaps import union
from boolsieve.functions.rules import Rule, has_positive, rule, rule_cost
from boolsieve.functions.safe import f_beta_of, ratio_of
from boolsieve.operators import bitmaps
from boolsieve.plans.shards import Part, Shards
from boolsieve.plans.trees import Node, paths


@dataclass(frozen=True)
class Limits:
    """A variant is accepted if its measure's change is at least ``accept``; from ``replace`` on it takes its parent's place."""

    measure: str
    accept: float = -0.1
    replace: float = -0.01


# fixed values: by kind of removal and whether it was in a negative literal, the measure and its bounds (those of Limits)
PRUNING = {
    ("or", False): Limits("tp_gain"), ("or", True): Limits("precision_gain"),
    ("and", False): Limits("precision_gain"), ("and", True): Limits("precision_gain"),
}


def forest_rules(trees: dict[int, Node], threshold: float | dict[int, float]) -> dict[Rule, set[int]]:
    """Each rule with the trees that have it."""
    out: dict[Rule, set[int]] = {}
    for k, tree in trees.items():
        for r in paths(tree, threshold[k] if isinstance(threshold, dict) else threshold):
            out.setdefault(r, set()).add(k)
    return out


def frequencies(rules: dict[Rule, set[int]], n_trees: int) -> tuple[dict[int, float], dict[int, float]]:
    """The share of trees and the share of rules that have a term."""
    trees: dict[int, set[int]] = {}
    counts: dict[int, int] = {}
    for r, ids in rules.items():
        for f in {f for feats, _ in r for f in feats}:
            trees.setdefault(f, set()).update(ids)
            counts[f] = counts.get(f, 0) + 1
    return {f: len(t) / n_trees for f, t in trees.items()}, {f: n / len(rules) for f, n in counts.items()}


def prune_rare(rules: dict[Rule, set[int]], n_trees: int, min_trees: float = 0.05, min_rules: float = 0.02) -> dict[Rule, set[int]]:
    """Rules without terms that too few trees or rules have; a literal that loses all its terms goes, as do all-negative rules."""
    by_tree, by_rule = frequencies(rules, n_trees)
    kept = {f for f, share in by_tree.items() if share >= min_trees and by_rule[f] >= min_rules}
    out: dict[Rule, set[int]] = {}
    for r, ids in rules.items():
        new = rule([([f for f in feats if f in kept], pos) for feats, pos in r if kept & set(feats)])
        if new and has_positive(new):
            out.setdefault(new, set()).update(ids)
    return out


class Scores:
    """Measures of rules, each counted once; what is asked for together takes one pass over the shards."""

    def __init__(self, shards: Shards, beta: float) -> None:
        self.shards, self.beta, self.known = shards, beta, {}
        self.positives = int(shards.total(lambda part: [((0,), np.array([part.y.sum()]))])[0,][0])

    def ask(self, rules: Iterable[Rule]) -> None:
        new = sorted(set(rules) - self.known.keys())
        for at in range(0, len(new), 5000):
            some = new[at : at + 5000]

            def counted(part: Part, some: list[Rule] = some) -> list[tuple[tuple, np.ndarray]]:
                hits = (part.sets.cover(r) for r in some)
                return [((0,), np.array([[len(h), h.common(part.positives)] for h in hits], np.int64))]

            for r, (n, tp) in zip(some, self.shards.total(counted)[0,].tolist()):
                p, rec = ratio_of(tp, n), ratio_of(tp, self.positives)
                self.known[r] = {"tp": tp, "returned": n, "precision": p, "recall": rec, "f": f_beta_of(p, rec, self.beta)}

    def of(self, r: Rule) -> dict:
        self.ask([r])
        return self.known[r]


def variations(r: Rule) -> list[tuple[str, bool, Rule]]:
    """(kind, in a negative literal, rule) without one term of a larger literal, then without one literal; none all-negative."""
    out = []
    for feats, pos in r:
        if len(feats) > 1:
            out += [("or", not pos, rule([x for x in r if x != (feats, pos)] + [([g for g in feats if g != f], pos)])) for f in feats]
    if len(r) > 1:
        out += [("and", not pos, rule([x for x in r if x != (feats, pos)])) for feats, pos in r]
    return [v for v in out if has_positive(v[2])]


def choose(options: list[dict], limits: dict = PRUNING) -> tuple[int | None, bool]:
    """The accepted option that replaces its parent, has the best F and comes first, in this order; and whether it replaces."""
    rated = []
    for place, o in enumerate(options):
        bound = limits[o["kind"], o["negated"]]
        if o[bound.measure] >= min(bound.accept, bound.replace):
            rated.append((o[bound.measure] >= bound.replace, o["f"], -place))
    if not rated:
        return None, False
    replaces, _, place = max(rated)
    return -place, replaces


def prune_all(rules: Iterable[Rule], scores: Scores, limits: dict = PRUNING) -> dict[Rule, list[Rule]]:
    """For each rule those on the way to its shortest acceptable form; those that a step replaces are left out.

    All rules go a step at a time together; ways that meet go on as one. Empty if nothing relevant is covered.
    """
    rules = list(rules)
    scores.ask(rules)
    steps: dict[Rule, tuple[Rule, bool] | None] = {}  # where a rule goes, and whether that takes its place
    now = {r for r in rules if scores.of(r)["tp"]}
    while now:
        scores.ask(v for r in now for _, _, v in variations(r))
        ahead = set()
        for r in now:
            own, options = scores.of(r), []
            for kind, negated, v in variations(r):
                new = scores.of(v)
                options.append(new | {"kind": kind, "negated": negated, "rule": v, "tp_gain": new["tp"] / own["tp"] - 1, "precision_gain": new["precision"] / own["precision"] - 1})
            best, replaces = choose(options, limits)
            steps[r] = None if best is None else (options[best]["rule"], replaces)
            if best is not None and options[best]["tp"]:
                ahead.add(options[best]["rule"])
        now = ahead - steps.keys()
    out = {}
    for r in rules:
        history = [r] if scores.of(r)["tp"] else []
        at = r
        while history and (step := steps.get(at)) is not None:
            at, replaces = step
            if replaces:
                history.pop()
            history.append(at)
        out[r] = history
    return out


def prune(r: Rule, scores: Scores, limits: dict = PRUNING) -> list[Rule]:
    """``prune_all`` of one rule."""
    return prune_all([r], scores, limits)[r]


@dataclass
class Pool:
    """The rules to select from, their costs, and a start for each tree."""

    rules: list[Rule]
    costs: np.ndarray
    starts: list[list[int]]


def pool(rules: dict[Rule, set[int]], scores: Scores, min_precision: float = 0.01) -> Pool:
    """All rules of all prunings that are precise enough; a tree's start is what its rules came to first."""
    found: dict[Rule, int] = {}
    starts: dict[int, list[int]] = {}
    pruned = prune_all(sorted(rules), scores)
    for r, trees in sorted(rules.items()):
        kept = [h for h in pruned[r] if scores.of(h)["precision"] >= min_precision]
        for h in kept:
            found.setdefault(h, len(found))
        for k in trees if kept else ():
            own = starts.setdefault(k, [])
            if found[kept[0]] not in own:
                own.append(found[kept[0]])
    return Pool(list(found), np.array([rule_cost(r) for r in found]), [starts[k] for k in sorted(starts)])


def objective(tp: np.ndarray, fp: np.ndarray, positives: int, cost: np.ndarray, beta: float, factor: float) -> np.ndarray:
    """F of the union less its cost."""
    tp, fp = np.asarray(tp, float), np.asarray(fp, float)
    b2 = beta * beta
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(tp + fp > 0, tp / (tp + fp), 0.0)
        r = tp / positives if positives else np.zeros_like(tp)
        f = np.where(b2 * p + r > 0, (1 + b2) * p * r / (b2 * p + r), 0.0)
    return f - factor * np.asarray(cost, float)


def move_sums(part: Part, rules: list[Rule], chosen: list[list[int]]) -> Iterator[tuple[tuple, np.ndarray]]:
    """What all adds, removals and swaps of one rule would change in each set, of class 1 and of class 0."""
    hits = [part.sets.cover(r) for r in rules]
    for at, sums in enumerate(bitmaps.move_sums(hits, (part.positives, part.all - part.positives), chosen)):
        yield (at,), sums


def select_local(shards: Shards, pool_: Pool, beta: float = 2.0, factor: float = 0.002, starts: Iterable[Iterable[int]] | None = None, max_rules: int = 10, max_rounds: int = 100) -> tuple[list[int], float]:
    """The best set that adding, removing and swapping one rule at a time comes to from any start, and its objective.

    All starts go together; a round rates all moves of all of them in one pass over the shards. A set that was met before
    goes on as it did then. Ties go to the first start and move: adds, removals, swaps, each by number.
    """
    rules, n = pool_.rules, len(pool_.rules)
    positives = int(shards.total(lambda part: [((0,), np.array([part.y.sum()]))])[0,][0])
    ahead: dict[tuple[int, ...], tuple[int, ...] | None] = {}  # where a set goes
    rated: dict[tuple[int, ...], float] = {}
    begun = [tuple(sorted(set(s))) for s in (starts if starts is not None else (pool_.starts or [[]]))]
    now = sorted(set(begun))
    for _ in range(max_rounds + 1):
        if not now:
            break
        asked = [list(s) for s in now]
        sums = shards.total(lambda part: move_sums(part, rules, asked))
        new = set()
        for at, inside in enumerate(now):
            best, rated[inside] = _best_move(sums[at,].astype(float), inside, pool_.costs, positives, beta, factor, max_rules, n)
            ahead[inside] = best
            if best is not None:
                new.add(best)
        now = sorted(new - rated.keys())
    best, best_score = [], float("-inf")
    for start in begun:
        at: tuple[int, ...] | None = start
        while at is not None and at in rated:
            if rated[at] > best_score:
                best, best_score = list(at), rated[at]
            at = ahead[at]
    return best, best_score


def _best_move(sums: np.ndarray, inside: tuple[int, ...], costs: np.ndarray, positives: int, beta: float, factor: float, max_rules: int, n: int) -> tuple[tuple[int, ...] | None, float]:
    """The set after the best move, if it is better, and the set's own objective."""
    (tp, fp), gain = sums[0, :, n], sums[0, :, :n]
    cost = float(costs[list(inside)].sum())
    score = float(objective(tp, fp, positives, cost, beta, factor))
    outside = np.array([r for r in range(n) if r not in inside], np.int64)
    moves: list[tuple[np.ndarray, list[tuple[int | None, int | None]]]] = []
    if len(inside) < max_rules and len(outside):
        moves.append((objective(tp + gain[0, outside], fp + gain[1, outside], positives, cost + costs[outside], beta, factor), [(int(a), None) for a in outside]))
    lost = sums[1:, :, n]
    if len(inside) > 1:
        moves.append((objective(tp - lost[:, 0], fp - lost[:, 1], positives, cost - costs[list(inside)], beta, factor), [(None, b) for b in inside]))
    for k, b in enumerate(inside) if len(outside) else ():
        kept = sums[1 + k, :, :n][:, outside]
        new_tp, new_fp = tp + gain[0, outside] - lost[k, 0] + kept[0], fp + gain[1, outside] - lost[k, 1] + kept[1]
        moves.append((objective(new_tp, new_fp, positives, cost + costs[outside] - costs[b], beta, factor), [(int(a), b) for a in outside]))
    if not moves:
        return None, score
    values = np.concatenate([m[0] for m in moves])
    at = int(np.argmax(values))
    if not values[at] > score + 1e-12:
        return None, score
    add, drop = [m for _, names in moves for m in names][at]
    return tuple(sorted((set(inside) - {drop}) | ({add} - {None}))), score


#: The share of bits that a generation flips.
FLIP_RATE = 0.05  # fixed value


def select_genetic(shards: Shards, pool_: Pool, beta: float = 2.0, factor: float = 0.002, max_rules: int = 10, size: int = 100, rounds: int = 50, seed: int = 1) -> tuple[list[int], float]:
    """Selection by a genetic algorithm: uniform crossover, bit flips, tournaments of three; the best set ever met.

    A generation is rated in one pass over the shards.
    """
    rng = np.random.default_rng(seed)
    rules, n = pool_.rules, len(pool_.rules)
    if not n:
        return [], float("-inf")
    positives = int(shards.total(lambda part: [((0,), np.array([part.y.sum()]))])[0,][0])
    people = rng.random((size, n)) < min(0.5, max_rules / (2 * n))
    for i, s in enumerate(pool_.starts[: size // 2]):
        people[i] = False
        people[i, s] = True

    def rate(p: np.ndarray) -> np.ndarray:
        def counted(part: Part) -> list[tuple[tuple, np.ndarray]]:
            hits = [part.sets.cover(r) for r in rules]
            found = [union(hits[i] for i in np.flatnonzero(own)) for own in p]
            tp = np.array([f.common(part.positives) for f in found], np.int64)
            return [((0,), np.stack([tp, np.array([len(f) for f in found], np.int64) - tp]))]

        tp, fp = shards.total(counted)[0,]
        k = p.sum(axis=1)
        return np.where((k == 0) | (k > max_rules), -np.inf, objective(tp, fp, positives, p @ pool_.costs, beta, factor))

    score = rate(people)
    best, best_score = people[int(np.argmax(score))].copy(), float(score.max())
    for _ in range(rounds):
        picks = rng.integers(0, size, (2, size, 3))
        parents = [people[p[np.arange(size), np.argmax(score[p], axis=1)]] for p in picks]
        people = np.where(rng.random((size, n)) < 0.5, *parents) ^ (rng.random((size, n)) < FLIP_RATE)
        score = rate(people)
        if score.max() > best_score:
            best, best_score = people[int(np.argmax(score))].copy(), float(score.max())
    return np.flatnonzero(best).tolist(), best_score
