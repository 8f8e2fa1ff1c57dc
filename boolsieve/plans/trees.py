"""OR-decision trees and forests over binary postings.

A node asks whether a document has any of a set of terms. All nodes of a level of all trees grow side by side; each step
is a sum over the shards of the rows, and what reaches the driver is a bounded number of candidates for each node.
``grow_levels`` grows one tree by SQL alone.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boolsieve.functions.rules import Rule, has_positive, rule
from boolsieve.functions.safe import f_beta_of, ratio_of
from boolsieve.operators import splits
from boolsieve.plans.shards import Matrix, Part, Shards
from boolsieve.session import cut

# fixed values: the defaults
@dataclass(frozen=True)
class Params:
    """How trees grow. The impurity drop that an added OR term needs goes from ``min_drop_start`` at the root to ``min_drop_end``."""

    max_depth: int = 4
    min_rows: int = 3
    min_share: float = 0.0002
    min_drop_start: float = 0.001
    min_drop_end: float = 0.001
    max_features: float | int | str | None = None
    feature_exponent: float | None = None
    top_candidates: int = 500
    max_or: int = 10
    prefer_positive: float | None = 1.1
    class_weight: float | str | None = 0.2

    def drop_at(self, n: int, n_root: int) -> float:
        return self.min_drop_start + (self.min_drop_end - self.min_drop_start) * (1 - n / n_root)


@dataclass
class Node:
    """A leaf has no features."""

    n0: int
    n1: int
    p1: float
    features: list[int] = field(default_factory=list)
    left: Node | None = None
    right: Node | None = None


def impurity(w_l: np.ndarray, w1_l: np.ndarray, w: float, w1: float) -> np.ndarray:
    """Mean impurity of both sides by weight; 1 where a side has none."""
    w_r, w1_r = w - w_l, w1 - w1_l
    with np.errstate(divide="ignore", invalid="ignore"):
        left, right = w1_l / w_l, w1_r / w_r
        out = (w_l * 2 * left * (1 - left) + w_r * 2 * right * (1 - right)) / w
    return np.where((w_l > 0) & (w_r > 0), out, 1.0)


def _valid(n_l: np.ndarray, w_l: np.ndarray, n: int, w: float, root: float, p: Params) -> np.ndarray:
    sides = (n_l >= p.min_rows) & (n - n_l >= p.min_rows) & (w_l > 0) & (w - w_l > 0)
    return sides & (w_l / root >= p.min_share) & ((w - w_l) / root >= p.min_share)


def subset_size(n: int, wanted: float | int | str | None, exponent: float | None, rng: np.random.Generator) -> int:
    """How many features a node looks at; with an exponent a random number from there to all, drawn towards fewer."""
    if wanted is None:
        size = n
    elif wanted in ("sqrt", "log2"):
        size = int(math.sqrt(n) if wanted == "sqrt" else math.log2(n)) if n else 0
    elif isinstance(wanted, float):
        size = int(wanted * n)
    elif isinstance(wanted, int):
        size = wanted
    else:
        raise ValueError(f"max_features can't be {wanted!r}")
    size = max(1, min(size, n))
    return int(biased_random(size, n, exponent, rng)) if exponent else size


def biased_random(low: float, high: float, exponent: float, rng: np.random.Generator) -> float:
    return low + (high - low) * rng.random() ** exponent


def biased_column(low: float, high: float, exponent: float, u: F.Column) -> F.Column:
    """``biased_random`` of an even number between 0 and 1 of each row."""
    return F.lit(float(low)) + F.lit(float(high - low)) * F.pow(u, F.lit(float(exponent)))


@dataclass(frozen=True)
class Plan:
    """What a tree learns: its number, how it grows, the mean of its rows' Poisson weights (None: each row once), and its target."""

    tree_id: int
    params: Params
    seed: int = 0
    mean: float | None = None
    target: int | None = None


def row_weights(part: Part, plan: Plan) -> np.ndarray:
    """The rows' weights in a tree: times a Poisson number made of seed, tree and row, which is what drawing rows comes to."""
    if plan.mean is None:
        return part.w
    with np.errstate(over="ignore"):
        h = part.key.astype(np.uint64) ^ (np.uint64(plan.seed) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(plan.tree_id) * np.uint64(0xD1B54A32D192ED03))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    terms = [math.exp(-plan.mean)]
    while len(terms) < plan.mean + 12 * math.sqrt(plan.mean) + 20:
        terms.append(terms[-1] * plan.mean / len(terms))
    return part.w * np.searchsorted(np.cumsum(terms), u, side="right")


def place(part: Part, w: np.ndarray, features: dict[int, list[int]]) -> np.ndarray:
    """The node of every row with weight, -1 for others. The children of node k are 2k + 1, which has a term, and 2k + 2."""
    at = np.where(w > 0, 0, -1)
    for k in sorted(features):
        hit = part.x.any_of(features[k])
        at[(at == k) & hit] = 2 * k + 1
        at[(at == k) & ~hit] = 2 * k + 2
    return at


def _four(x: Matrix, here: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows, rows of class 1, weight and weight of class 1 of every column, of the rows that are ``here``."""
    on = here[x.rows]
    place, row = x.place[on], x.rows[on]
    used = np.flatnonzero(np.bincount(place, minlength=len(x.ids)))
    sums = [np.bincount(place, v, len(x.ids))[used] for v in (None, y[row], w[row], (w * y)[row])]
    return np.stack([x.ids[used], *[np.rint(s).astype(np.int64) for s in sums]])


@dataclass
class _Open:
    """A node that may split: its totals (rows, rows of class 1, weight, weight of class 1), and the terms above it."""

    plan: Plan
    at: int
    totals: np.ndarray
    above: frozenset[int]
    valid: int
    chosen: list[int] = field(default_factory=list)
    covered: np.ndarray | None = None
    best: float = 1.0
    candidates: np.ndarray | None = None


def _rate(four: np.ndarray, o: _Open, root: float) -> tuple[np.ndarray, np.ndarray]:
    """The impurity of splits that take these sums to the left, and which are valid."""
    n, _, w, w1 = (float(t) for t in o.totals)
    return impurity(four[2].astype(float), four[3].astype(float), w, w1), _valid(four[0], four[2], int(n), w, root, o.plan.params)


def _looked_at(o: _Open, terms: np.ndarray) -> np.ndarray:
    """Which terms a node looks at: each by a hash of seed, tree, node and term, as many of the valid ones as wanted on average."""
    p = o.plan.params
    if p.max_features is None and not p.feature_exponent:
        return np.ones(len(terms), bool)
    rng = np.random.default_rng([o.plan.seed, o.plan.tree_id, o.at])
    share = subset_size(o.valid, p.max_features, p.feature_exponent, rng) / max(1, o.valid)
    with np.errstate(over="ignore"):
        h = (terms.astype(np.uint64) + np.uint64(rng.integers(1 << 62))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(11)) / float(1 << 53) < share


def _candidates(four: np.ndarray, o: _Open, root: float) -> dict[str, Any]:
    """Of a block of terms: the best split that the node looks at, the ``top_candidates`` of the highest gain, and how many are valid."""
    p, terms = o.plan.params, four[0]
    score, ok = _rate(four[1:], o, root)
    ok &= ~np.isin(terms, list(o.above))
    _, _, w, w1 = (float(t) for t in o.totals)
    share = ratio_of(w1, w)
    gain = 2 * share * (1 - share) - score
    if p.prefer_positive:
        w_l, w1_l = four[3].astype(float), four[4].astype(float)
        gain = np.where(w1_l * (w - w_l) > (w1 - w1_l) * w_l, gain * p.prefer_positive, gain)
    gain = np.where(ok, gain, -np.inf)
    allowed = np.where(_looked_at(o, terms), gain, -np.inf)
    best = None
    if len(terms) and allowed.max() > 0:
        k = int(np.argmax(allowed))
        best = (-float(allowed[k]), int(terms[k]), float(score[k]), four[1:, k])
    top = np.argsort(-gain, kind="stable")[: p.top_candidates]
    top = top[ok[top]]
    return {"best": best, "top": [(-float(gain[k]), int(terms[k])) for k in top], "valid": int(ok.sum())}


def grow_forest(shards: Shards, plans: list[Plan]) -> dict[int, Node]:
    """The trees of all plans, by number; those whose root can't be split are left out. Ties go to the term of the lower number.

    A level takes one pass over the shards for the first term of every node, and one for each further term of its OR-set.
    """
    by_id = {p.tree_id: p for p in plans}

    def roots(part: Part) -> Iterator[tuple[tuple, np.ndarray]]:
        for p in plans:
            w, y = row_weights(part, p), part.labels(p.target)
            yield (p.tree_id,), np.array([(w > 0).sum(), y[w > 0].sum(), w.sum(), (w * y).sum()], np.int64)

    tops = {k: v for (k,), v in shards.total(roots).items()}
    features: dict[int, dict[int, list[int]]] = {k: {} for k in by_id}
    nodes: dict[int, dict[int, np.ndarray]] = {k: {0: v} for k, v in tops.items()}
    live = [_Open(by_id[k], 0, v, frozenset(), shards.n_terms) for k, v in sorted(tops.items()) if 0 < v[1] < v[0]]
    depth = 0
    while live:
        still = [o for o in live if _may_split(o, depth, float(tops[o.plan.tree_id][2]))]
        open_ = {(o.plan.tree_id, o.at): o for o in still}
        trees = {o.plan.tree_id: (o.plan, dict(features[o.plan.tree_id]), [x for x in still if x.plan.tree_id == o.plan.tree_id]) for o in still}
        root = {k: float(tops[k][2]) for k in trees}
        block = shards.block

        def first(part: Part) -> Iterator[tuple[tuple, np.ndarray]]:
            for k, (plan, known, own) in trees.items():
                w, y = row_weights(part, plan), part.labels(plan.target)
                at = place(part, w, known)
                for o in own:
                    four = _four(part.x, at == o.at, y, w)
                    cuts = np.flatnonzero(np.diff(four[0] // block)) + 1
                    for some in np.split(four, cuts, axis=1):
                        if some.shape[1]:
                            yield (k, o.at, int(some[0, 0]) // block), some

        def rated(key: tuple, four: np.ndarray) -> dict[str, Any]:
            return _candidates(four, open_[key[:2]], root[key[0]])

        found: dict[tuple[int, int], list[dict]] = {}
        for key, value in sorted(shards.total(first, rated, sparse=True).items()) if still else ():
            found.setdefault(key[:2], []).append(value)
        growing = []
        for key, blocks in found.items():
            o = open_[key]
            best = min((b["best"] for b in blocks if b["best"]), key=lambda b: b[:2], default=None)
            share = ratio_of(float(o.totals[3]), float(o.totals[2]))
            if best is None or best[2] >= 2 * share * (1 - share):
                continue
            top = sorted(t for b in blocks for t in b["top"])[: o.plan.params.top_candidates]
            o.chosen, o.best, o.covered, o.valid = [best[1]], best[2], best[3], sum(b["valid"] for b in blocks)
            o.candidates = np.array([t for _, t in top if t != best[1]], np.int64)
            growing.append(o)
        split = list(growing)
        while growing := [o for o in growing if len(o.candidates) and len(o.chosen) < o.plan.params.max_or]:
            growing = _expand(shards, growing, trees, tops)
        live = []
        for o in split:
            k = o.plan.tree_id
            features[k][o.at] = o.chosen
            for child, totals in ((2 * o.at + 1, o.covered), (2 * o.at + 2, o.totals - o.covered)):
                nodes[k][child] = totals
                live.append(_Open(o.plan, child, totals, o.above | set(o.chosen), o.valid))
        depth += 1

    def built(k: int, at: int) -> Node:
        n, n1, w, w1 = nodes[k][at].tolist()
        node = Node(n - n1, n1, ratio_of(float(w1), float(w)))
        if at in features[k]:
            node.features, node.left, node.right = features[k][at], built(k, 2 * at + 1), built(k, 2 * at + 2)
        return node

    return {k: built(k, 0) for k in sorted(features) if features[k]}


def _may_split(o: _Open, depth: int, root: float) -> bool:
    p, (n, n1, w, _) = o.plan.params, o.totals
    return depth < p.max_depth and n >= p.min_rows and w / root >= p.min_share and 0 < n1 < n and o.valid > 0


def _expand(shards: Shards, growing: list[_Open], trees: dict, tops: dict[int, np.ndarray]) -> list[_Open]:
    """Adds to each node the candidate of the largest drop if it is large enough; the nodes that got one.

    The totals of a union are those of what is covered and of what a candidate adds to it, so a step sums each candidate's
    uncovered rows once.
    """
    by_tree: dict[int, list[tuple[int, list[int], np.ndarray]]] = {}
    for o in growing:
        by_tree.setdefault(o.plan.tree_id, []).append((o.at, o.chosen, o.candidates))
    known = {k: trees[k][:2] for k in by_tree}

    def uncovered(part: Part) -> Iterator[tuple[tuple, np.ndarray]]:
        for k, own in by_tree.items():
            plan, features = known[k]
            w, y = row_weights(part, plan), part.labels(plan.target)
            at = place(part, w, features)
            for node, chosen, candidates in own:
                rest = (at == node) & ~part.x.any_of(chosen)
                sub = part.x.only(candidates)
                yield (k, node), np.stack([np.rint(sub.sums(np.where(rest, v, 0))).astype(np.int64) for v in (np.ones(len(w), np.int64), y, w, w * y)])

    sums = shards.total(uncovered)
    out = []
    for o in growing:
        root = tops[o.plan.tree_id]
        union = sums[o.plan.tree_id, o.at] + o.covered[:, None]
        score, ok = _rate(union, o, float(root[2]))
        drop = np.where(ok, o.best - score, -1.0)
        k = int(np.argmax(drop))
        if drop[k] > 0 and drop[k] >= o.plan.params.drop_at(int(o.totals[0]), int(root[0])):
            o.chosen.append(int(o.candidates[k]))
            o.best -= float(drop[k])
            o.covered = union[:, k]
            o.candidates = np.delete(o.candidates, k)
            out.append(o)
    return out


def grow(x: Matrix, y: np.ndarray, w: np.ndarray, p: Params = Params()) -> Node | None:
    """One tree on a matrix, labels ``y`` and weights ``w``; None if the root can't be split."""
    return grow_forest(Shards.of(x, y, w), [Plan(0, p)]).get(0)


def walk(node: Node) -> Iterator[Node]:
    yield node
    if node.features:
        yield from walk(node.left)
        yield from walk(node.right)


def predict(node: Node, x: Matrix) -> np.ndarray:
    """The share of the leaf of every row; 0 for rows that have none of the terms on their way."""
    out = np.zeros(x.n_rows)

    def go(n: Node, here: np.ndarray, turned: bool) -> None:
        if not n.features:
            out[here] = n.p1 if turned else 0.0
            return
        hit = x.any_of(n.features)
        go(n.left, here & hit, True)
        go(n.right, here & ~hit, turned)

    go(node, np.ones(x.n_rows, bool), False)
    return out


def metric(name: str) -> Callable[[int, int, int], float]:
    """precision, recall or f<beta> as a function of true positives, retrieved and positives."""
    if name == "precision":
        return lambda tp, n, pos: ratio_of(tp, n)
    if name == "recall":
        return lambda tp, n, pos: ratio_of(tp, pos)
    if name.startswith("f"):
        beta = float(name[1:])
        return lambda tp, n, pos: f_beta_of(ratio_of(tp, n), ratio_of(tp, pos), beta)
    raise ValueError(f"there is no measure {name!r}")


def leaf_counts(shards: Shards, trees: dict[int, Node], targets: dict[int, int] | None = None) -> dict[int, list[tuple[float, int, int]]]:
    """For each tree (share, rows, rows of class 1) of its leaves, over all rows; rows without any term on their way have share 0."""
    flat: dict[int, tuple[dict[int, list[int]], dict[int, float]]] = {}
    for k, tree in trees.items():
        features, shares = {}, {}

        def go(n: Node, at: int, turned: bool) -> None:
            if n.features:
                features[at] = n.features
                go(n.left, 2 * at + 1, True)
                go(n.right, 2 * at + 2, turned)
            else:
                shares[at] = n.p1 if turned else 0.0

        go(tree, 0, False)
        flat[k] = features, shares

    def counted(part: Part) -> Iterator[tuple[tuple, np.ndarray]]:
        for k, (features, shares) in flat.items():
            at, y = place(part, np.ones(len(part.y)), features), part.labels(targets[k] if targets else None)
            yield (k,), np.array([[(at == leaf).sum(), y[at == leaf].sum()] for leaf in shares], np.int64)

    return {k: [(s, int(n), int(n1)) for s, (n, n1) in zip(flat[k][1].values(), v)] for (k,), v in shards.total(counted).items()}


def threshold_of(
    leaves: list[tuple[float, int, int]], goal: str = "f1", constraint: tuple[str, float] | None = None, retrieved: Callable[[float], int] | None = None
) -> tuple[float | None, float]:
    """The leaf share from which on a leaf counts as positive so that the goal is best, lowest first; and the goal's value.

    With a constraint (measure, least value) only thresholds that keep it count; if none does, the one that is closest.
    Shares are those of all leaves of the tree; 0 is none. ``retrieved`` gives how many documents a threshold's query finds
    in another collection, such as a search service; precision is then over that number, or the rows here if they are more.
    """
    positives = sum(n1 for _, _, n1 in leaves)
    rows = []
    for t in sorted({s for s, _, _ in leaves} - {0.0}):
        hit = [(n, n1) for s, n, n1 in leaves if s >= t - 1e-8]
        rows_here = sum(n for n, _ in hit)
        got = sum(n1 for _, n1 in hit), max(rows_here, retrieved(t)) if retrieved else rows_here, positives
        rows.append((t, metric(goal)(*got), metric(constraint[0])(*got) if constraint else 0.0))
    if not rows:
        return None, float("-inf")
    if constraint:
        kept = [r for r in rows if r[2] >= constraint[1]]
        if not kept:
            best = max(rows, key=lambda r: (r[2], -r[0]))
            return best[0], best[1]
        rows = kept
    best = max(rows, key=lambda r: (r[1], -r[0]))
    return best[0], best[1]


def best_threshold(node: Node, x: Matrix, y: np.ndarray, goal: str = "f1", constraint: tuple[str, float] | None = None) -> tuple[float | None, float]:
    """``threshold_of`` the leaves of a tree on a matrix."""
    return threshold_of(leaf_counts(Shards.of(x, y), {0: node})[0], goal, constraint)


def paths(node: Node, threshold: float) -> set[Rule]:
    """The rules of the positive leaves. Subtrees of one class are one leaf; rules without a positive literal are left out."""

    def kind(n: Node) -> bool | None:
        if not n.features:
            return n.p1 >= threshold - 1e-8
        a, b = kind(n.left), kind(n.right)
        return a if a == b else None

    out: set[Rule] = set()

    def go(n: Node, so_far: tuple) -> None:
        same = kind(n)
        if same is not None:
            if same:
                out.add(rule(so_far))
            return
        go(n.left, (*so_far, (n.features, True)))
        go(n.right, (*so_far, (n.features, False)))

    go(node, ())
    return {r for r in out if has_positive(r)}


NODE_SCHEMA = "tree_id long, node_id int, depth int, n0 long, n1 long, p1 double, features array<int>, left int, right int"


def to_rows(node: Node, tree_id: int = 0) -> list[tuple]:
    """The tree as rows of a flat table, the root first."""
    rows: list[list[Any]] = []

    def go(n: Node, depth: int) -> int:
        at = len(rows)
        rows.append([tree_id, at, depth, n.n0, n.n1, n.p1, list(n.features), None, None])
        if n.features:
            rows[at][7], rows[at][8] = go(n.left, depth + 1), go(n.right, depth + 1)
        return at

    go(node, 0)
    return [tuple(r) for r in rows]


def from_rows(rows: list[tuple]) -> Node:
    by_id = {r[1]: r for r in rows}

    def go(at: int) -> Node:
        r = by_id[at]
        features = [int(f) for f in r[6]]
        return Node(int(r[3]), int(r[4]), float(r[5]), features, go(int(r[7])) if features else None, go(int(r[8])) if features else None)

    return go(0)


def to_json(node: Node) -> str:
    return json.dumps(to_rows(node))


def from_json(text: str) -> Node:
    return from_rows(json.loads(text))


def describe(node: Node, names: list[str], depth: int = 0) -> str:
    """The tree as indented text."""
    pad = "  " * depth
    if not node.features:
        return f"{pad}leaf p={node.p1:.4f} ({node.n1} of {node.n0 + node.n1})\n"
    head = f"{pad}any of {', '.join(names[f] for f in node.features)} ({node.n1} of {node.n0 + node.n1})\n"
    return head + describe(node.left, names, depth + 1) + f"{pad}none\n" + describe(node.right, names, depth + 1)


# fixed values: the defaults
@dataclass(frozen=True)
class Forest:
    """How many trees and how each differs. Tree 0 has all rows and all features.

    With ``drop_exponent`` the other trees draw the drops that they ask of OR terms between the set ones and 1.
    """

    n_trees: int = 20
    bootstrap: bool = True
    max_samples: int | float | None = None
    drop_exponent: float | None = 0.9
    seed: int = 1


def bootstrap_size(n: int, wanted: int | float | None) -> int:
    if wanted is None:
        return n
    return wanted if isinstance(wanted, int) else max(round(n * wanted), 1)


def forest_plans(p: Params, f: Forest, n_rows: int) -> list[Plan]:
    """What each tree of a forest learns: tree 0 from all rows and features, the others from drawn ones, by their own seed."""
    out = [Plan(0, Params(**{**asdict(p), "max_features": None, "feature_exponent": None}))]
    for k in range(1, f.n_trees):
        own = p
        if f.drop_exponent:
            rng = np.random.default_rng([f.seed, k])
            start, end = (biased_random(x, 1.0, f.drop_exponent, rng) for x in (p.min_drop_start, p.min_drop_end))
            own = Params(**{**asdict(p), "min_drop_start": start, "min_drop_end": end})
        out.append(Plan(k, own, f.seed, bootstrap_size(n_rows, f.max_samples) / max(1, n_rows) if f.bootstrap else None))
    return out[: f.n_trees]


def fit_forest(shards: Shards, p: Params = Params(), f: Forest = Forest()) -> dict[int, Node]:
    """The trees of a forest that could be split, by number."""
    n = shards.total(lambda part: [((0,), np.array([len(part.y)]))]) if f.bootstrap else {}
    return grow_forest(shards, forest_plans(p, f, int(n[0,][0]) if n else 0))


def node_table(spark: SparkSession, trees: dict[int, Node]) -> DataFrame:
    """The node tables of trees as one."""
    return spark.createDataFrame([r for k, t in sorted(trees.items()) for r in to_rows(t, k)], NODE_SCHEMA)


def tree_column(node: Node, terms: F.Column, names: list[str]) -> F.Column:
    """``predict`` as a column over an array of terms."""

    def go(n: Node, turned: bool) -> F.Column:
        if not n.features:
            return F.lit(n.p1 if turned else 0.0)
        hit = F.arrays_overlap(terms, F.array(*[F.lit(names[f]) for f in n.features]))
        return F.when(hit, go(n.left, True)).otherwise(go(n.right, turned))

    return go(node, False)


def grow_levels(post: DataFrame, docs: DataFrame, p: Params = Params()) -> list[dict]:
    """A tree on (doc_id, term) postings and (doc_id, y, w) documents of any size, level by level; rows of its node table.

    Each level rates all terms of all open nodes in one aggregation, and each further OR term of all nodes in another.
    What reaches the driver is a row for each node. It takes the same terms as ``grow`` on the same whole-number weights.
    """
    state = cut(docs.filter("w > 0").select("doc_id", F.lit(0).alias("node"), "y", "w"))
    top = splits.node_totals(state).first()
    if top is None or not 0 < state.agg(F.sum("y")).first()[0] < top["n"]:
        return []
    root, n_root = float(top["w"]), top["n"]
    spark = docs.sparkSession
    out: dict[int, dict] = {}
    used = spark.createDataFrame([], "node int, term string")
    for depth in range(p.max_depth + 1):
        totals = {r["node"]: r for r in state.groupBy("node").agg(F.count("*").alias("n"), F.sum("y").alias("n1"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("w1")).collect()}
        for k, r in totals.items():
            out[k] = {"node": k, "depth": depth, "n0": r["n"] - r["n1"], "n1": r["n1"], "p1": ratio_of(float(r["w1"]), float(r["w"])), "features": [], "n": r["n"]}
        live = [k for k, r in totals.items() if depth < p.max_depth and r["n"] >= p.min_rows and r["w"] / root >= p.min_share and 0 < r["n1"] < r["n"]]
        if not live:
            break
        state = state.filter(F.col("node").isin(live))
        nodes = splits.node_totals(state)
        allowed = splits.term_totals(post, state).join(used, ["node", "term"], "left_anti")
        rated = cut(splits.rated(allowed, nodes, root, p.min_rows, p.min_share, p.prefer_positive))
        best = {r["node"]: r for r in splits.best_split(rated).collect()}
        chosen = {k: [r["term"]] for k, r in best.items() if r["gain"] > 0 and r["impurity"] < 2 * out[k]["p1"] * (1 - out[k]["p1"])}
        if not chosen:
            break
        wanted = cut(splits.best_terms(rated.filter(F.col("node").isin(list(chosen))), p.top_candidates).select("node", "term"))
        growing = list(chosen)
        while growing:
            now = spark.createDataFrame([(k, t) for k in growing for t in chosen[k]], "node int, term string")
            left = wanted.filter(F.col("node").isin(growing)).join(now, ["node", "term"], "left_anti")
            rows = splits.or_candidates(post, state.filter(F.col("node").isin(growing)), now, left, root, p.min_rows, p.min_share)
            found = {r["node"]: r["b"] for r in rows.groupBy("node").agg(F.min_by(F.struct("term", "drop"), F.struct((-F.col("drop")).alias("d"), "term")).alias("b")).collect()}
            growing = [k for k in growing if k in found and found[k]["drop"] > 0 and found[k]["drop"] >= p.drop_at(out[k]["n"], n_root)]
            for k in growing:
                chosen[k].append(found[k]["term"])
            growing = [k for k in growing if len(chosen[k]) < p.max_or]
        for k, terms in chosen.items():
            out[k] |= {"features": terms, "left": 2 * k + 1, "right": 2 * k + 2}
        table = F.broadcast(spark.createDataFrame([(k, t) for k, ts in chosen.items() for t in ts], "node int, term string"))
        hit = post.join(table, "term").join(state.select("doc_id", "node"), ["doc_id", "node"]).select("doc_id", "node").distinct().withColumn("hit", F.lit(1))
        side = F.when(F.col("hit") == 1, F.col("node") * 2 + 1).otherwise(F.col("node") * 2 + 2)
        moved = state.filter(F.col("node").isin(list(chosen))).join(hit, ["doc_id", "node"], "left")
        state = cut(moved.select("doc_id", side.cast("int").alias("node"), "y", "w"))
        gone = allowed.select("node", "term").join(rated.select("node", "term"), ["node", "term"], "left_anti").unionByName(table).unionByName(used)
        gone = gone.filter(F.col("node").isin(list(chosen)))
        used = cut(gone.select(F.explode(F.array(F.col("node") * 2 + 1, F.col("node") * 2 + 2)).alias("node"), "term").distinct())
    return [out[k] for k in sorted(out)]
