"""Rules: an AND of OR-sets of terms with signs. Rendering, size and cost, for Python values and for columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from boolsieve.functions.text import is_heading

#: A literal: its terms (or term numbers) in order, and whether one must be there (or none may).
Literal = tuple[tuple, bool]
#: A rule in canonical form: positive literals first, then by terms; so equal rules are equal values.
Rule = tuple[Literal, ...]

RULE_TYPE = "array<struct<feats:array<string>,pos:boolean>>"
# fixed values: what a path, an AND, a NOT and an added OR cost
COSTS = {"paths": 2.0, "ANDs": 1.0, "NOTs": 1.5, "added_ORs": 0.5}


def rule(literals: Iterable[tuple[Iterable, bool]]) -> Rule:
    """The canonical form of a set of literals."""
    clean = {(tuple(sorted(set(f))), bool(p)) for f, p in literals}
    return tuple(sorted(clean, key=lambda x: (not x[1], x[0])))


def has_positive(r: Rule) -> bool:
    return any(p for _, p in r)


def render_term(term: str, positive: bool, expansions: dict[str, list[str]] | None = None, tiab: bool = False, mh_noexp: bool = False) -> list[str]:
    """The strings that stand for a term: a heading as it is, else its expansions, quoted if they have spaces.

    With ``tiab``, and always in a negative literal, texts carry the tag of title and abstract.
    """
    if is_heading(term):
        return [term.replace("[mh]", "[mh:noexp]") if mh_noexp else term]
    forms = (expansions or {}).get(term, [term])
    return [(f'"{w}"' if " " in w else w) + ("[tiab]" if tiab or not positive else "") for w in forms]


def render(rules: Iterable[Rule], names: dict | None = None, expansions: dict[str, list[str]] | None = None, tiab: bool = False, mh_noexp: bool = False) -> tuple[str, dict]:
    """The query string of a set of rules, and its size; rules without a positive literal are left out of both."""
    kept = [r for r in rules if has_positive(r)]
    clauses, synonyms = [], 0
    for r in kept:
        parts = {True: [], False: []}
        for feats, pos in r:
            strings = [render_term(names[f] if names is not None else f, pos, expansions, tiab, mh_noexp) for f in feats]
            synonyms += sum(len(s) - 1 for s in strings)
            flat = [w for s in strings for w in s]
            parts[pos].append(f"({' OR '.join(flat)})" if len(flat) > 1 else flat[0])
        clause = " AND ".join(parts[True]) + "".join(f" NOT {p}" for p in parts[False])
        clauses.append(f"({clause})" if len(r) > 1 else clause)
    return " OR ".join(clauses), size(kept) | {"synonym_ORs": synonyms}


def size(rules: list[Rule]) -> dict:
    """Paths, mean path length, ANDs, NOTs, ORs inside literals and ORs between rules."""
    n = len(rules)
    return {
        "paths": n,
        "avg_path_len": sum(map(len, rules)) / n if n else 0,
        "ANDs": sum(sum(p for _, p in r) - 1 for r in rules),
        "NOTs": sum(sum(not p for _, p in r) for r in rules),
        "added_ORs": sum(len(f) - 1 for r in rules for f, _ in r),
        "ORs": max(0, n - 1),
    }


def cost(of: dict, weights: dict[str, float] = COSTS) -> float:
    return sum(w * of[k] for k, w in weights.items())


def rule_cost(r: Rule, weights: dict[str, float] = COSTS) -> float:
    return cost(size([r]), weights)


def size_columns(rules: Column) -> dict[str, Column]:
    """The size of an array of rules, as columns."""
    zero = F.lit(0).cast("long")
    count = lambda pos: F.aggregate(rules, zero, lambda n, r: n + F.size(F.filter(r, lambda x: x["pos"] == F.lit(pos))))
    paths = F.size(rules).cast("long")
    return {
        "paths": paths,
        "avg_path_len": F.when(paths > 0, F.aggregate(rules, zero, lambda n, r: n + F.size(r)).cast("double") / paths).otherwise(0.0),
        "ANDs": count(True) - paths,
        "NOTs": count(False),
        "added_ORs": F.aggregate(rules, zero, lambda n, r: n + F.aggregate(r, zero, lambda m, x: m + F.size(x["feats"]) - 1)),
        "ORs": F.greatest(paths - 1, zero),
    }


def cost_column(of: dict[str, Column], weights: dict[str, float] = COSTS) -> Column:
    total = F.lit(0.0)
    for k, w in weights.items():
        total = total + F.lit(w) * of[k]
    return total


def mean_literal_length(rules: Column) -> Column:
    """The mean number of terms in the literals of an array of rules; 0 if there are none."""
    sizes = F.flatten(F.transform(rules, lambda r: F.transform(r, lambda x: F.size(x["feats"]))))
    total = F.aggregate(sizes, F.lit(0.0), lambda s, n: s + n)
    return F.when(F.size(sizes) > 0, total / F.size(sizes)).otherwise(0.0)
