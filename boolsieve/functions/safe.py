"""Ratios that are zero where their denominator is, and the measures made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(n: Column, d: Column) -> Column:
    """n / d, or zero where d is zero or null (ANSI division would raise)."""
    d = d.cast("double")
    return F.when(d.isNull() | (d == 0), F.lit(0.0)).otherwise(n.cast("double") / d)


def precision(tp: Column, returned: Column) -> Column:
    return ratio(tp, returned)


def recall(tp: Column, positives: Column) -> Column:
    return ratio(tp, positives)


def f_beta(p: Column, r: Column, beta: float) -> Column:
    """(1 + b2) p r / (b2 p + r); zero if both are."""
    b2 = float(beta) ** 2
    return ratio(F.lit(1.0 + b2) * p * r, F.lit(b2) * p + r)


def gini(p: Column) -> Column:
    """Impurity of a node of which a share ``p`` is positive."""
    return F.lit(2.0) * p * (F.lit(1.0) - p)


def f_beta_of(p: float, r: float, beta: float) -> float:
    """``f_beta`` of two numbers."""
    b2 = beta * beta
    low = b2 * p + r
    return (1 + b2) * p * r / low if low else 0.0


def ratio_of(n: float, d: float) -> float:
    return n / d if d else 0.0
