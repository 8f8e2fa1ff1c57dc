"""Places and running sums within groups of any size: a hot group is many tasks.

Rows are dealt to ranges of (group, order). Each range numbers and sums its own rows; a small table says how many rows
and how much of each sum the ranges before it have. No window ever covers a whole group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boolsieve.session import cut, small


def prefixes(rows: DataFrame, by: list[str], order: list[Column | str], place: str = "place", sums: dict[str, Column | str] | None = None) -> DataFrame:
    """``rows`` with ``place``, the number of rows of the group before it, and running sums up to and with each row.

    Rows that tie in ``order`` come in some order; null groups are groups, a null value adds nothing. The rows are written
    once, sorted, to the checkpoint folder, so that ranges and their sizes are of the same deal.
    """
    sums = sums or {}
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    ranged = cut(dealt.withColumn("_id", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_id", 33))
    added = {n: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)) for n, c in sums.items()}
    parts = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"), *[F.sum(c).alias(f"_sum_{n}") for n, c in added.items()])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over ranges, not rows
    upto = {"_n": "_before", **{f"_sum_{n}": f"_before_{n}" for n in sums}}
    starts = cut(parts.select(*by, "_range", "_first", *[F.coalesce(F.sum(a).over(before), F.lit(0)).alias(b) for a, b in upto.items()]))
    named = starts.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_range").alias("_of"), "_first", *upto.values())
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)], F.col("_range") == F.col("_of"))
    met = ranged.join(small(named), same)
    own = Window.partitionBy(*by, "_range").orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = [(F.col(f"_before_{n}") + F.sum(c).over(own)).alias(n) for n, c in added.items()]
    kept = [c for c in rows.columns if c not in (place, *sums)]
    return met.select(*kept, (F.col("_id") - F.col("_first") + F.col("_before")).alias(place), *running)
