"""Exact quantiles of groups of any size, linear between two neighbours.

The values that stand at the wanted places are searched for by histograms: each pass counts the values of the intervals
that still hold a wanted place in BINS bins, and goes on with the bins that do, until few enough values are left to be
looked at. What a task holds is bins and short lists, whatever the groups' sizes are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boolsieve.session import cut, small

#: Bins of an interval, and how many values are looked at one by one.
BINS, LISTED = 1024, 1000


def _scale(v: Column) -> Column:
    """A number between -2100 and 2100 that rises with the value, by its powers of two."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log2(F.abs(v)) + 1075))


def _bin(v: Column, lo: Column, hi: Column) -> Column:
    """The bin of a value between two ends that differ: equal steps between ends within a factor of four, else steps by powers of two.

    So two passes bring the ends that close, however far apart they are, and six more are as exact as a number is.
    """
    close = (F.signum(lo) == F.signum(hi)) & (F.greatest(F.abs(lo), F.abs(hi)) <= 4 * F.least(F.abs(lo), F.abs(hi)))
    near, far = (v - lo) / F.when(close, hi - lo), (_scale(v) - _scale(lo)) / F.when(_scale(hi) > _scale(lo), _scale(hi) - _scale(lo))
    inside = F.floor(F.coalesce(F.when(close, near).otherwise(far), F.lit(0.0)) * F.lit(float(BINS)))
    return F.when(v <= lo, 0).when(v >= hi, BINS - 1).otherwise(F.greatest(F.lit(0), F.least(inside, F.lit(BINS - 1)))).cast("int")


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, share, q): exact quantiles of each group, for each share between 0 and 1; a group without a value has no row.

    Nulls, NaN and infinite values don't count. Null groups are groups. With values spread evenly a pass leaves one in
    BINS; the least and the largest value of a bin are its next ends, so that equal values end the search at once.
    """
    spark = rows.sparkSession
    key = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("_"))
    v = F.col(value).cast("double")
    values = cut(rows.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))).select(F.xxhash64(key).alias("h"), key.alias("g"), v.alias("v")))
    sizes = values.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("share")) for i, s in enumerate(shares)]))
    at = (F.col("n") - 1) * F.col("w.share")
    asked = cut(sizes.withColumn("w", wanted).select("h", "g", "n", "lo", "hi", F.col("w.share").alias("share"), F.floor(at).alias("r0"), (at - F.floor(at)).alias("part")))
    places = F.explode(F.array_distinct(F.array(F.col("r0"), F.least(F.col("r0") + 1, F.col("n") - 1))))
    state = asked.select("h", "g", places.alias("place"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")).distinct()
    found = []
    while True:
        state = cut(state)
        found.append(state.filter("lo = hi").select("h", "g", "place", F.col("lo").alias("v")))
        few = state.filter(f"lo < hi and inside <= {LISTED}")
        spans = few.select("h", F.col("g").alias("_g"), "lo", "hi", "below").distinct()
        listed = values.join(small(spans), "h").filter("g <=> _g and v >= lo and v <= hi").groupBy("h", "g", "lo", "hi").agg(F.sort_array(F.collect_list("v")).alias("vs"))
        found.append(few.join(listed.withColumnRenamed("g", "_g"), ["h", "lo", "hi"]).filter("g <=> _g").select("h", "g", "place", F.get("vs", (F.col("place") - F.col("below")).cast("int")).alias("v")))
        wide = state.filter(f"lo < hi and inside > {LISTED}")
        if wide.isEmpty():
            break
        spans = wide.select("h", F.col("g").alias("_g"), "lo", "hi").distinct()
        counted = values.join(small(spans), "h").filter("g <=> _g and v >= lo and v <= hi").groupBy("h", "g", "lo", "hi", _bin(F.col("v"), F.col("lo"), F.col("hi")).alias("bin"))
        bins = counted.agg(F.count("*").alias("inside"), F.min("v").alias("lo2"), F.max("v").alias("hi2"))
        before = Window.partitionBy("h", "g", "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # over bins
        bins = bins.withColumn("before", F.coalesce(F.sum("inside").over(before), F.lit(0)))
        met = wide.drop("inside").join(bins.withColumnRenamed("g", "_g"), ["h", "lo", "hi"]).filter("g <=> _g and place >= below + before and place < below + before + inside")
        state = met.select("h", "g", "place", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), (F.col("below") + F.col("before")).alias("below"), "inside")
    points = cut(_union(found))
    pick = lambda name: points.select(F.col("h"), F.col("g").alias(f"_{name}g"), F.col("place").alias(f"_{name}"), F.col("v").alias(name))
    first = asked.join(pick("v0"), "h").filter("g <=> _v0g and r0 = _v0")
    both = first.join(pick("v1"), "h").filter("g <=> _v1g and least(r0 + 1, n - 1) = _v1")
    q = F.col("v0") * (1 - F.col("part")) + F.col("v1") * F.col("part")
    return both.select(*[F.col(f"g.{c}").alias(c) for c in by], "share", q.alias("q"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quantile_columns(rows: DataFrame, by: list[str], value: str, names: dict[str, float]) -> DataFrame:
    """``quantiles`` with a column for each name."""
    long = quantiles(rows, by, value, list(names.values()))
    return long.groupBy(*by).agg(*[F.max(F.when(F.col("share") == F.lit(float(s)), F.col("q"))).alias(n) for n, s in names.items()])
