"""Groups, bins, quantiles and dedupes over result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boolsieve.functions.safe import ratio
from boolsieve.operators.quantiles import quantile_columns, quantiles
from boolsieve.operators.scans import prefixes
from boolsieve.session import small


def group_stats(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean, sample deviation (0 for one row) and count of each value by group."""
    aggs = [F.count("*").alias("n")]
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{v}_std")]
    return rows.groupBy(*by).agg(*aggs)


def spread(rows: DataFrame, by: Column | str, name: str, value: str) -> DataFrame:
    """Least, mean and largest value by group."""
    key = F.col(by) if isinstance(by, str) else by
    return rows.groupBy(key.alias(name)).agg(F.min(value).alias("low"), F.avg(value).alias("mean"), F.max(value).alias("high"))


def bin_percentiles(rows: DataFrame, x: str, y: str, width: float, percents: tuple[float, ...] = (0.25, 0.5, 0.75), min_rows: int = 1) -> DataFrame:
    """(bin, mean, n, p25, ...) over bins [i * width, (i + 1) * width); exact percentiles, linear between values."""
    binned = rows.select((F.floor(F.col(x) / F.lit(float(width))) * F.lit(float(width))).alias("bin"), F.col(y).alias("_y"))
    stats = binned.groupBy("bin").agg(F.avg("_y").alias("mean"), F.count("*").alias("n")).filter(F.col("n") >= min_rows)
    points = quantile_columns(binned, ["bin"], "_y", {f"p{round(p * 100)}": p for p in percents}).withColumnRenamed("bin", "_bin")
    return stats.join(points, F.col("bin").eqNullSafe(F.col("_bin")), "left").drop("_bin")


def quantile_buckets(rows: DataFrame, x: str, y: str, q: int) -> DataFrame:
    """(bucket, mean, n): buckets between the q-quantiles of x, open at the left but for the first."""
    edges = quantiles(rows, [], x, [i / q for i in range(1, q)]).agg(F.array_sort(F.collect_list("q")).alias("e"))  # q - 1 numbers
    value = F.col(x).cast("double")
    bucket = F.aggregate("e", F.lit(0), lambda n, e: n + F.when(value > e, 1).otherwise(0))
    return rows.join(F.broadcast(edges)).groupBy(bucket.alias("bucket")).agg(F.avg(y).alias("mean"), F.count("*").alias("n"))  # one row of edges


def mismatch(rows: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Mean signed and mean absolute difference."""
    d = F.col(a) - F.col(b)
    return rows.groupBy(*by).agg(F.avg(d).alias("mean_diff"), F.avg(F.abs(d)).alias("mean_abs_diff"))


def histogram2d(rows: DataFrame, x: str, y: str, bins: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(xb, yb, n) over equal bins; the last one has its upper end too, values outside are left out."""
    place = lambda c: F.least(F.width_bucket(F.col(c).cast("double"), F.lit(low), F.lit(high), F.lit(bins)) - 1, F.lit(bins - 1).cast("long"))
    inside = F.col(x).between(low, high) & F.col(y).between(low, high)
    return rows.filter(inside).groupBy(place(x).alias("xb"), place(y).alias("yb")).agg(F.count("*").alias("n"))


def percent_over(rows: DataFrame, value: str, limits: list[float], *by: str) -> DataFrame:
    """The percentage of rows at or above each limit, as columns ``ge_<limit>``."""
    return rows.groupBy(*by).agg(*[(F.avg(F.when(F.col(value) >= x, 1.0).otherwise(0.0)) * 100).alias(f"ge_{x:g}".replace(".", "_")) for x in limits])


def first_rows(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group. Rows that tie in ``order`` should not differ.

    The smallest row of a group is a partial aggregate, so a group with many rows is never brought together.
    """
    data = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*by).agg(F.min_by(data, F.struct(*order)).alias("_row")).select("_row.*")


def best_and_worst(rows: DataFrame, measures: dict[str, str], id_col: str) -> DataFrame:
    """(measure, side, id, value): the rows of the highest and lowest value of each measure; ties by id."""
    out = None
    for name, column in measures.items():
        top = rows.agg(F.max_by(F.struct(id_col, column), F.struct(F.col(column), -F.col(id_col))).alias("hi"), F.min_by(F.struct(id_col, column), F.struct(column, id_col)).alias("lo"))
        pair = top.select(F.lit(name).alias("measure"), F.inline(F.array(
            F.struct(F.lit("best").alias("side"), F.col(f"hi.{id_col}").alias("id"), F.col(f"hi.{column}").cast("double").alias("value")),
            F.struct(F.lit("worst").alias("side"), F.col(f"lo.{id_col}").alias("id"), F.col(f"lo.{column}").cast("double").alias("value")),
        )))
        out = pair if out is None else out.unionByName(pair)
    return out


def closest_to_average(rows: DataFrame, value: str, id_col: str) -> DataFrame:
    """The row whose value is closest to the mean; ties by id."""
    mean = rows.agg(F.avg(value).alias("_mean"))
    far = F.abs(F.col(value) - F.col("_mean"))
    best = rows.join(F.broadcast(mean)).agg(F.min_by(F.struct(id_col, value, "_mean"), F.struct(far, id_col)).alias("b"))
    return best.select(f"b.{id_col}", f"b.{value}", F.col("b._mean").alias("mean"))


def widest_group(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The rows of the group whose values lie farthest apart; ties by group."""
    spreads = rows.groupBy(by).agg((F.max(value) - F.min(value)).alias("_spread"))
    return rows.join(F.broadcast(spreads.orderBy(F.desc("_spread"), by).limit(1)), by)


def running_mean(rows: DataFrame, by: str, step: str, value: str) -> DataFrame:
    """Rows with ``running``, the mean of the group's values so far; a group of any size is many tasks."""
    sums = {"_sum": F.col(value).cast("double"), "_count": F.when(F.col(value).isNotNull(), 1)}
    out = prefixes(rows, [by], [step], "_place", sums)
    return out.select(*rows.columns, F.when(F.col("_count") > 0, F.col("_sum") / F.col("_count")).alias("running"))


def open_work(grid: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """The work items that are not finished yet."""
    return grid.join(done.select(*on).distinct(), on, "left_anti")


def work_share(rows: DataFrame, order: str, n: int, k: int) -> DataFrame:
    """The k-th of n shares of some work items, dealt by a hash of their key: no global numbering is needed."""
    return rows.filter(F.pmod(F.xxhash64(order), F.lit(n)) == k)


def split_outliers(rows: DataFrame, value: str, high: float) -> tuple[DataFrame, DataFrame]:
    """(kept, outliers): rows whose value is 0 or above ``high`` go to the second."""
    odd = (F.col(value) == 0) | (F.col(value) > high)
    return rows.filter(~odd), rows.filter(odd)


def rollup_means(rows: DataFrame, by: str, values: list[str]) -> DataFrame:
    """Means by group and, with a null group, of all rows."""
    return rows.rollup(by).agg(F.count("*").alias("n"), *[F.avg(v).alias(f"{v}_mean") for v in values])


def qrels_stats(qrels: DataFrame) -> DataFrame:
    """One row: queries, pairs, least, most and mean positives and negatives of a query, and the percentage of positives."""
    each = qrels.groupBy("query_id").agg(F.sum(F.when(F.col("rel") > 0, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("rel") > 0, 0).otherwise(1)).alias("n"))
    return each.agg(
        F.count("*").alias("queries"), F.sum(F.col("p") + F.col("n")).alias("pairs"), F.min("p").alias("min_pos"), F.max("p").alias("max_pos"), F.avg("p").alias("avg_pos"),
        F.min("n").alias("min_neg"), F.max("n").alias("max_neg"), F.avg("n").alias("avg_neg"), (ratio(F.sum("p"), F.sum(F.col("p") + F.col("n"))) * 100).alias("pct_pos"),
    )


def pooled_qrels(qrels: DataFrame, known: DataFrame) -> DataFrame:
    """Judgements of known documents, of the queries that keep a positive one."""
    kept = qrels.join(known.select("doc_id").distinct(), "doc_id", "left_semi")
    alive = kept.filter("rel > 0").select("query_id").distinct()
    return kept.join(small(alive), "query_id", "left_semi")


def term_counts(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values with their share of all rows; ties by value."""
    n = rows.agg(F.count("*").alias("_n"))
    top = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)
    return top.join(F.broadcast(n)).select("value", "n", (ratio(F.col("n"), F.col("_n")) * 100).alias("pct"))


def size_histogram(rows: DataFrame, size: Column, bins: int) -> DataFrame:
    """(bin, n, lo): sizes over equal bins between the least and the largest."""
    sized = rows.select(size.cast("double").alias("s"))
    ends = sized.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    step = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)
    at = F.least(F.floor((F.col("s") - F.col("lo")) / step), F.lit(bins - 1).cast("long"))
    joined = sized.join(F.broadcast(ends)).select(at.alias("bin"), (F.col("lo") + at * step).alias("from"))  # one row of ends
    return joined.groupBy("bin").agg(F.count("*").alias("n"), F.min("from").alias("lo"))


def extrapolated_size(rows: DataFrame, size: Column, target: int) -> DataFrame:
    """One row: mean size and what ``target`` rows would take."""
    return rows.agg(F.count("*").alias("n"), F.avg(size).alias("mean_size"), (F.avg(size) * target).alias("at_target"))


def sample_audit(rows: DataFrame, by: list[str], expected: DataFrame) -> DataFrame:
    """Groups whose number of rows is not the expected one (expected: by, expected)."""
    actual = rows.groupBy(*by).agg(F.count("*").alias("actual"))
    joined = expected.join(actual, by, "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return joined.filter(F.col("actual") != F.col("expected"))


def duplicate_share(items: DataFrame, by: str, name: str, at: str, substring: bool = False) -> DataFrame:
    """(by, n, pct): the percentage of names that an earlier one of the group equals or, with ``substring``, holds or is held by."""
    if not substring:
        return items.groupBy(by).agg(F.count("*").alias("n"), (ratio(F.count("*") - F.count_distinct(name), F.count("*")) * 100).alias("pct"))
    listed = items.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(at, name))).alias("x"))  # a query's terms
    same = lambda a, b: F.contains(a[name], b[name]) | F.contains(b[name], a[name])
    dup = F.filter("x", lambda a, i: F.exists(F.slice("x", 1, i), lambda b: same(a, b)))
    return listed.select(by, F.size("x").cast("long").alias("n"), (ratio(F.size(dup), F.size("x")) * 100).alias("pct"))


def state_counts(trials: DataFrame) -> DataFrame:
    """(study, state, n), and with a null study those of all."""
    return trials.cube("study", "state").agg(F.count("*").alias("n"), F.grouping("state").alias("_all")).filter("_all = 0").drop("_all")
