"""Mixes sources to target weights by Poisson replication and a global shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boolsieve.llm.common import free, without
from boolsieve.session import cut

SEED = 7
#: Groups (sources) up to which the table of their distributions is broadcast; it takes under 2 KB a group.
BROADCAST_GROUPS = 2_000
#: Highest mean of one draw. A larger rate is the sum of as many independent draws of equal means as it takes, which is
#: Poisson distributed with that rate, too.
LARGEST_MEAN = 16.0
_STEPS = 64  # the distribution of a mean up to LARGEST_MEAN is 1 in double precision well before


def uniform(seed: int, id_col: Column, draw: Column | None = None) -> Column:
    """A number in [0, 1) from the MD5 of seed and id, and of the draw if there are several: the same on every run, engine and partitioning."""
    name = F.lit(f"{seed}:") if draw is None else F.concat(F.lit(f"{seed}/"), draw.cast("string"), F.lit(":"))
    digest = F.md5(F.concat(name, F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def distribution(mean: Column) -> Column:
    """The Poisson distribution function of ``mean`` at 0, 1, 2, ... as an array."""
    term = F.exp(-mean)
    start = F.struct(F.array(term).alias("cdf"), term.alias("p"))
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(_STEPS)), start,
        lambda acc, k: F.struct(F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * mean / k)).alias("cdf"), (acc["p"] * mean / k).alias("p")),
    )
    return step["cdf"]


def rates(docs: DataFrame, weights: dict[str, float], source_col: str = "source", size: float = 1.0, default_weight: float = 1.0) -> DataFrame:
    """(key, rate, draws, cdf) of every source: rate is how often one of its documents shall stand in the mixture.

    ``cdf`` is the Poisson distribution function of a draw's mean, ``draws`` how many make the rate.
    A source's share of the mixture is its weight over the sum of the weights of the sources that have rows; the mixture
    has ``size`` times the documents of the input. A source without a weight has ``default_weight``, a null source counts
    as a source of its own. Counts are aggregated in the map tasks.
    """
    weight = F.lit(float(default_weight))
    for name, w in weights.items():
        if not math.isfinite(w) or w < 0:
            raise ValueError("weights must be finite and not negative")
        weight = F.when(F.col("key") == F.lit(name), F.lit(float(w))).otherwise(weight)
    counted = cut(docs.groupBy(F.col(f"`{source_col}`").cast("string").alias("key")).agg(F.count("*").alias("n")).withColumn("w", weight))
    totals = counted.agg(F.sum("n").cast("double").alias("n"), F.sum("w").alias("w")).first()
    rate = F.lit(float(size)) * F.lit(totals["n"] or 0.0) * F.col("w") / F.lit(totals["w"] or 1.0) / F.col("n")
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(LARGEST_MEAN)).cast("int"))
    return counted.withColumn("rate", rate).withColumn("draws", draws).withColumn("cdf", distribution(F.col("rate") / F.col("draws"))).select("key", "rate", "draws", "cdf")


def copies_of(cdf: Column, draws: Column, seed: int, id_col: Column) -> Column:
    """How many values of the distribution function are at most a uniform number, added up over the draws."""

    def one(u: Column) -> Column:
        return F.size(F.filter(cdf, lambda c: c <= u))

    several = F.aggregate(F.sequence(F.lit(1), draws), F.lit(0), lambda total, k: total + one(uniform(seed, id_col, k)))
    return F.when(draws == 1, one(uniform(seed, id_col))).otherwise(several)


def mix(
    docs: DataFrame, weights: dict[str, float], id_col: str = "doc_id", source_col: str = "source", size: float = 1.0,
    default_weight: float = 1.0, seed: int = SEED, partitions: int | None = None,
) -> DataFrame:
    """``docs`` with ``copy`` (1, 2, ...), ``rate`` and ``shuffle_key``, each row as often as its draw says, in random order.

    The number of copies is the inverse of the Poisson distribution of the source's rate at a uniform number made of seed
    and id: a repeated id (or a null one) draws the same number in each of its rows. ``shuffle_key`` hashes seed, id and
    copy; rows go to a partition by its hash and are sorted by it there, which is the global shuffle. Input columns named
    like the three are replaced; texts are not looked at; an empty table stays empty.
    """
    table = cut(rates(docs, weights, source_col, size, default_weight))
    if table.count() <= BROADCAST_GROUPS:
        table = F.broadcast(table)
    rows = without(docs, "copy", "rate", "shuffle_key")
    key, draws, cdf, copies = free(rows, "_key", "_draws", "_cdf", "_copies")
    known = table.select(F.col("key").alias(key), "rate", F.col("draws").alias(draws), F.col("cdf").alias(cdf))
    drawn = rows.join(known, F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col(key)))
    count = copies_of(F.col(cdf), F.col(draws), seed, F.col(f"`{id_col}`"))
    drawn = drawn.withColumn(copies, count).filter(F.col(copies) > 0).drop(key, draws, cdf)
    exploded = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(copies)
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.col("copy").cast("string"))
    keyed = exploded.withColumn("shuffle_key", F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long"))
    spread = keyed.repartition(partitions, "shuffle_key", f"`{id_col}`") if partitions else keyed.repartition("shuffle_key", f"`{id_col}`")
    return spread.sortWithinPartitions("shuffle_key")


#: The mixture of the query: src0 holds a third of all rows and is cut down, four others are raised.
WEIGHTS = {"src0": 2.0, "src1": 3.0, "src2": 2.0, "src3": 1.5, "src4": 0.5}
SIZE = 0.75
