"""Postings, document frequencies and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boolsieve.functions.text import is_term, tokens
from boolsieve.session import cut, small


def postings(docs: DataFrame, doc: str = "doc_id", text: str = "text", bow: Column | None = None) -> DataFrame:
    """(doc, term): every different term of every document once. ``bow``: an array of terms to use instead of the text's."""
    if bow is not None:
        return docs.select(doc, F.explode(F.array_distinct(bow)).alias("term"))
    return docs.select(doc, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).filter(is_term(F.col("term")))  # what is filtered after the explode is compiled


def document_frequencies(post: DataFrame) -> DataFrame:
    """(term, df)."""
    return post.groupBy("term").agg(F.count("*").alias("df"))


def _bound(limit: float, n: float) -> float:
    """A whole number is a count, a fraction a share of the documents."""
    return limit * n if isinstance(limit, float) else limit


def within(df: DataFrame, n_docs: int, min_df: float = 1, max_df: float = 1.0) -> DataFrame:
    """The terms whose frequency lies within both bounds."""
    return df.filter((F.col("df") >= F.lit(_bound(min_df, n_docs))) & (F.col("df") <= F.lit(_bound(max_df, n_docs))))


def numbered(vocab: DataFrame) -> DataFrame:
    """The vocabulary with ``term_id`` from 0 in the order of terms.

    Terms are counted by range partitions first, so that no task sees them all.
    """
    ranged = cut(vocab.repartitionByRange("term").withColumn("_part", F.spark_partition_id()))  # written, so that both uses see the same parts
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy("term")) - 1
    return ranged.withColumn("_at", place).join(F.broadcast(starts), "_part").select(*vocab.columns, (F.col("_start") + F.col("_at")).alias("term_id"))


def vocabulary(post: DataFrame, n_docs: int, min_df: float = 1, max_df: float = 1.0) -> DataFrame:
    """(term, df, term_id) of the terms within the bounds."""
    return numbered(within(document_frequencies(post), n_docs, min_df, max_df))


def restrict(post: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc, term_id) postings of a vocabulary."""
    return post.join(small(vocab.select("term", "term_id")), "term").drop("term")


def sweep(df: DataFrame, n_docs: int, min_dfs: list[float], max_dfs: list[float]) -> DataFrame:
    """(min_df, max_df, features, lowest, highest): the size and extreme frequencies of every vocabulary, in one pass."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(float(a), float(b), float(_bound(a, n_docs)), float(_bound(b, n_docs))) for a in min_dfs for b in max_dfs], "min_df double, max_df double, lo double, hi double")
    joined = df.join(F.broadcast(grid), (F.col("df") >= F.col("lo")) & (F.col("df") <= F.col("hi")))
    found = joined.groupBy("min_df", "max_df").agg(F.count("*").alias("features"), F.min("df").alias("lowest"), F.max("df").alias("highest"))
    return grid.select("min_df", "max_df").join(found, ["min_df", "max_df"], "left").fillna(0, ["features"])


def extremes(df: DataFrame, k: int) -> DataFrame:
    """(side, term, df): the k most and the k least frequent terms; ties by term."""
    top = df.orderBy(F.desc("df"), "term").limit(k).select(F.lit("top").alias("side"), "term", "df")
    return top.unionByName(df.orderBy("df", "term").limit(k).select(F.lit("bottom").alias("side"), "term", "df"))


def lookup(df: DataFrame, words: list[str]) -> DataFrame:
    """(term, df) of the given words; zero for a word without postings."""
    asked = df.sparkSession.createDataFrame([(w,) for w in dict.fromkeys(words)], "term string")
    return F.broadcast(asked).join(df.filter(F.col("term").isin(list(dict.fromkeys(words)))), "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


def class_frequencies(post: DataFrame, labels: DataFrame, doc: str = "doc_id", y: str = "y") -> DataFrame:
    """(term, df, n1, n0): document counts by class, of labelled documents."""
    return post.join(labels, doc).groupBy("term").agg(
        F.count("*").alias("df"), F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("n1"), F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("n0")
    )


def by_class_minimum(freq: DataFrame, m1: int, m0: int) -> DataFrame:
    """The terms that occur often enough in either class."""
    return freq.filter((F.col("n1") >= m1) | (F.col("n0") >= m0))


def document_count_stats(df: DataFrame, words: list[str]) -> DataFrame:
    """Mean, median, least and most documents of some terms."""
    return lookup(df, words).agg(F.avg("df").alias("avg_df"), F.percentile("df", 0.5).alias("median_df"), F.min("df").alias("min_df"), F.max("df").alias("max_df"))
