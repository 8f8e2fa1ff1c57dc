"""Where queries register themselves, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boolsieve.functions.text import FORBIDDEN, STOP_WORDS, terms, tokens
from boolsieve.operators import vocabulary
from boolsieve.session import small

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Labels that are broadcast, within the bytes of ``small``: texts are wider than they are.
LABEL_ROWS = 4_000_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its DuckDB SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six digits, so that the order of a sum does not show."""
    return F.round(c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(F.col(n)) for n in names})


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, y): which labelled documents are toxic; this stands for relevance."""
    return table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.postings(table(spark, sf_dir, "documents"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, terms, tokens) of all documents."""
    return table(spark, sf_dir, "documents").select("doc_id", terms(F.col("text")).alias("terms"), tokens(F.col("text")).alias("tokens"))


def searched(spark: SparkSession, sf_dir: str, how: str = "left") -> DataFrame:
    """(doc_id, terms, tokens, y) of all documents; y is null without a label. Texts meet labels before they are cut into tokens."""
    docs = table(spark, sf_dir, "documents").join(small(labels(spark, sf_dir), LABEL_ROWS), "doc_id", how)
    return docs.select("doc_id", terms(F.col("text")).alias("terms"), tokens(F.col("text")).alias("tokens"), "y")


def labelled_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of labelled documents; the texts of others are never read for terms."""
    own = small(labels(spark, sf_dir).select("doc_id").distinct(), LABEL_ROWS)
    return vocabulary.postings(table(spark, sf_dir, "documents").join(own, "doc_id", "left_semi"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, terms, tokens, y) of labelled documents."""
    return searched(spark, sf_dir, "inner")


_RX = "'[a-z0-9]+(?:-[a-z0-9]+)*'"
SQL_TOKENS = f"regexp_extract_all(lower(coalesce(text, '')), {_RX})"
_STOP = ", ".join(f"'{w}'" for w in (*STOP_WORDS, *FORBIDDEN))
SQL_TERMS = f"list_sort(list_filter(list_distinct({SQL_TOKENS}), lambda t: length(t) >= 2 AND NOT regexp_full_match(t, '[0-9-]+') AND t NOT IN ({_STOP})))"
SQL_POST = f"post AS (SELECT doc_id, unnest({SQL_TERMS}) AS term FROM documents)"
SQL_LAB = "lab AS (SELECT doc_id, toxic AS y FROM labels)"
SQL_TEXTS = f"texts AS (SELECT doc_id, {SQL_TERMS} AS terms, {SQL_TOKENS} AS tokens FROM documents)"
SQL_DOCS = f"docs AS (SELECT d.doc_id, {SQL_TERMS} AS terms, {SQL_TOKENS} AS tokens, toxic AS y FROM documents d JOIN labels USING (doc_id))"


def sql_f(p: str, r: str, beta: float) -> str:
    b2 = float(beta) ** 2
    return f"(CASE WHEN {b2} * {p} + {r} = 0 THEN 0.0 ELSE {1 + b2} * {p} * {r} / ({b2} * {p} + {r}) END)"


def sql_ratio(n: str, d: str) -> str:
    return f"(CASE WHEN ({d}) = 0 THEN 0.0 ELSE CAST({n} AS DOUBLE) / ({d}) END)"
