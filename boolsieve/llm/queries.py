"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boolsieve.llm import chat, decontaminate, divergence, exact_search, licenses, media, merkle, mixing, quality, simhash, sql, token_counts, toxicity, url_filter
from boolsieve.llm.common import table


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.load_pieces())


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held_out = F.coalesce(toxicity.fold("doc_id") == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "toxic_spans")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("found")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_texts(table(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).drop("own_rule")


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the texts that labels call good."""
    return table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), trusted(spark, sf_dir))
    return scored.select("doc_id", "lang", "perplexity", "smoothed", "threshold", "kept")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_conversations(chat.with_probe(spark, table(spark, sf_dir, "conversations"))))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), mixing.WEIGHTS, size=mixing.SIZE)
    return mixed.select("doc_id", "source", "lang", "n_chars", "text", "copy", "rate", "shuffle_key")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_tokens, op2_toxicity, op3_simhash, op4_licenses, op5_media, op6_urls, op7_quality, op8_decontaminate, op9_chat, op10_mix, op11_divergence, op12_manifest, op13_topk)}
ORACLE_SQL: dict[str, str] = sql.ORACLE_SQL
