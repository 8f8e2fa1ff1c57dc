"""Corpora, judgements, topics, rankings and results in files. All readers use Spark's file sources, so any store will do."""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boolsieve.session import small

ARTICLE = "pmid string, title string, abstract string, mesh_terms array<string>"
BOW = "id string, title string, abstract string, bow array<string>"
SIZE = "struct<paths:int,avg_path_len:double,ANDs:int,NOTs:int,added_ORs:int,synonym_ORs:int,ORs:int>"
RESULT = (
    "query_id string, num_positive long, top_k long, pubmed_retrieved long, pubmed_precision double, pubmed_recall double, subset_retrieved long, subset_precision double, "
    f"subset_recall double, pseudo_precision double, pseudo_recall double, optimization_score double, qg_time_seconds double, pubmed_query string, rules string, query_size {SIZE}"
)
DETAILS = "title string, abstract string, positives array<string>, search_strategy map<string,string>"
RANKING = "query_id string, rank int, doc_id string, score double"

# fixed values: which data set a topic list belongs to, first match wins
DATASETS = (("tar2019", ("tar2017_train", "tar2017_test", "tar2018_train", "tar2018_test")), ("sigir2017", ("sigir2017",)), ("sr_updates", ("sr_updates",)))


def read_jsonl(spark: SparkSession, path: str, schema: str, keep: str | None = None) -> DataFrame:
    """Lines of JSON. NUL characters and blank lines are dropped; with ``keep`` so are rows in which that column is null.

    A line that can't be read gives a row of nulls, so ``keep`` drops it too.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.translate("value", "\0", "").alias("value"), F.col("_metadata.file_path").alias("file"))
    rows = lines.filter(F.trim("value") != "").select("file", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("file", "r.*")
    return rows.filter(F.col(keep).isNotNull()) if keep else rows


def read_articles(spark: SparkSession, path: str, n_docs: int | None = None) -> DataFrame:
    rows = read_jsonl(spark, path, ARTICLE, keep="pmid").drop("file")
    return rows.limit(n_docs) if n_docs else rows


def heading_index(articles: DataFrame) -> DataFrame:
    """(heading, pmid): the inverted index of headings, a row for each pair; grouping it by heading is left to its user."""
    return articles.select(F.explode("mesh_terms").alias("heading"), "pmid").distinct()


def sample_articles(spark: SparkSession, path: str, n_files: int, n_rows: int, seed: int = 1) -> DataFrame:
    """Up to ``n_rows`` complete articles from each of ``n_files`` files, both drawn by hash."""
    rows = read_jsonl(spark, path, ARTICLE, keep="pmid").filter("trim(title) <> '' and trim(abstract) <> ''")
    files = rows.select("file").distinct().orderBy(F.xxhash64(F.lit(seed), "file"), "file").limit(n_files)
    order = Window.partitionBy("file").orderBy(F.xxhash64(F.lit(seed), "pmid"), "pmid")
    return rows.join(F.broadcast(files), "file").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n_rows).drop("_n")


def medline(spark: SparkSession, path: str) -> DataFrame:
    """Articles from XML, compressed or not: the first id, the title, the first abstract text, all headings."""
    schema = (
        "MedlineCitation struct<PMID:array<struct<_VALUE:string>>,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<string>>>,"
        "MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:struct<_VALUE:string>>>>>"
    )
    rows = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(schema).load(path).select("MedlineCitation.*")
    first = lambda a: F.get(a, F.lit(0))
    return rows.select(
        first(F.col("PMID"))["_VALUE"].alias("pmid"), F.col("Article.ArticleTitle").alias("title"), first(F.col("Article.Abstract.AbstractText")).alias("abstract"),
        F.coalesce(F.transform("MeshHeadingList.MeshHeading", lambda h: h["DescriptorName"]["_VALUE"]), F.array().cast("array<string>")).alias("mesh_terms"),
    )


def descriptors(spark: SparkSession, path: str) -> DataFrame:
    """(ui, name, tree_numbers, concepts, scope_note) from a vocabulary's XML."""
    schema = (
        "DescriptorUI string, DescriptorName struct<String:string>, TreeNumberList struct<TreeNumber:array<string>>, "
        "ConceptList struct<Concept:array<struct<ConceptName:struct<String:string>,ScopeNote:string,TermList:struct<Term:array<struct<String:string>>>>>>"
    )
    rows = spark.read.format("xml").option("rowTag", "DescriptorRecord").schema(schema).load(path)
    concepts = F.transform("ConceptList.Concept", lambda c: F.struct(c["ConceptName"]["String"].alias("name"), F.transform(c["TermList"]["Term"], lambda t: t["String"]).alias("terms")))
    note = F.get(F.filter(F.transform("ConceptList.Concept", lambda c: F.trim(c["ScopeNote"])), lambda n: n.isNotNull()), F.lit(0))
    return rows.select(
        F.col("DescriptorUI").alias("ui"), F.lower("DescriptorName.String").alias("name"),
        F.coalesce("TreeNumberList.TreeNumber", F.array().cast("array<string>")).alias("tree_numbers"), concepts.alias("concepts"), note.alias("scope_note"),
    )


def cached(spark: SparkSession, path: str, make: Any) -> DataFrame:
    """The Parquet at ``path``, made first if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, rel) from lines of topic, iteration, document, relevance; other lines are skipped."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).filter(F.size("p") == 4)
    rel = F.expr("try_cast(p[3] as int)")
    return parts.select(F.col("p")[0].alias("query_id"), F.col("p")[2].alias("doc_id"), rel.alias("rel")).filter("rel is not null")


def first_column(spark: SparkSession, path: str) -> DataFrame:
    """(query_id): the different first words of a file's lines."""
    return spark.read.text(path).select(F.element_at(F.split(F.trim("value"), r"\s+"), 1).alias("query_id")).filter("query_id <> ''").distinct()


def file_stems(spark: SparkSession, path: str) -> DataFrame:
    """(stem): the names of a folder's files without ending."""
    names = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"))
    return names.distinct()


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """(query_id, place) of two lists (query_id): whether a topic is in both, left or right."""
    a, b = (x.select("query_id").distinct().withColumn(name, F.lit(1)) for x, name in ((left, "_l"), (right, "_r")))
    place = F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both")
    return a.join(b, "query_id", "full_outer").select("query_id", place.alias("place"))


def topics(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, title) of files with ``Topic:`` and ``Title:`` up to ``Query``."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.regexp_extract("value", r"Topic:\s*(\S+)", 1).alias("query_id"), F.trim(F.regexp_extract("value", r"Title:\s*(.*)\n*Query", 1)).alias("title")).filter("query_id <> ''")


def read_bow(spark: SparkSession, path: str, headings: bool = True) -> DataFrame:
    rows = read_jsonl(spark, path, BOW, keep="id").drop("file")
    return rows if headings else rows.withColumn("bow", F.filter("bow", lambda t: ~F.contains(t, F.lit("[mh]"))))


def synonym_map(spark: SparkSession, path: str) -> DataFrame:
    """(lemma, forms) of one JSON object."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return text.select(F.explode("m").alias("lemma", "forms"))


def dataset_details(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, title, abstract, positives, search_strategy, num_positives) of one JSON object by topic."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,struct<{DETAILS.replace(' ', ':').replace(',:', ',')}>>").alias("m"))
    return text.select(F.explode("m").alias("query_id", "d")).select("query_id", "d.*").withColumn("num_positives", F.size(F.array_distinct("positives")))


def build_details(documents: DataFrame) -> DataFrame:
    """(query_id, positives, num_positives) of labelled documents (query_id, doc_id, label), over all splits."""
    return documents.filter("label = 1").groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("positives"), F.count_distinct("doc_id").alias("num_positives"))


def write_rankings(ranking: DataFrame, path: str) -> None:
    """A folder a query, so that one query reads one folder."""
    ranking.write.mode("overwrite").partitionBy("query_id").parquet(path)


def read_ranking(spark: SparkSession, path: str, query_id: str | None = None) -> DataFrame:
    rows = spark.read.schema(RANKING).parquet(path)
    return rows.filter(F.col("query_id") == query_id) if query_id is not None else rows


def read_results(spark: SparkSession, path: str, min_positive: int = 0, query_ids: list[str] | None = None, k_types: list[str] | None = None, betas: list[float] | None = None) -> DataFrame:
    """Result rows of all files below a folder: the first of each query and file, with ``trial``, ``k_type`` and ``betas``.

    The trial is a part of the path (``/n3/``), as is the cutoff type (``ktype=cosine``); the betas are in a file of meta
    data beside the results. ``betas`` keeps runs that were selected for all of them.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "qg_results.jsonl").text(path)
    lines = lines.select(F.translate("value", "\0", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    rows = lines.filter(F.trim("value") != "").select("file", "block", "line", F.from_json("value", RESULT).alias("r")).select("file", "block", "line", "r.*").filter("query_id is not null")
    data = F.struct(*[F.col(c) for c in rows.columns])
    rows = rows.groupBy("file", "query_id").agg(F.min_by(data, F.struct("block", "line")).alias("_r")).select("_r.*").drop("block", "line")
    rows = rows.withColumn("trial", F.expr(r"try_cast(regexp_extract(file, '/n(\\d+)/', 1) as int)")).withColumn("k_type", k_type(F.col("file")))
    meta = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "qg_meta_data.json").text(path, wholetext=True)
    meta = meta.select(F.regexp_replace(F.col("_metadata.file_path"), "qg_meta_data.json$", "qg_results.jsonl").alias("file"), F.map_keys(F.from_json(F.get_json_object("value", "$.betas"), "map<string,string>")).alias("betas"))
    rows = rows.join(small(meta), "file", "left")
    rows = rows.filter(F.col("num_positive") >= min_positive)
    if query_ids:
        rows = rows.filter(F.col("query_id").isin(query_ids))
    if k_types:
        rows = rows.filter(F.col("k_type").isin(k_types))
    if betas:
        asked = F.array(*[F.lit(float(b)) for b in betas])
        rows = rows.filter(F.size(F.array_except(asked, F.transform(F.coalesce("betas", F.array().cast("array<string>")), lambda b: b.cast("double")))) == 0)
    return rows


def k_type(path: Column, strict: bool = False) -> Column:
    """cosine, pos_count or fixed, from a path; null if it names none, or an error with ``strict``."""
    found = F.regexp_extract(path, "ktype=(cosine|pos_count|fixed)", 1)
    known = F.when(found != "", found)
    return known.otherwise(F.raise_error(F.concat(F.lit("no cutoff type in "), path)).cast("string")) if strict else known


def run_means(results: DataFrame, columns: list[str]) -> DataFrame:
    """(file, n, <column>_mean): the means of each result file's rows."""
    return results.groupBy("file").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"{c}_mean") for c in columns])


def examples(spark: SparkSession, path: str, paper: str | None = None) -> DataFrame:
    """(paper, title, name, query_id, query) of a JSON object of papers with examples."""
    schema = "map<string,struct<title:string,name:string,examples:array<struct<query_id:string,query:string,info:string>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("paper", "p"))
    rows = rows.select("paper", "p.title", "p.name", F.explode("p.examples").alias("e")).select("paper", "title", "name", "e.*")
    return rows.filter(F.col("paper") == paper) if paper else rows


def plain_values(value: Any) -> Any:
    """JSON values with the strings true, false and null, as keys or values, taken for what they say."""
    words = {"true": True, "false": False, "null": None}
    if isinstance(value, dict):
        return {words.get(k, k) if isinstance(k, str) else k: plain_values(v) for k, v in value.items()}
    if isinstance(value, list):
        return [plain_values(v) for v in value]
    return words.get(value, value) if isinstance(value, str) else value


def abbreviate(params: dict[str, Any]) -> str:
    """A parameter set as a short part of a path: first letters of each name's words, and the value."""

    def short(v: Any) -> str:
        if isinstance(v, bool) or v is None:
            return {True: "T", False: "F", None: "N"}[v]
        return f"{v:g}" if isinstance(v, float) else re.sub(r"[^A-Za-z0-9.]+", "-", str(v))

    return ",".join(f"{''.join(w[0] for w in k.split('_'))}={short(v)}" for k, v in sorted(params.items()))


def params_digest(params: dict[str, Any]) -> str:
    """A stable name for a parameter set."""
    return hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()[:16]


def routed(topics_: DataFrame, lists: DataFrame) -> DataFrame:
    """Topics with their data set; lists (query_id, list). Of several the one that DATASETS names first; none: unknown."""
    order = [(name, k, part) for k, (name, parts) in enumerate(DATASETS) for part in parts]
    table = topics_.sparkSession.createDataFrame(order, "dataset string, priority int, list string")
    of = lists.join(F.broadcast(table), "list").groupBy("query_id").agg(F.min_by("dataset", "priority").alias("dataset"))
    return topics_.join(small(of), "query_id", "left").fillna("unknown", ["dataset"])


def manifest(rows: DataFrame, deliveries: list[int] | None = None) -> DataFrame:
    """(value): lines of a download list from (items: array of {id, files: array of {name, url, checksum}})."""
    items = rows.select(F.explode("items").alias("i"))
    if deliveries:
        items = items.filter(F.col("i.id").isin(deliveries))
    files = items.select(F.explode("i.files").alias("f"))
    return files.select(F.format_string("%s\n  out=%s\n  checksum=sha-1=%s", "f.url", "f.name", "f.checksum").alias("value"))


def with_column(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Bags of words with one column more, for a new output: inputs are never changed in place. A name that there is already is an error."""
    if name.lower() in (c.lower() for c in rows.columns):
        raise ValueError(f"there is a column {name!r} already")
    return rows.withColumn(name, value)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def upsert(old: DataFrame | None, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows by key, the last one by ``order`` wins; a row without a key is an error."""
    both = new if old is None else old.unionByName(new, allowMissingColumns=True)
    checked = both.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.lit("a row has no id")).cast(both.schema[key].dataType)).otherwise(F.col(key)))
    return checked.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in both.columns]), order).alias("_r")).select("_r.*")
