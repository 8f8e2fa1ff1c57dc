"""Sources and sinks on files that are written from the test tables, and functions of rules and trees, each with its SQL."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boolsieve.catalog.registry import SQL_LAB, SQL_POST, labels, postings, query, r6, table
from boolsieve.functions.rules import rule
from boolsieve.operators import analytics, embedding, vocabulary
from boolsieve.plans import learn, reports, rules, shards, trees
from boolsieve.session import cut, shared_folder
from boolsieve.sources import files, patents, search
from boolsieve.streaming.resume import process_new


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors see."""
    return f"{shared_folder(spark)}/formats-{uuid.uuid4().hex}"


def _tag(name: str, body: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name}>"))


def _written(rows: DataFrame, value: Column, files_: int = 2) -> str:
    """The folder of a text file for each of some partitions."""
    path = _folder(rows.sparkSession)
    rows.repartition(files_).select(value.cast("string").alias("value")).write.text(path)
    return path


def _xml(rows: DataFrame, key: str, record: Column) -> str:
    """The folder of XML files of a thousand keys each."""
    path = _folder(rows.sparkSession)
    files_ = rows.groupBy(F.floor(F.col(key).cast("long") / 1000)).agg(F.array_join(F.collect_list(record), "").alias("records"))
    files_.select(_tag("Set", F.col("records")).alias("value"), F.monotonically_increasing_id().alias("part")).write.partitionBy("part").text(path)
    return path


def _one(rows: DataFrame, value: Column) -> str:
    """The folder of one text: for objects that are a file each, as lexicons and topic lists are."""
    path = _folder(rows.sparkSession)
    rows.agg(value.alias("value")).write.text(path)
    return path


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as articles: the segment is a heading, as is the nation; some have no abstract."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("pmid"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("about "), "c_mktsegment")).alias("abstract"),
        F.array(F.col("c_mktsegment"), F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string"))).alias("mesh_terms"),
    )


_SQL_ARTICLES = """a AS (SELECT CAST(c_custkey AS VARCHAR) AS pmid, c_name AS title, CASE WHEN c_custkey % 7 <> 0 THEN 'about ' || c_mktsegment END AS abstract,
  [c_mktsegment, 'Nation ' || c_nationkey] AS mesh_terms FROM customer)"""


@query(f"WITH {_SQL_ARTICLES} SELECT pmid, title, abstract, array_to_string(mesh_terms, '; ') AS headings FROM a")
def article_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of bulk XML."""
    head = lambda h: _tag("MeshHeading", F.concat(F.lit('<DescriptorName UI="D1">'), h, F.lit("</DescriptorName>")))
    heads = F.array_join(F.transform("mesh_terms", head), "")
    text = F.when(F.col("abstract").isNotNull(), _tag("Abstract", F.concat(_tag("AbstractText", F.col("abstract")), F.lit("<AbstractText>more</AbstractText>")))).otherwise("")
    body = F.concat(F.lit('<PMID Version="1">'), "pmid", F.lit("</PMID>"), _tag("Article", F.concat(_tag("ArticleTitle", F.col("title")), text)), _tag("MeshHeadingList", heads))
    path = _xml(_articles(spark, sf_dir), "pmid", _tag("PubmedArticle", _tag("MedlineCitation", body)))
    return files.medline(spark, path).select("pmid", "title", "abstract", F.array_join("mesh_terms", "; ").alias("headings"))


@query(f"WITH {_SQL_ARTICLES} SELECT heading, count(*) AS n, min(pmid) AS first FROM (SELECT DISTINCT pmid, unnest(mesh_terms) AS heading FROM a) GROUP BY heading")
def article_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inverted index of headings from lines of JSON, of which some are broken."""
    path = _folder(spark)
    line = F.when(F.col("pmid").cast("long") % 5 == 0, F.concat(F.to_json(F.struct("*")), F.lit("\0"))).otherwise(F.to_json(F.struct("*")))
    rows = _articles(spark, sf_dir).select(line.alias("value"))
    rows.unionAll(spark.range(2).select(F.lit("no json").alias("value"))).write.text(path)
    return files.heading_index(files.read_articles(spark, path)).groupBy("heading").agg(F.count("*").alias("n"), F.min("pmid").alias("first"))


@query(f"WITH {_SQL_ARTICLES} SELECT least(count(*), 20) AS rows, least(count(*), 20) AS ids, 1 AS files, CAST(0 AS BIGINT) AS without FROM a WHERE abstract IS NOT NULL")
def article_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: a sample of complete articles of some files, by what it must keep to."""
    path = _folder(spark)
    _articles(spark, sf_dir).coalesce(1).select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    got = files.sample_articles(spark, path, 3, 20)
    return got.agg(F.count("*").alias("rows"), F.count_distinct("pmid").alias("ids"), F.count_distinct("file").cast("int").alias("files"), F.sum(F.col("abstract").isNull().cast("long")).alias("without"))


@query("SELECT CAST(vec_id AS VARCHAR) AS doc_id FROM embeddings")
def embedded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that have an embedding, in a store with repeats."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), "embedding")
    return embedding.known_ids(v.unionAll(v.filter("doc_id < 50")))


@query("SELECT o_orderpriority[1:1] AS query_id, CAST(o_orderkey AS VARCHAR) AS doc_id, CAST(o_orderstatus = 'F' AS INTEGER) AS rel FROM orders")
def judgement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements of four columns, between lines that are none."""
    o = table(spark, sf_dir, "orders")
    path = _written(o, F.concat_ws("  ", F.substring("o_orderpriority", 1, 1), F.lit("0"), F.col("o_orderkey").cast("string"), (F.col("o_orderstatus") == "F").cast("int").cast("string")))
    spark.range(1).select(F.lit("a bad line").alias("value")).write.mode("append").text(path)
    return files.qrels(spark, path)


@query("SELECT 'N' || n_nationkey AS query_id, n_name || ' of region ' || n_regionkey AS title FROM nation")
def topic_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics, a file each."""
    path, n = _folder(spark), table(spark, sf_dir, "nation")
    text = F.concat(F.lit("Topic: N"), F.col("n_nationkey").cast("string"), F.lit("\n\nTitle: "), "n_name", F.lit(" of region "), F.col("n_regionkey").cast("string"), F.lit("\n\nQuery:\nx\n"))
    n.select(text.alias("value"), F.col("n_nationkey").alias("part")).write.partitionBy("part").text(path)
    return files.topics(spark, path)


@query("""SELECT DISTINCT o_orderpriority[1:1] AS query_id, CASE WHEN o_orderpriority[1:1] IN ('1', '2') THEN 'both' ELSE 'judged' END AS place FROM orders
UNION ALL SELECT '9', 'listed'""")
def topic_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which topics two lists name, one a file's first column, the other a folder's file names."""
    judged = _written(table(spark, sf_dir, "orders"), F.concat_ws(" ", F.substring("o_orderpriority", 1, 1), F.lit("0 x 1")))
    listed = _folder(spark)
    for stem in "129":
        _named(spark, spark.range(1).select(F.lit("x").alias("value")), listed, f"{stem}.topic")
    stems = files.file_stems(spark, listed).withColumnRenamed("stem", "query_id")
    return files.overlap(files.first_column(spark, judged), stems).replace({"left": "judged", "right": "listed"}, subset="place")


@query("SELECT 'D' || n_nationkey AS ui, lower(n_name) AS name, 'A' || n_regionkey || '.' || n_nationkey AS numbers, n_name || ';' || n_name || ' land' AS terms, 'note ' || n_nationkey AS scope_note FROM nation")
def vocabulary_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors of a vocabulary's XML, kept as Parquet from the first reading on."""
    key = F.col("n_nationkey").cast("string")
    name = _tag("String", F.col("n_name"))
    terms = _tag("TermList", F.concat(_tag("Term", name), _tag("Term", _tag("String", F.concat("n_name", F.lit(" land"))))))
    concept = _tag("ConceptList", _tag("Concept", F.concat(_tag("ConceptName", name), _tag("ScopeNote", F.concat(F.lit(" note "), key)), terms)))
    number = _tag("TreeNumberList", _tag("TreeNumber", F.concat(F.lit("A"), F.col("n_regionkey").cast("string"), F.lit("."), key)))
    path = _xml(table(spark, sf_dir, "nation"), "n_nationkey", _tag("DescriptorRecord", F.concat(_tag("DescriptorUI", F.concat(F.lit("D"), key)), _tag("DescriptorName", name), number, concept)))
    kept = _folder(spark)
    for _ in range(2):
        rows = files.cached(spark, kept, lambda: files.descriptors(spark, path))
    return rows.select("ui", "name", F.array_join("tree_numbers", ";").alias("numbers"), F.array_join(F.flatten(F.transform("concepts", lambda c: c["terms"])), ";").alias("terms"), "scope_note")


@query(f"WITH {SQL_POST} SELECT CAST(doc_id AS VARCHAR) AS id, count(*) AS n, count(*) AS plain FROM post GROUP BY doc_id")
def bow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bags of words with headings, written as lines of JSON with a new column and read without headings."""
    path = _folder(spark)
    post = postings(spark, sf_dir).groupBy("doc_id").agg(F.collect_list("term").alias("bow"))
    rows = post.select(F.col("doc_id").cast("string").alias("id"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("abstract"), F.concat("bow", F.array(F.lit('"Head"[mh]'))).alias("bow"))
    files.append_jsonl(files.with_column(rows, "n_terms", F.size("bow")), path)
    every, plain = files.read_bow(spark, path), files.read_bow(spark, path, headings=False)
    return every.select("id", (F.size("bow") - 1).cast("long").alias("n")).join(plain.select("id", F.size("bow").cast("long").alias("plain")), "id")


@query("SELECT p_type AS lemma, array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS forms FROM part GROUP BY p_type")
def synonym_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon that is one JSON object."""
    p = table(spark, sf_dir, "part").groupBy("p_type").agg(F.array_sort(F.collect_set("p_brand")).alias("f"))
    path = _one(p, F.to_json(F.map_from_entries(F.collect_list(F.struct("p_type", "f")))))
    return files.synonym_map(spark, path).select("lemma", F.array_join("forms", ",").alias("forms"))


@query("""SELECT CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS INTEGER) AS rank, CAST(o_orderkey AS VARCHAR) AS doc_id, o_totalprice AS score
FROM orders WHERE o_orderpriority = '2-HIGH'""")
def ranking_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings in a folder for each query, of which one is read."""
    from pyspark.sql.window import Window

    path = _folder(spark)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "o_orderkey")
    o = table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderpriority": "query_id", "o_totalprice": "score"})
    files.write_rankings(o.select("query_id", (F.row_number().over(order) - 1).alias("rank"), F.col("o_orderkey").cast("string").alias("doc_id"), "score"), path)
    return files.read_ranking(spark, path, "2-HIGH").drop("query_id")


@query("""SELECT c_mktsegment AS query_id, count(DISTINCT o_orderkey) AS num_positives, CAST(min(o_orderkey) AS VARCHAR) AS first FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'F' GROUP BY 1""")
def topic_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics with their positives over all splits, written as one JSON object and read back."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    judged = o.select(F.col("c_mktsegment").alias("query_id"), F.col("o_orderkey").alias("doc_id"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    built = files.build_details(judged.unionAll(judged.filter("doc_id % 3 = 0")))
    path = _one(built, F.to_json(F.map_from_entries(F.collect_list(F.struct("query_id", F.struct(F.col("positives").cast("array<string>").alias("positives")))))))
    got = files.dataset_details(spark, path)
    return got.select("query_id", F.col("num_positives").cast("long").alias("num_positives"), F.array_min(F.transform("positives", lambda x: x.cast("long"))).cast("string").alias("first"))


def _results(spark: SparkSession, sf_dir: str) -> str:
    """Result files in folders of trials and cutoff types, with repeats of a query in a file."""
    path = _folder(spark)
    n = table(spark, sf_dir, "nation").join(F.broadcast(spark.createDataFrame(pa.table({"t": [1, 2]}))))
    row = F.struct(
        F.concat(F.lit("Q"), F.col("n_nationkey").cast("string")).alias("query_id"), (F.col("n_nationkey") * 5).alias("num_positive"), (F.col("n_regionkey") / 10).alias("pubmed_precision"),
        (F.col("n_nationkey") / 50).alias("pubmed_recall"), F.lit("(a OR b) NOT c").alias("pubmed_query"),
        F.struct(F.lit(1).alias("paths"), F.lit(2.0).alias("avg_path_len"), F.lit(0).alias("ANDs"), F.lit(1).alias("NOTs"), F.lit(1).alias("added_ORs"), F.lit(0).alias("synonym_ORs"), F.lit(0).alias("ORs")).alias("query_size"),
    )
    rows = n.select(F.to_json(row).alias("value"), "t")
    for t, kind in ((1, "cosine"), (2, "fixed")):
        folder = f"{path}/n{t}/ktype={kind},x=1"
        own = rows.filter(F.col("t") == t).select("value").coalesce(1)
        _named(spark, own.unionAll(own).coalesce(1), folder, "qg_results.jsonl")
        _named(spark, spark.range(1).select(F.lit('{"betas": {"3.0": 1}}' if t == 1 else '{"betas": {"3.0": 1, "50.0": 2}}').alias("value")), folder, "qg_meta_data.json")
    return path


def _named(spark: SparkSession, rows: DataFrame, folder: str, name: str) -> None:
    """One text file of a certain name."""
    part = _folder(spark)
    rows.coalesce(1).write.text(part)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    for f in fs.globStatus(path(f"{part}/part-*")):
        fs.rename(f.getPath(), path(f"{folder}/{name}"))


_SQL_RESULTS = "q AS (SELECT 'Q' || n_nationkey AS query_id, n_nationkey * 5 AS num_positive, n_regionkey / 10 AS p, n_nationkey / 50 AS r, t FROM nation, (VALUES (1), (2)) AS x(t))"


@query(f"WITH {_SQL_RESULTS} SELECT query_id, num_positive, t AS trial, CASE t WHEN 1 THEN 'cosine' ELSE 'fixed' END AS k_type FROM q WHERE num_positive >= 50 AND t = 2")
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows below a folder, the first of each query and file, of runs for certain betas with enough positives."""
    rows = files.read_results(spark, _results(spark, sf_dir), min_positive=50, betas=[3.0, 50.0], k_types=["fixed", "cosine"])
    return rows.select("query_id", F.col("num_positive").cast("int").alias("num_positive"), "trial", "k_type")


@query(f"WITH {_SQL_RESULTS} SELECT t AS trial, count(*) AS n, round(avg(p), 6) AS p, round(avg(r), 6) AS r FROM q GROUP BY t")
def result_run_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of each result file."""
    means = files.run_means(files.read_results(spark, _results(spark, sf_dir)), ["pubmed_precision", "pubmed_recall"])
    return means.select(F.regexp_extract("file", "/n([0-9]+)/", 1).cast("int").alias("trial"), "n", r6("pubmed_precision_mean").alias("p"), r6("pubmed_recall_mean").alias("r"))


@query(f"""WITH {_SQL_RESULTS} SELECT query_id, t AS trial, 2 AS logical_operators, CASE WHEN num_positive < 50 THEN '<50' ELSE '>=50' END AS num_positive_bucket,
round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM q""")
def result_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is derived from result rows, with the operators of the string held against the size record."""
    rows = reports.derived(files.read_results(spark, _results(spark, sf_dir)))
    return rows.select("query_id", "trial", "logical_operators", "num_positive_bucket", r6("f1").alias("f1"))


@query("SELECT r_name AS paper, 'Q' || n_nationkey AS query_id, n_name || ' OR x' AS query FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def example_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The examples of one paper, from one JSON object."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    each = n.groupBy("r_name").agg(F.collect_list(F.struct(F.concat(F.lit("Q"), F.col("n_nationkey").cast("string")).alias("query_id"), F.concat("n_name", F.lit(" OR x")).alias("query"))).alias("examples"))
    path = _one(each, F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", F.struct("examples"))))))
    return files.examples(spark, path, "ASIA").select("paper", "query_id", "query")


_ZIP_SQL = "SELECT 'EP-' || s_suppkey || '-A1' AS id, s_name AS title, 'One. Two.' AS abstract, 'A61K 31/' || s_nationkey AS symbol, s_name || ' Corp' AS applicant, s_suppkey % 2 = 0 AS inventive FROM supplier"


def _patents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as documents of the exchange dialect, in archives in archives."""
    s = table(spark, sf_dir, "supplier")
    body = F.concat(
        F.lit('<exch:exchange-document country="EP" kind="A1" date-publ="20200101" doc-number="'), F.col("s_suppkey").cast("string"), F.lit('"><exch:bibliographic-data><patent-classification><classification-symbol>A61K 31/'),
        F.col("s_nationkey").cast("string"), F.lit("</classification-symbol><classification-value>"), F.when(F.col("s_suppkey") % 2 == 0, "I").otherwise("A"),
        F.lit("</classification-value></patent-classification><applicants><applicant sequence=\"1\"><applicant-name><name>"), "s_name",
        F.lit(" &corp;</name></applicant-name></applicant></applicants><invention-title lang=\"en\">"), "s_name",
        F.lit("</invention-title></exch:bibliographic-data><abstract lang=\"en\"><p>One.</p><p>Two.</p></abstract></exch:exchange-document>"),
    )
    path = _folder(spark)

    def zipped(batches):  # type: ignore[no-untyped-def]
        import io
        import zipfile

        def archive(members: list[tuple[str, bytes]]) -> bytes:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                for name, data in members:
                    z.writestr(name, data)
            return out.getvalue()

        for batch in batches:
            docs = batch.column("xml").to_pylist()
            inner = archive([(f"d{i}.xml", f'<exch:exchange-documents xmlns:exch="http://x">{x}</exch:exchange-documents>'.encode()) for i, x in enumerate(docs)])
            yield pa.RecordBatch.from_arrays([pa.array([archive([("DOC/inner.zip", inner), ("DOC/toc.xml", b"<toc/>"), ("DTD/a.dtd", b'<!ENTITY corp "Corp">')])], pa.binary())], ["zip"])

    made = s.select(body.alias("xml")).repartition("xml").mapInArrow(zipped, "zip binary")
    made.withColumn("n", F.spark_partition_id()).select(F.regexp_replace(F.base64("zip"), "\\s", "").alias("value"), "n").write.partitionBy("n").text(path)
    # a text sink holds the archives as base64, a line each: a partition of several batches has several; the source reads the bytes
    rows = spark.read.text(path).select(F.unbase64("value").alias("content"), F.concat(F.lit("a"), F.col("n").cast("string"), F.lit(".zip")).alias("path"))
    return patents.documents(patents.members(rows))


@query(_ZIP_SQL)
def patent_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of archives in archives, entities resolved, parsed to records."""
    d = _patents(spark, sf_dir)
    return d.select("id", F.col("titles")[0]["text"].alias("title"), F.col("abstracts")[0]["text"].alias("abstract"), F.col("cpc")[0]["symbol"].alias("symbol"), F.col("applicants")[0]["name"].alias("applicant"), F.col("cpc")[0]["is_inventive"].alias("inventive"))


@query(f"SELECT id, id || ' ' || title || ' One. Two. ' || applicant || ' ' || symbol AS text FROM ({_ZIP_SQL})")
def patent_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of a document in a fixed order."""
    return _patents(spark, sf_dir).select("id", patents.full_text().alias("text"))


@query("SELECT 'http://x/' || p_brand || chr(10) || '  out=' || p_name || chr(10) || '  checksum=sha-1=' || p_size AS value, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY 1")
def download_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a download list, of some deliveries."""
    p = table(spark, sf_dir, "part")
    file = F.struct(F.col("p_name").alias("name"), F.concat(F.lit("http://x/"), "p_brand").alias("url"), F.col("p_size").cast("string").alias("checksum"))
    items = p.groupBy((F.col("p_partkey") % 2).cast("int").alias("id")).agg(F.collect_list(file).alias("files")).agg(F.collect_list(F.struct("id", "files")).alias("items"))
    return files.manifest(items, [0]).groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'title ' || o_orderkey AS title FROM orders")
def fetched_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by id in batches, from a client."""
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"))
    return search.fetch(ids, "boolsieve.sources.search:EchoClient", "doc_id string, title string", 100)


@query("SELECT c_custkey AS id, c_custkey * c_custkey AS square FROM customer")
def appended_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S31 and §2.12: lines of JSON that are appended in two steps, each of which is taken up once."""
    source, done, state = (_folder(spark) for _ in range(3))
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    for part in (0, 1):
        files.append_jsonl(ids.filter(F.col("id") % 2 == part), source)
        process_new(spark, source, "id long", done, state, lambda d: d.withColumn("square", F.col("id") * F.col("id")))
    return spark.read.parquet(done).drop("batch")


@query("SELECT CAST(sum(CASE WHEN true THEN 1 ELSE 0 END) AS BIGINT) AS n, count(DISTINCT o_orderkey) AS ids FROM orders")
def work_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of some work make up the whole, each item once."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    parts = [analytics.work_share(o, "o_orderkey", 3, k) for k in range(3)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("ids"))


@query("SELECT lang, count(*) AS n, CAST(sum(CASE WHEN length(coalesce(text, '')) > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS unit FROM documents GROUP BY lang")
def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of texts by an encoder that needs no model: each text with words has one of length one."""
    docs = table(spark, sf_dir, "documents")
    v = embedding.embed(docs, embedding.hashed_words(512)).select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 3).alias("l"))
    return v.join(docs.select(F.col("doc_id").cast("string"), "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("l").alias("unit"))


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, shards.Shards, list[str], trees.Node]:
    docs = learn.weighted(labels(spark, sf_dir), None)
    names = ["trash", "clown", "worthless", "idiot", "moron", "stupid"]
    numbers = spark.createDataFrame([(t, i) for i, t in enumerate(names)], "term string, term_id int")
    post = postings(spark, sf_dir).join(F.broadcast(numbers), "term").select("doc_id", "term_id")
    held = shards.build(post, docs, len(names))
    return docs, held, names, trees.Node(0, 0, 0.1, [0, 1], trees.Node(0, 0, 0.9), trees.Node(0, 0, 0.1, [3, 4], trees.Node(0, 0, 0.8), trees.Node(0, 0, 0.05)))


_SQL_HITS = f"""{SQL_POST}, {SQL_LAB}, t AS (SELECT doc_id, bool_or(term IN ('trash', 'clown')) AS a, bool_or(term IN ('idiot', 'moron')) AS b FROM post GROUP BY doc_id),
h AS (SELECT lab.doc_id, y, coalesce(a, false) AS a, coalesce(b, false) AS b FROM lab LEFT JOIN t USING (doc_id) WHERE y IS NOT NULL),
l AS (SELECT CASE WHEN a THEN 0.9 WHEN b THEN 0.8 ELSE 0.0 END AS share, count(*) AS n, sum(y) AS n1 FROM h GROUP BY 1)"""


@query(f"WITH {_SQL_HITS} SELECT CAST(share AS DOUBLE) AS share, n, CAST(n1 AS BIGINT) AS n1 FROM l")
def tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents and relevant ones of each leaf of a tree, summed over the shards of a matrix."""
    _, held, _, tree = _tree(spark, sf_dir)
    return spark.createDataFrame([x for x in trees.leaf_counts(held, {0: tree})[0] if x[1]], "share double, n long, n1 long")


@query(f"""WITH {_SQL_HITS}, c AS (SELECT x.share, sum(l.n1) AS tp, sum(l.n) AS n FROM l x JOIN l ON l.share >= x.share WHERE x.share > 0 GROUP BY 1),
m AS (SELECT share, 2.0 * tp / (n + (SELECT sum(n1) FROM l)) AS f FROM c)
SELECT CAST(arg_max(share, struct_pack(f := f, s := -share)) AS DOUBLE) AS threshold, round(max(f), 6) AS f1, '((trash OR clown))' IS NOT NULL AS ruled FROM m""")
def tree_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of the best F1; the tree comes back from its rows and its text, and its paths are rules."""
    _, held, names, tree = _tree(spark, sf_dir)
    same = trees.from_rows(trees.to_rows(tree)) == tree and trees.from_json(trees.to_json(tree)) == tree and "any of trash, clown" in trees.describe(tree, names)
    limit, f1 = trees.threshold_of(trees.leaf_counts(held, {0: tree})[0])
    both = trees.paths(tree, 0.5) == {rule([((0, 1), True)]), rule([((0, 1), False), ((3, 4), True)])}
    return spark.createDataFrame([(limit, round(f1, 6), same and both)], "threshold double, f1 double, ruled boolean")


_SQL_ROOT = f"""WITH {SQL_POST}, {SQL_LAB}, d AS (SELECT * FROM lab WHERE y IS NOT NULL), n AS (SELECT count(*)::DOUBLE AS n, sum(y)::DOUBLE AS n1 FROM d),
s AS (SELECT term, count(*)::DOUBLE AS l, sum(y)::DOUBLE AS l1 FROM post JOIN d USING (doc_id) GROUP BY term HAVING count(*) BETWEEN 3 AND 0.5 * (SELECT n FROM n)),
g AS (SELECT term, l, l1, n, n1, (l * 2 * (l1 / l) * (1 - l1 / l) + (n - l) * 2 * ((n1 - l1) / (n - l)) * (1 - (n1 - l1) / (n - l))) / n AS i FROM s, n WHERE l >= 3 AND n - l >= 3)
SELECT term, CAST(l AS BIGINT) AS n, CAST(l1 AS BIGINT) AS n1, round(i, 6) AS impurity FROM g ORDER BY CASE WHEN l1 / l > (n1 - l1) / (n - l) THEN 1.1 ELSE 1.0 END * (2 * n1 / n * (1 - n1 / n) - i) DESC, term LIMIT 1"""


@query(_SQL_ROOT)
def tree_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root's first term of a forest's tree that has all rows and features, from sums over shards."""
    docs = learn.weighted(labels(spark, sf_dir), None)
    own = postings(spark, sf_dir).join(docs.select("doc_id"), "doc_id", "left_semi")
    vocab = cut(vocabulary.vocabulary(own, docs.count(), 3, 0.5))
    held = shards.build(vocabulary.restrict(own, vocab), docs, vocab.count())
    tree = trees.fit_forest(held, trees.Params(max_depth=1, min_rows=3, min_share=0.0, max_or=1, class_weight=None), trees.Forest(n_trees=1))[0]
    term = vocab.filter(F.col("term_id") == tree.features[0]).first()["term"]
    left, n, n1 = tree.left, tree.n0 + tree.n1, tree.n1
    impurity = trees.impurity(np.array([100.0 * (left.n0 + left.n1)]), np.array([100.0 * left.n1]), 100.0 * n, 100.0 * n1)[0]
    return spark.createDataFrame([(term, left.n0 + left.n1, left.n1, round(float(impurity), 6))], "term string, n long, n1 long, impurity double")


_SQL_RULES = f"""{SQL_POST}, {SQL_LAB}, t AS (SELECT doc_id, bool_or(term = 'trash') AS a, bool_or(term = 'clown') AS b, bool_or(term = 'idiot') AS c FROM post GROUP BY doc_id),
h AS (SELECT y, coalesce(a, false) AS a, coalesce(b, false) AS b, coalesce(c, false) AS c FROM lab LEFT JOIN t USING (doc_id) WHERE y IS NOT NULL)"""


@query(f"""WITH {_SQL_RULES}, r AS (SELECT 0 AS rule, y FROM h WHERE a OR b UNION ALL SELECT 1, y FROM h WHERE (a OR b) AND NOT c UNION ALL SELECT 2, y FROM h WHERE c)
SELECT x.rule, count(y) AS returned, coalesce(sum(y), 0)::BIGINT AS tp FROM (VALUES (0), (1), (2)) AS x(rule) LEFT JOIN r ON r.rule = x.rule GROUP BY 1""")
def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rules return and find, counted together over the shards."""
    _, held, _, _ = _tree(spark, sf_dir)
    own = [rule([((0, 1), True)]), rule([((0, 1), True), ((3,), False)]), rule([((3,), True)])]
    scores = rules.Scores(held, 1.0)
    scores.ask(own)
    return spark.createDataFrame([(i, scores.of(r)["returned"], scores.of(r)["tp"]) for i, r in enumerate(own)], "rule int, returned long, tp long")


@query(f"""WITH {_SQL_RULES}, s AS (SELECT * FROM (VALUES (true, false, false, 1.0), (false, true, false, 1.0), (false, false, true, 1.0), (true, true, false, 2.0), (true, false, true, 2.0), (false, true, true, 2.0), (true, true, true, 3.0)) AS v(ua, ub, uc, k)),
m AS (SELECT k, sum(CASE WHEN hit THEN y ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN hit THEN 1 ELSE 0 END)::DOUBLE AS n, sum(y)::DOUBLE AS p FROM (SELECT ua, ub, uc, k, y, ua AND a OR ub AND b OR uc AND c AS hit FROM s, h) GROUP BY ua, ub, uc, k)
SELECT round(max(CASE WHEN tp = 0 THEN 0 ELSE 5 * tp / (n + 4 * p) END - 0.002 * (2 * k + (k - 1) * 0)), 6) AS objective FROM m""")
def best_rule_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best set of three rules, that local search and the genetic algorithm both find."""
    _, held, _, _ = _tree(spark, sf_dir)
    own = [rule([((t,), True)]) for t in (0, 1, 3)]
    pool = rules.Pool(own, np.full(3, 2.0), [[0], [1], [2]])
    found = {round(f(held, pool, 2.0, 0.002, max_rules=3)[1], 6) for f in (rules.select_local, lambda *a, **k: rules.select_genetic(*a, size=30, rounds=10, **k))}
    return spark.createDataFrame([(v,) for v in found], "objective double")


@query(f"WITH {SQL_POST}, {SQL_LAB} SELECT term, count(*) AS n FROM post JOIN lab USING (doc_id) WHERE y = 1 AND term IN ('trash', 'clown', 'idiot') GROUP BY term")
def kept_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of several trees lose their rare terms; how often the kept ones stand in relevant documents."""
    found = {rule([(("clown", "idiot"), True), (("rare",), False)]): {0, 1}, rule([(("trash",), True)]): {1, 2}, rule([(("rare",), True)]): {3}}
    kept = sorted({f for r in rules.prune_rare(found, 4, 0.3, 0.3) for feats, _ in r for f in feats} - {"rare"})
    post = postings(spark, sf_dir).join(labels(spark, sf_dir).filter("y = 1"), "doc_id", "left_semi")
    return post.filter(F.col("term").isin(kept)).groupBy("term").agg(F.count("*").alias("n"))
