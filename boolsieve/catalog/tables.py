"""Result tables, lexicons and work lists on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boolsieve.catalog.registry import query, r6, rounded, table
from boolsieve.operators import ablation, analytics, lexicon
from boolsieve.operators.quantiles import quantile_columns
from boolsieve.plans import study
from boolsieve.sources import files


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS l_quantity_mean, round(coalesce(stddev_samp(l_quantity), 0), 6) AS l_quantity_std,
round(avg(l_discount), 6) AS l_discount_mean, round(coalesce(stddev_samp(l_discount), 0), 6) AS l_discount_std FROM lineitem GROUP BY ALL""")
def group_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analytics.group_stats(_lines(spark, sf_dir), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount"])
    return rounded(out, "l_quantity_mean", "l_quantity_std", "l_discount_mean", "l_discount_std")


@query("SELECT round(l_tax, 3) AS tax, min(l_extendedprice) AS low, round(avg(l_extendedprice), 4) AS mean, max(l_extendedprice) AS high FROM lineitem GROUP BY 1")
def spread_by_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.spread(_lines(spark, sf_dir), F.round("l_tax", 3), "tax", "l_extendedprice").withColumn("mean", F.round("mean", 4))


@query("""SELECT floor(l_quantity / 5) * 5.0 AS bin, round(avg(l_extendedprice), 4) AS mean, count(*) AS n, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
round(quantile_cont(l_extendedprice, 0.75), 4) AS p75 FROM lineitem GROUP BY 1 HAVING count(*) >= 10""")
def bin_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analytics.bin_percentiles(_lines(spark, sf_dir), "l_quantity", "l_extendedprice", 5, min_rows=10)
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "p25", "p50", "p75")})


@query("""WITH e AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM orders)
SELECT CAST(len(list_filter(e, lambda x: o_totalprice > x)) AS INTEGER) AS bucket, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM orders, e GROUP BY 1""")
def qcut_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analytics.quantile_buckets(table(spark, sf_dir, "orders"), "o_totalprice", "o_totalprice", 5)
    return out.withColumn("mean", F.round("mean", 4))


@query("SELECT l_returnflag, round(avg(l_tax - l_discount), 6) AS mean_diff, round(avg(abs(l_tax - l_discount)), 6) AS mean_abs_diff FROM lineitem GROUP BY 1")
def abs_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.mismatch(_lines(spark, sf_dir), "l_tax", "l_discount", "l_returnflag"), "mean_diff", "mean_abs_diff")


@query("""SELECT least(floor(l_quantity / 50.0 * 10), 9)::BIGINT AS xb, least(floor(l_linenumber / 50.0 * 10), 9)::BIGINT AS yb, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 AND l_linenumber BETWEEN 0 AND 50 GROUP BY ALL""")
def hist2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.histogram2d(_lines(spark, sf_dir), "l_quantity", "l_linenumber", 10, 0.0, 50.0)


@query("""SELECT l_linestatus, round(avg(CASE WHEN l_discount >= 0.02 THEN 1.0 ELSE 0.0 END) * 100, 6) AS ge_0_02, round(avg(CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END) * 100, 6) AS ge_0_05,
round(avg(CASE WHEN l_discount >= 0.09 THEN 1.0 ELSE 0.0 END) * 100, 6) AS ge_0_09 FROM lineitem GROUP BY 1""")
def pct_over_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.percent_over(_lines(spark, sf_dir), "l_discount", [0.02, 0.05, 0.09], "l_linestatus"), "ge_0_02", "ge_0_05", "ge_0_09")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return analytics.first_rows(rows, ["user_id", "event_type"], ["event_id"])


@query("""SELECT 'price' AS measure, 'best' AS side, o_orderkey AS id, o_totalprice AS value FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)
UNION ALL SELECT 'price', 'worst', o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1)
UNION ALL SELECT 'customer', 'best', o_orderkey, o_custkey::DOUBLE FROM (SELECT * FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 1)
UNION ALL SELECT 'customer', 'worst', o_orderkey, o_custkey::DOUBLE FROM (SELECT * FROM orders ORDER BY o_custkey, o_orderkey LIMIT 1)""")
def best_worst_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.best_and_worst(table(spark, sf_dir, "orders"), {"price": "o_totalprice", "customer": "o_custkey"}, "o_orderkey")


@query("WITH m AS (SELECT avg(s_acctbal) AS mean FROM supplier) SELECT s_suppkey, s_acctbal, round(mean, 4) AS mean FROM supplier, m ORDER BY abs(s_acctbal - mean), s_suppkey LIMIT 1")
def closest_to_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.closest_to_average(table(spark, sf_dir, "supplier"), "s_acctbal", "s_suppkey").withColumn("mean", F.round("mean", 4))


@query("WITH w AS (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY max(o_totalprice) - min(o_totalprice) DESC, 1 LIMIT 1) SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT o_custkey FROM w)")
def max_spread_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return analytics.widest_group(rows, "o_custkey", "o_totalprice").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT user_id, event_id, CAST(floor(avg(value) OVER (PARTITION BY user_id ORDER BY event_id) * 1000000 + 0.3) AS BIGINT) AS running FROM events")
def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    means = analytics.running_mean(rows, "user_id", "event_id", "value").drop("value")
    return means.withColumn("running", F.floor(F.col("running") * 1000000 + 0.3))  # millionths; 0.3: away from ties


@query("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _lines(spark, sf_dir).filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return analytics.open_work(table(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("""SELECT n_name AS topic, params, trial FROM nation, (VALUES ('base'), ('no_ors')) p(params), (SELECT unnest(range(3))::INTEGER AS trial) WHERE NOT (n_name LIKE 'NATION_1%' AND params = 'base')
AND NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey = trial AND params = 'no_ors' AND n_regionkey = r_regionkey)""")
def work_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = table(spark, sf_dir, "nation").select(F.col("n_name").alias("topic"), "n_regionkey")
    grid = topics.crossJoin(spark.createDataFrame([("base",), ("no_ors",)], "params string")).crossJoin(spark.createDataFrame([(0,), (1,), (2,)], "trial int"))
    first = grid.filter("topic like 'NATION_1%' and params = 'base'").select("topic", "params", "trial")
    second = grid.filter("params = 'no_ors' and n_regionkey = trial").select("topic", "params", "trial")
    return analytics.open_work(grid.drop("n_regionkey"), first.unionByName(second), ["topic", "params", "trial"])


@query("""SELECT o_orderkey, FALSE AS outlier FROM orders WHERE NOT (o_totalprice = 0 OR o_totalprice > 400000) UNION ALL SELECT o_orderkey, TRUE FROM orders WHERE o_totalprice = 0 OR o_totalprice > 400000""")
def outlier_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, odd = analytics.split_outliers(table(spark, sf_dir, "orders"), "o_totalprice", 400_000)
    return kept.select("o_orderkey", F.lit(False).alias("outlier")).unionByName(odd.select("o_orderkey", F.lit(True).alias("outlier")))


@query("""SELECT value, n, round(100.0 * n / (SELECT count(*) FROM documents), 6) AS pct FROM (SELECT source AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 20)""")
def terms_agg_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.term_counts(table(spark, sf_dir, "documents"), "source", 20), "pct")


@query("""WITH s AS (SELECT strlen(text)::DOUBLE AS s FROM documents), e AS (SELECT min(s) AS lo, max(s) AS hi FROM s)
SELECT least(floor((s - lo) / ((hi - lo) / 20)), 19)::BIGINT AS bin, count(*) AS n, round(min(lo + least(floor((s - lo) / ((hi - lo) / 20)), 19) * ((hi - lo) / 20)), 4) AS lo FROM s, e GROUP BY 1""")
def field_size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.size_histogram(table(spark, sf_dir, "documents"), F.octet_length("text"), 20).withColumn("lo", F.round("lo", 4))


@query("SELECT count(*) AS n, round(avg(strlen(text)), 4) AS mean_size, round(avg(strlen(text)) * 100000000, 0) AS at_target FROM documents")
def extrapolated_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analytics.extrapolated_size(table(spark, sf_dir, "documents"), F.octet_length("text"), 100_000_000)
    return out.withColumn("mean_size", F.round("mean_size", 4)).withColumn("at_target", F.round("at_target", 0))


@query("""SELECT lang, count(*) AS n, count(text) AS with_text, CAST(count(*) FILTER (text LIKE '%' || chr(10) || '%') AS BIGINT) AS with_lines, CAST(count(*) FILTER (length(text) < 20) AS BIGINT) AS nearly_empty FROM documents GROUP BY lang""")
def exists_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count("text").alias("with_text"), n(F.contains("text", F.lit("\n"))).alias("with_lines"), n(F.length("text") < 20).alias("nearly_empty"))


@query("""WITH x AS (SELECT lang, source, toxic FROM documents JOIN labels USING (doc_id)), e AS (SELECT lang, source, sum(toxic)::DOUBLE AS p, sum(1 - toxic)::DOUBLE AS q FROM x GROUP BY ALL)
SELECT lang, count(*) AS n, round(avg(p), 6) AS p_mean, round(avg(q), 6) AS q_mean FROM e GROUP BY ROLLUP (lang)""")
def dataset_macro_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    each = rows.groupBy("lang", "source").agg(F.sum("toxic").cast("double").alias("p"), F.sum(1 - F.col("toxic")).cast("double").alias("q"))
    return rounded(analytics.rollup_means(each, "lang", ["p", "q"]), "p_mean", "q_mean")


@query("SELECT event_type, min(value) AS low, round(avg(value), 6) AS mean, max(value) AS high, round(quantile_cont(value, 0.5), 6) AS median FROM events WHERE value > 1 GROUP BY 1")
def run_time_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter("value > 1").select("event_type", "value")
    stats = rows.groupBy("event_type").agg(F.min("value").alias("low"), r6(F.avg("value")).alias("mean"), F.max("value").alias("high"))
    return stats.join(rounded(quantile_columns(rows, ["event_type"], "value", {"median": 0.5}), "median"), "event_type")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_type FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) > 50")
def props_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), "event_type")
    return rows.filter("k > 50")


@query("""WITH d AS (SELECT datediff('day', DATE '1970-01-01', ts::DATE) AS day, count(*) AS n FROM events GROUP BY 1), w AS (SELECT day, n, sum(n) OVER (ORDER BY day DESC) AS upto FROM d)
SELECT count(*) AS days, CAST(sum(n) AS BIGINT) AS events FROM w""")
def date_window_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.datediff(F.to_date("ts"), F.lit("1970-01-01")).alias("day")).agg(F.count("*").alias("n"))
    n = [(r["day"], r["n"]) for r in days.collect()]  # a row a day
    windows = ablation.date_windows(n, 900, 1000, 5) if n else []
    plan = F.broadcast(spark.createDataFrame(windows, "first int, last int, rows long"))
    read = days.join(plan, F.col("day").between(F.col("first"), F.col("last")))
    return read.agg(F.count("*").alias("days"), F.sum("n").alias("events"))


@query("""WITH l AS (SELECT n_name AS query_id, CASE WHEN n_nationkey % 4 = 0 THEN 'tar2018_test' WHEN n_nationkey % 4 = 1 THEN 'sigir2017' WHEN n_nationkey % 4 = 2 THEN 'sr_updates' ELSE 'other' END AS list FROM nation
UNION ALL SELECT n_name, 'sr_updates' FROM nation WHERE n_nationkey % 8 = 0)
SELECT n_name AS query_id, coalesce((SELECT CASE min(CASE list WHEN 'tar2018_test' THEN 0 WHEN 'sigir2017' THEN 1 WHEN 'sr_updates' THEN 2 END) WHEN 0 THEN 'tar2019' WHEN 1 THEN 'sigir2017' WHEN 2 THEN 'sr_updates' END FROM l WHERE query_id = n_name), 'unknown') AS dataset FROM nation""")
def dataset_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey") % 4
    kind = F.when(k == 0, "tar2018_test").when(k == 1, "sigir2017").when(k == 2, "sr_updates").otherwise("other")
    lists = nation.select(F.col("n_name").alias("query_id"), kind.alias("list")).unionByName(nation.filter("n_nationkey % 8 = 0").select(F.col("n_name").alias("query_id"), F.lit("sr_updates").alias("list")))
    return files.routed(nation.select(F.col("n_name").alias("query_id")), lists)


@query("""SELECT path, regexp_extract(path, 'ktype=(cosine|pos_count|fixed)', 1) AS k_type, CAST(regexp_extract(path, '/n([0-9]+)/', 1) AS INTEGER) AS trial
FROM (SELECT 'run/beta=3/n' || n_nationkey || '/ktype=' || ['cosine', 'pos_count', 'fixed'][n_nationkey % 3 + 1] || ',x=1/qg_results.jsonl' AS path FROM nation)""")
def path_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(F.lit("cosine"), F.lit("pos_count"), F.lit("fixed"))
    path = F.concat(F.lit("run/beta=3/n"), F.col("n_nationkey"), F.lit("/ktype="), kinds[F.col("n_nationkey") % 3], F.lit(",x=1/qg_results.jsonl"))
    rows = table(spark, sf_dir, "nation").select(path.alias("path"))
    return rows.select("path", files.k_type(F.col("path")).alias("k_type"), F.regexp_extract("path", r"/n(\d+)/", 1).cast("int").alias("trial"))


@query("SELECT l_linenumber, count(*) AS actual, 8000::BIGINT AS expected FROM lineitem GROUP BY 1 HAVING count(*) <> 8000")
def sample_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    expected = rows.select("l_linenumber").distinct().withColumn("expected", F.lit(8000).cast("long"))
    return analytics.sample_audit(rows, ["l_linenumber"], expected)


@query("""SELECT id, min(name) AS name FROM (SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier) GROUP BY id""")
def union_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    both = a.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
    return analytics.first_rows(both, ["id"], ["name"])


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def upsert_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return files.upsert(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"), "user_id", "event_id")


@query("""WITH m AS (SELECT l_returnflag || l_linestatus AS file, avg(l_discount * 10) AS p, avg(l_tax * 10) AS r FROM lineitem WHERE l_quantity >= 10 GROUP BY 1)
SELECT file, round(p, 6) AS precision, round(r, 6) AS recall, round(2501.0 * p * r / (2500 * p + r), 6) AS f FROM m ORDER BY f DESC, file LIMIT 1""")
def best_run_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select(F.concat("l_returnflag", "l_linestatus").alias("file"), F.col("l_quantity").alias("num_positive"), (F.col("l_discount") * 10).alias("precision"), (F.col("l_tax") * 10).alias("recall"))
    return rounded(study.best_run(rows, 50.0, 10), "precision", "recall", "f")


@query("""WITH t AS (SELECT r_name AS name, 'R' || r_regionkey AS number FROM region UNION ALL SELECT n_name, 'R' || n_regionkey || '.N' || n_nationkey FROM nation UNION ALL SELECT c_name, 'R' || n_regionkey || '.N' || n_nationkey || '.C' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey),
p AS (SELECT name, unnest(list_transform(range(1, len(string_split(number, '.'))), lambda i: array_to_string(string_split(number, '.')[1:i], '.'))) AS number FROM t)
SELECT p.name, t.name AS ancestor FROM p JOIN t USING (number) UNION SELECT name, name FROM t""")
def hierarchy_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    number = F.concat(F.lit("R"), F.col("n_regionkey"), F.lit(".N"), F.col("n_nationkey"))
    customers = table(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    rows = region.select(F.col("r_name").alias("name"), F.concat(F.lit("R"), F.col("r_regionkey")).alias("number"))
    rows = rows.union(nation.select("n_name", number)).union(customers.select("c_name", F.concat(number, F.lit(".C"), F.col("c_custkey"))))
    return lexicon.ancestors(rows.select("name", F.array("number").alias("tree_numbers")))


@query("""WITH w AS (SELECT lang AS lemma, source AS form FROM documents), r AS (SELECT CASE lemma WHEN 'fr' THEN 'es' ELSE lemma END AS lemma, form FROM w)
SELECT lemma, array_to_string(list_sort(list(DISTINCT form)), ' ') AS forms FROM r GROUP BY lemma""")
def global_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = table(spark, sf_dir, "documents").select(F.col("lang").alias("lemma"), F.array("source").alias("forms"))
    out = lexicon.global_lexicon(forms, spark.createDataFrame([("fr", "es")], "word string, target string"))
    return out.select("lemma", F.array_join("forms", " ").alias("forms"))


@query("""SELECT DISTINCT doc_id, CASE lang WHEN 'fr' THEN 'roman' WHEN 'es' THEN 'roman' ELSE lang END AS term FROM documents UNION SELECT doc_id, '"' || lang || '"[mh]' FROM documents""")
def term_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    post = docs.select("doc_id", F.col("lang").alias("term")).union(docs.select("doc_id", F.concat(F.lit('"'), "lang", F.lit('"[mh]'))))
    return lexicon.remap_terms(post, spark.createDataFrame([("fr", "roman"), ("es", "roman"), ('"fr"[mh]', "wrong")], "word string, target string"))
