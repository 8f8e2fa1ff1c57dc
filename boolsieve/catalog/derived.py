"""Queries whose rules, query strings, trials and related words are made of the test tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boolsieve.catalog.registry import query, r6, rounded, table
from boolsieve.catalog.search import SQL_RANK, _queries, _vectors
from boolsieve.functions import boolean, strategies, text
from boolsieve.functions.rules import COSTS, RULE_TYPE, cost_column, mean_literal_length, render, rule, size_columns
from boolsieve.operators import analytics, coverage, lexicon, ranking
from boolsieve.plans import learn, reports, study, trees
from boolsieve.session import cut


def _mapped(rows: DataFrame, f: Callable[..., tuple], schema: str) -> DataFrame:
    """A row for each row, made by a function of its values."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([f(*r) for r in b.itertuples(index=False)], columns=names, dtype=object)

    return rows.mapInPandas(run, schema)


_N, _R = "lower(replace(n_name, '_', ''))", "lower(replace(r_name, ' ', ''))"
_SQL_NATIONS = f"nr AS (SELECT n_nationkey AS k, {_N} AS n, {_R} AS r, n_regionkey AS rk FROM nation JOIN region ON r_regionkey = n_regionkey)"
_SQL_RULES = f"{_SQL_NATIONS}, rg AS (SELECT rk::BIGINT AS rule_id, r AS region, list_sort(list(n)) AS nations FROM nr GROUP BY rk, r)"


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, n, r, rk): nations and their regions as words."""
    both = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # a row a region
    return both.select(F.col("n_nationkey").alias("k"), F.lower(F.replace("n_name", F.lit("_"), F.lit(""))).alias("n"), F.lower(F.replace("r_name", F.lit(" "), F.lit(""))).alias("r"), F.col("n_regionkey").alias("rk"))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule_id, region, rule): for each region any of its nations and not its own name."""
    by = _nations(spark, sf_dir).groupBy(F.col("rk").cast("long").alias("rule_id"), F.col("r").alias("region")).agg(F.array_sort(F.collect_list("n")).alias("nations"))
    literals = F.array(F.struct(F.col("nations").alias("feats"), F.lit(True).alias("pos")), F.struct(F.array("region").alias("feats"), F.lit(False).alias("pos")))
    return by.select("rule_id", "region", literals.cast(RULE_TYPE).alias("rule"))


def _as_rule(value: list) -> tuple:
    return rule([(tuple(x["feats"]), bool(x["pos"])) for x in value])


@query(f"""WITH {_SQL_RULES} SELECT region AS name, CASE WHEN len(nations) > 1 THEN '((' || array_to_string(nations, ' OR ') || ') NOT ' ELSE '(' || nations[1] || ' NOT ' END || region || '[tiab])' AS query,
1 AS paths, 0 AS ands, 1 AS nots, 0 AS ors, CAST(len(nations) - 1 AS INTEGER) AS added, round((len(nations) + 1) / 2.0::DOUBLE, 6) AS mean_literal FROM rg""")
def rendered_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as strings, with their size, and the mean length of their literals."""

    def shown(name: str, own: list, mean: float) -> tuple:
        string, size = render([_as_rule(own)])
        return name, string, size["paths"], size["ANDs"], size["NOTs"], size["ORs"], size["added_ORs"], mean

    rows = _rules(spark, sf_dir).select("region", "rule", r6(mean_literal_length(F.array("rule"))).alias("mean"))
    return _mapped(rows, shown, "name string, query string, paths int, ands int, nots int, ors int, added int, mean_literal double")


@query(f"""WITH {_SQL_NATIONS}, q AS (SELECT k % 4 AS kind, CASE k % 4 WHEN 0 THEN n || ' AND ' || r WHEN 1 THEN n || ' OR OR ' || r WHEN 2 THEN '(' || n || ' OR ' || r || ') NOT x' ELSE '(' || n END AS query FROM nr)
SELECT query, kind IN (0, 2) AS valid, CASE WHEN kind IN (0, 2) THEN query END AS canonical, CASE kind WHEN 0 THEN 1 WHEN 2 THEN 0 END AS ands, CASE kind WHEN 0 THEN 0 WHEN 2 THEN 1 END AS ors, CASE kind WHEN 0 THEN 0 WHEN 2 THEN 1 END AS nots FROM q""")
def checked_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which strings are queries, and the operators of those."""

    def checked(k: int, n: str, r: str) -> tuple:
        q = (f"{n} AND {r}", f"{n} OR OR {r}", f"({n} OR {r}) NOT x", f"({n}")[k % 4]
        ok = boolean.is_valid(q)
        ops = boolean.counts(boolean.parse(q)) if ok else {}
        return q, ok, str(boolean.parse(q)) if ok else None, ops.get("AND"), ops.get("OR"), ops.get("NOT")

    return _mapped(_nations(spark, sf_dir).select("k", "n", "r"), checked, "query string, valid boolean, canonical string, ands int, ors int, nots int")


@query(f"""WITH {_SQL_NATIONS} SELECT '(' || n || ' OR ' || r || ') NOT x' AS query, '(**' || n || '** OR ' || r || ') NOT x' AS marked, '(' || n || ' (' || (k + 12) || ') OR ' || r || ' (1.5k)) NOT x' AS counted,
'(' || n || ' OR ' || r || ') \\textbf{{NOT}} x' AS latex FROM nr""")
def marked_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """queries with marks, with the counts of their terms, and in LaTeX."""

    def marked(k: int, n: str, r: str) -> tuple:
        q = f"({n} OR {r}) NOT x"
        return q, reports.highlight(q, {n}), reports.annotated(q, {n: k + 12, r: 1500}), reports.latex(q, {"NOT"})

    return _mapped(_nations(spark, sf_dir).select("k", "n", "r"), marked, "query string, marked string, counted string, latex string")


@query(f"""WITH {_SQL_NATIONS} SELECT q, words, kind <> 1 AS valid, CASE kind WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS n_ops FROM (SELECT k % 3 AS kind, CASE k % 3 WHEN 0 THEN '(' || n || ' OR ' || r || ') AND "x y"[mh] NOT z[tiab]'
WHEN 1 THEN n || ' AND (' || r || ' OR' ELSE n || ' ' || r || ' OR c' END AS q, CASE k % 3 WHEN 0 THEN n || ';' || r || ';x y;z' WHEN 1 THEN n || ';' || r || ' OR' ELSE n || ' ' || r || ';c' END AS words FROM nr)""")
def query_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the words of queries without their tags, and their operators."""
    k, n, r = F.col("k") % 3, F.col("n"), F.col("r")
    q = F.when(k == 0, F.format_string('(%s OR %s) AND "x y"[mh] NOT z[tiab]', n, r)).when(k == 1, F.format_string("%s AND (%s OR", n, r)).otherwise(F.format_string("%s %s OR c", n, r))
    rows = _mapped(_nations(spark, sf_dir).select(q.alias("q")), lambda s: (s, boolean.is_valid(s)), "q string, valid boolean")
    return rows.select("q", F.array_join(text.query_words(text.strip_tags(F.col("q"))), ";").alias("words"), "valid", text.number_of_operators(F.col("q")).cast("int").alias("n_ops"))


@query("""SELECT r_name || '/' || n_name || '/*' || n_name || ' & law' AS heading, lower(r_name) || ';' || lower(r_name) || '/' || lower(n_name) || ';' || lower(r_name) || '/' || lower(n_name) || ' and law' AS expanded,
lower(r_name) || '/' || lower(n_name) || '/*' || lower(n_name) || ' & law' AS stripped FROM nation JOIN region ON r_regionkey = n_regionkey""")
def heading_notation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """headings with qualifiers as the headings that they stand for."""
    both = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # a row a region
    rows = both.select(F.concat("r_name", F.lit("/"), "n_name", F.lit("/*"), "n_name", F.lit(" & law")).alias("heading"))
    return rows.select("heading", F.array_join(text.expand_heading(F.col("heading")), ";").alias("expanded"), text.strip_heading(F.col("heading")).alias("stripped"))


_COST = " + ".join(f'{float(w)!r}::DOUBLE * "{k}"' for k, w in COSTS.items() if k != "avg_path_len")
_COST += f" + {float(COSTS['avg_path_len'])!r}::DOUBLE * avg_path_len" if "avg_path_len" in COSTS else ""


@query(f"""WITH {_SQL_RULES}, s AS (SELECT rule_id % 2 AS id, count(*) AS paths, 2.0::DOUBLE AS avg_path_len, 0::BIGINT AS "ANDs", count(*) AS "NOTs", CAST(sum(len(nations) - 1) AS BIGINT) AS "added_ORs", count(*) - 1 AS "ORs" FROM rg GROUP BY 1)
SELECT *, round({_COST}, 6) AS cost FROM s""")
def query_size_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and cost of the queries that the regions' rules make."""
    grouped = _rules(spark, sf_dir).groupBy((F.col("rule_id") % 2).alias("id")).agg(F.collect_list("rule").alias("rules"))
    size = size_columns(F.col("rules"))
    return grouped.select("id", *[c.alias(k) for k, c in size.items()], r6(cost_column(size)).alias("cost"))


@query(f"""WITH {_SQL_RULES}, o AS (SELECT *, unnest(nations) AS gone FROM rg WHERE len(nations) > 1)
SELECT rule_id, 'or' AS mode, FALSE AS in_negated, gone AS removed, '+' || array_to_string(list_filter(nations, lambda x: x <> gone), '|') || ' -' || region AS variant FROM o
UNION ALL SELECT rule_id, 'and', TRUE, region, '+' || array_to_string(nations, '|') FROM rg""")
def one_step_rule_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: each rule without one of its terms, or without a literal."""
    out = coverage.one_step_variations(_rules(spark, sf_dir).select("rule_id", "rule"))
    shown = F.array_join(F.transform("variant", lambda x: F.concat(F.when(x["pos"], "+").otherwise("-"), F.array_join(x["feats"], "|"))), " ")
    return out.select("rule_id", "mode", "in_negated", F.array_join("removed", "|").alias("removed"), shown.alias("variant"))


@query(f"""WITH {_SQL_RULES}, t AS (SELECT unnest(nations || [region]) AS term, rule_id FROM rg) SELECT term, round((rule_id + 1) / 5.0::DOUBLE, 6) AS tree_freq, round(1 / (SELECT count(*) FROM rg)::DOUBLE, 6) AS rule_freq FROM t""")
def variable_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of trees and of rules that have a term; a region's rule is of as many trees as its number says."""
    rows = _rules(spark, sf_dir).select("rule_id", "rule", F.sequence(F.lit(0), F.col("rule_id").cast("int")).alias("trees"))
    return rounded(coverage.variable_frequencies(rows, 5), "tree_freq", "rule_freq")


_STATS = ", ".join(f"round(avg({c}), 6)::DOUBLE AS {n}_avg, round(coalesce(stddev_samp({c}), 0), 6) AS {n}_std, min({c}) AS {n}_min, max({c}) AS {n}_max" for n, c in (("ands", "a"), ("ors", "o"), ("nots", "t"), ("ops", "a + o + t")))


@query(f"""WITH {_SQL_NATIONS}, s AS (SELECT r AS dataset, 1 AS a, CAST(k % 9 + 2 AS INTEGER) AS o, 1 AS t FROM nr WHERE k % 6 <> 5) SELECT dataset, {_STATS} FROM s GROUP BY dataset""")
def manual_strategy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators of line searches; of every sixth nation the lines make no sense."""
    line = F.concat(F.lit("1 x or y 2 "), "n", F.lit(" near w not v 3 or/"), F.when(F.col("k") % 6 == 5, F.lit("99-")).otherwise(F.lit("1-")), (F.col("k") % 9 + 2).cast("string"), F.lit(" "))
    names = F.col("k").cast("string")
    named = F.regexp_replace(line, "nation[0-9]+", "z")  # a name's number is no line
    topics = _nations(spark, sf_dir).select(F.col("r").alias("dataset"), names.alias("query_id"), F.create_map(F.lit("MEDLINE search strategy"), named).alias("search_strategy"), "k")
    out = strategies.strategy_stats(strategies.strategy_table(topics.drop("k")))
    return rounded(out, *[c for c in out.columns if c.endswith(("_avg", "_std"))])


@query(f"""WITH {_SQL_NATIONS} SELECT k AS id, CASE k % 3 WHEN 0 THEN n || ' OR ' || r WHEN 1 THEN n || ' and ' || r END AS query FROM nr""")
def answered_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest query between the tags of an answer."""
    k, n, r = F.col("k") % 3, F.col("n"), F.col("r")
    several = F.format_string("x <answer>%s OR %s</answer> <answer>only</answer> <answer>(%s OR %s) AND %s</answer>", n, r, n, r, n)
    answer = F.when(k == 0, several).when(k == 1, F.format_string("<answer> %s and %s </answer>", n, r)).otherwise(F.format_string("none <answer>%s</answer>", n))
    return _nations(spark, sf_dir).select(F.col("k").alias("id"), strategies.answered_query(answer).alias("query"))


def _uniform_sql(name: str, seed: int = 42) -> str:
    return f"(CAST('0x' || substr(md5('{seed}:' || {name}), 1, 12) AS BIGINT)::DOUBLE / 281474976710656.0)"


@query(f"SELECT doc_id, round(2 + 8 * {_uniform_sql('doc_id', 3)}, 6) AS even, round(2 + 8 * pow({_uniform_sql('doc_id', 3)}, 3), 6) AS low FROM documents")
def drawn_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a number for each document, drawn evenly and towards the lower end."""
    digits = F.substring(F.md5(F.concat(F.lit("3:"), F.col("doc_id").cast("string")).cast("binary")), 1, 12)
    u = F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48))
    return table(spark, sf_dir, "documents").select("doc_id", r6(trees.biased_column(2, 10, 1.0, u)).alias("even"), r6(trees.biased_column(2, 10, 3.0, u)).alias("low"))


@query("""SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'tuned ' || n_nationkey ELSE n_nationkey::VARCHAR END AS value FROM nation""")
def known_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tuned values of the parameters that there are; those of others are left out."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    tuned = nation.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.concat(F.lit("tuned "), F.col("n_nationkey").cast("string")).alias("value"))
    unknown = region.select(F.col("r_name").alias("name"), F.lit("lost").alias("value"))
    return study.known_rows(nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("value")), tuned.unionByName(unknown))


@query(f"""WITH i AS (SELECT doc_id AS r, doc_id % 32 AS b FROM documents), n AS (SELECT *, CAST(floor({_uniform_sql("r || ':length'")} * 115) AS INTEGER) AS k FROM i),
w AS (SELECT r, b, list_distinct(list_filter([CASE WHEN b & 1 > 0 THEN 'bowl' END, CASE WHEN b & 2 > 0 THEN 'box' END, CASE WHEN b & 4 > 0 THEN 'cats' END, CASE WHEN b & 8 > 0 THEN 'dogs' END, CASE WHEN b & 16 > 0 THEN 'house' END],
  lambda t: t IS NOT NULL) || list_transform(range(1, k + 1), lambda j: 'r' || CAST(floor({_uniform_sql("r || ':' || j")} * 995) AS BIGINT))) AS terms FROM n)
SELECT r AS doc_id, array_to_string(list_sort(terms), ' ') AS terms, CAST((b & 12 > 0) AND (b & 3 > 0) AND b & 16 = 0 AS INTEGER) AS y FROM w""")
def synthetic_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and labels by a formula, for the ids of the documents."""
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    docs = learn.synthetic_corpus(spark, "(cats OR dogs) AND (bowl OR box) NOT house", ids=ids)
    return docs.withColumn("terms", F.array_join(F.array_sort("terms"), " "))


_SQL_TRIALS = """tr AS (SELECT l_returnflag AS study, CAST(l_suppkey % 7 AS INTEGER) AS trial, CASE l_suppkey % 7 WHEN 5 THEN 'PRUNED' WHEN 6 THEN 'DUPLICATE' ELSE 'COMPLETE' END AS state, '{"depth": ' || (4 + l_suppkey % 7 % 3) || '}' AS params,
't' || l_linenumber AS topic, round(avg(l_discount) * 8, 6) AS precision, round(avg(l_tax) * 10, 6) AS recall, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY l_returnflag, l_suppkey % 7, l_linenumber)"""
_SQL_MEANS = f"""{_SQL_TRIALS}, b AS (SELECT unnest([1.0, 3.0, 50.0])::DOUBLE AS beta),
m AS (SELECT study, trial, params, beta, avg(CASE WHEN beta * beta * precision + recall = 0 THEN 0 ELSE (1 + beta * beta) * precision * recall / (beta * beta * precision + recall) END) AS avg_fbeta, avg(precision) AS avg_precision, avg(recall) AS avg_recall, count(*) AS topics
FROM tr, b WHERE state = 'COMPLETE' GROUP BY ALL)"""
_BEST = "QUALIFY row_number() OVER (PARTITION BY beta ORDER BY avg_fbeta DESC, study, trial) = 1"


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as measures of trials: a supplier's number says the trial, a line's number the topic."""
    trial = (F.col("l_suppkey") % 7).cast("int")
    state = F.when(F.col("trial") == 5, "PRUNED").when(F.col("trial") == 6, "DUPLICATE").otherwise("COMPLETE")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("study"), trial.alias("trial"), F.col("l_linenumber").cast("int").alias("step"))
    rows = lines.agg(r6(F.avg("l_discount") * 8).alias("precision"), r6(F.avg("l_tax") * 10).alias("recall"), r6(F.avg("l_quantity")).alias("value"))
    params = F.concat(F.lit('{"depth": '), (4 + F.col("trial") % 3).cast("string"), F.lit("}"))
    return rows.select("study", "trial", state.alias("state"), params.alias("params"), F.concat(F.lit("t"), F.col("step").cast("string")).alias("topic"), "step", "precision", "recall", "value")


@query(f"WITH {_SQL_MEANS} SELECT beta, study, trial, params, round(avg_fbeta, 6) AS avg_fbeta, round(avg_precision, 6) AS avg_precision, round(avg_recall, 6) AS avg_recall, topics FROM m {_BEST}")
def trial_best_per_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(study.best_per_beta(study.trial_means(_trials(spark, sf_dir), [1, 3, 50])), "avg_fbeta", "avg_precision", "avg_recall")


@query(f"WITH {_SQL_MEANS} SELECT beta, study, trial, round(avg_fbeta, 6) AS avg_fbeta, round(avg_recall, 6) AS avg_recall FROM m WHERE avg_recall >= 0.4 {_BEST}")
def trial_best_with_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = study.best_with_recall(study.trial_means(_trials(spark, sf_dir), [1, 3, 50]), 0.4)
    return rounded(best.select("beta", "study", "trial", "avg_fbeta", "avg_recall"), "avg_fbeta", "avg_recall")


@query(f"WITH {_SQL_MEANS}, x AS (SELECT * FROM m {_BEST}) SELECT params, count(*) AS n_betas, string_agg(CAST(beta AS INTEGER), ',' ORDER BY beta) AS betas FROM x GROUP BY params")
def params_dedupe_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = study.merge_best(study.best_per_beta(study.trial_means(_trials(spark, sf_dir), [1, 3, 50])))
    keys = F.array_sort(F.map_keys("betas"))
    return merged.select("params", F.size(keys).cast("long").alias("n_betas"), F.array_join(F.transform(keys, lambda b: b.cast("int").cast("string")), ",").alias("betas"))


@query(f"WITH {_SQL_TRIALS} SELECT study, state, count(*) AS n FROM tr GROUP BY GROUPING SETS ((study, state), (state))")
def trial_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.state_counts(_trials(spark, sf_dir))


@query(f"WITH {_SQL_TRIALS} SELECT json_extract_string(params, '$.depth') AS value, round(avg(value), 6) AS mean, count(*) AS n FROM tr WHERE value IS NOT NULL GROUP BY 1")
def mean_by_param_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(study.mean_by_value(_trials(spark, sf_dir), "depth"), "mean")


_SQL_EDGES = f"{SQL_RANK}, e AS (SELECT query_id::VARCHAR AS key, doc_id::VARCHAR AS form FROM r WHERE rank < 10)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, form): the ten nearest vectors of every query; vectors stand for words."""
    near = ranking.search(_vectors(spark, sf_dir), _queries(spark, sf_dir), k=10)
    text_ = lambda c: F.col(c).cast("string")
    return cut(near.select(text_("query_id").alias("key"), text_("doc_id").alias("form")))  # searched once, read many times


@query(f"""WITH RECURSIVE {_SQL_EDGES}, u AS (SELECT key AS a, form AS b FROM e UNION SELECT form, key FROM e), p AS (SELECT a AS word, a AS other FROM u UNION SELECT p.word, u.b FROM p JOIN u ON u.a = p.other)
SELECT word, min(other) AS root FROM p GROUP BY word""")
def lexicon_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: words that are forms of each other, over any number of steps, under the smallest."""
    return lexicon.merge_targets(_edges(spark, sf_dir))


def _starts(name: str) -> str:
    return f"CAST({name} AS BIGINT) % 100 = 0"


@query(f"""WITH RECURSIVE {_SQL_EDGES}, c AS (SELECT DISTINCT key AS word, key AS related FROM e WHERE {_starts("key")} UNION SELECT c.word, e.form FROM c JOIN e ON e.key = c.related) SELECT word, related FROM c""")
def related_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """all words that some words are related to, over any number of steps."""
    edges = _edges(spark, sf_dir)
    starts = edges.filter(_starts("key")).select(F.col("key").alias("word"))
    return lexicon.closure(edges.toDF("word", "related"), starts)


@query(f"""WITH {_SQL_EDGES}, w AS (SELECT key AS word FROM e UNION SELECT form FROM e), n AS (SELECT word, count(DISTINCT form) AS n FROM w LEFT JOIN e ON e.key = w.word GROUP BY word), c AS (SELECT key AS word, form AS choice FROM e UNION SELECT word, word FROM w)
SELECT c.word, choice AS target FROM c JOIN n ON n.word = c.choice QUALIFY row_number() OVER (PARTITION BY c.word ORDER BY n DESC, choice) = 1""")
def dominating_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """of a word and its related words the one with the most related words."""
    edges = _edges(spark, sf_dir).toDF("word", "related")
    words = edges.select("word").union(edges.select("related")).distinct()
    return lexicon.dominating_words(words, edges)

