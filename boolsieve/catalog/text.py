"""Vocabularies, the query language, rules, splits and variants on the test documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boolsieve.catalog.registry import LABEL_ROWS, SQL_DOCS, SQL_LAB, SQL_POST, SQL_TERMS, SQL_TEXTS, labelled, labels, postings, query, r6, rounded, sql_f, sql_ratio, table, texts
from boolsieve.functions import boolean, strategies, text
from boolsieve.functions.rules import rule
from boolsieve.functions.safe import precision, ratio, recall
from boolsieve.operators import ablation, analytics, coverage, lexicon, setcover, splits, vocabulary
from boolsieve.plans import trees
from boolsieve.session import cut, literal, small

SQL_DF = f"{SQL_POST}, df AS (SELECT term, count(*) AS df FROM post GROUP BY term), n AS (SELECT count(*) AS n FROM documents)"


@query(f"WITH {SQL_DF} SELECT term, df FROM df")
def doc_term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.document_frequencies(postings(spark, sf_dir))


@query(f"WITH {SQL_DF} SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS term_id FROM df, n WHERE df >= 5 AND df <= 0.5 * n")
def vocab_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.vocabulary(postings(spark, sf_dir), table(spark, sf_dir, "documents").count(), 5, 0.5)


@query(f"""WITH {SQL_DF}, g AS (SELECT * FROM (VALUES (1.0::DOUBLE), (5.0), (20.0)) a(min_df), (VALUES (0.1::DOUBLE), (0.5)) b(max_df))
SELECT min_df, max_df, count(term) AS features, min(df) AS lowest, max(df) AS highest
FROM g LEFT JOIN (SELECT * FROM df, n) x ON df >= min_df AND df <= max_df * n GROUP BY ALL""")
def vocab_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vocabulary.document_frequencies(postings(spark, sf_dir))
    return vocabulary.sweep(df, table(spark, sf_dir, "documents").count(), [1, 5, 20], [0.1, 0.5])


@query(f"""WITH {SQL_DF} SELECT * FROM (SELECT 'top' AS side, term, df FROM df ORDER BY df DESC, term LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'bottom' AS side, term, df FROM df ORDER BY df, term LIMIT 20)""")
def vocab_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.extremes(vocabulary.document_frequencies(postings(spark, sf_dir)), 20)


_WORDS = ["trash", "clown", "license", "no-such-word", "he", "les"]
_LISTED = ", ".join(f"('{w}')" for w in _WORDS)


@query(f"WITH {SQL_DF} SELECT w.term, coalesce(df, 0) AS df FROM (VALUES {_LISTED}) w(term) LEFT JOIN df USING (term)")
def oov_df_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.lookup(vocabulary.document_frequencies(postings(spark, sf_dir)), _WORDS)


@query(f"""WITH {SQL_DF}, w AS (SELECT coalesce(df, 0) AS df FROM (VALUES {_LISTED}) w(term) LEFT JOIN df USING (term))
SELECT avg(df)::DOUBLE AS avg_df, quantile_cont(df, 0.5)::DOUBLE AS median_df, min(df) AS min_df, max(df) AS max_df FROM w""")
def query_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.document_count_stats(vocabulary.document_frequencies(postings(spark, sf_dir)), _WORDS)


@query(f"""WITH {SQL_POST}, {SQL_LAB} SELECT term, count(*) AS df, CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n1, CAST(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n0
FROM post JOIN lab USING (doc_id) GROUP BY term HAVING n1 >= 5 OR n0 >= 20""")
def per_class_min_occ(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.by_class_minimum(vocabulary.class_frequencies(postings(spark, sf_dir), labels(spark, sf_dir)), 5, 20)


@query(f"""SELECT doc_id, array_to_string({SQL_TERMS} || list_sort(list_distinct(['"' || lang || '"[mh]', '"' || source || '"[mh]'])), ' ') AS bow FROM documents""")
def bag_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.bag_of_words(F.col("text"), F.array("lang", "source")), " ").alias("bow"))


# the plural rules in the order in which they decide, irregular forms first
_SQL_LEMMA = "CASE " + " ".join(f"WHEN term = '{a}' THEN '{b}'" for a, b in text.IRREGULAR.items()) + """ WHEN length(term) <= 3 THEN term
WHEN term LIKE '%ies' THEN regexp_replace(term, '([^ae])ies$', '\\1y') WHEN term LIKE '%es' THEN regexp_replace(term, '([^aeo])es$', '\\1e') ELSE regexp_replace(term, '([^su])s$', '\\1') END"""


@query(f"WITH {SQL_POST} SELECT lemma, array_to_string(list_sort(list(DISTINCT term)), ' ') AS forms, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, term, {_SQL_LEMMA} AS lemma FROM post) GROUP BY lemma")
def lemma_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lemma with the forms that stand for it and the documents that have it (F1)."""
    return lexicon.lemma_counts(table(spark, sf_dir, "documents")).select("lemma", F.array_join("forms", " ").alias("forms"), "df")


@query(f"WITH {SQL_POST}, l AS (SELECT DISTINCT doc_id, {_SQL_LEMMA} AS lemma FROM post) SELECT d.doc_id, coalesce(string_agg(lemma, ' ' ORDER BY lemma), '') AS lemmas FROM documents d LEFT JOIN l USING (doc_id) GROUP BY d.doc_id")
def document_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different lemmas of every document (F2)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.lemmas(F.col("text")), " ").alias("lemmas"))


@query("""SELECT o_orderkey, CASE WHEN p < 1000 THEN CAST(CAST(floor(p) AS BIGINT) AS VARCHAR) WHEN p < 10000 THEN printf('%.1fk', p / 1000) WHEN p < 1000000 THEN printf('%.0fk', p / 1000)
WHEN p < 10000000 THEN printf('%.2fm', p / 1000000) ELSE printf('%.1fm', p / 1000000) END AS shown FROM (SELECT o_orderkey, floor(o_totalprice) + 0.25 AS p FROM orders)""")
def format_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", text.format_count(F.floor("o_totalprice") + F.lit(0.25)).alias("shown"))


_QUERY = "(trash OR clown OR worthless OR idiot OR moron) AND (the OR is) NOT (copyright OR disgusting)"
_SQL_HAS = "(list_has_any(tokens, ['trash', 'clown', 'worthless', 'idiot', 'moron']) AND list_has_any(tokens, ['the', 'is']) AND NOT list_has_any(tokens, ['copyright', 'disgusting']))"


@query(f"WITH {SQL_TEXTS} SELECT doc_id FROM texts WHERE {_SQL_HAS}")
def bool_query_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).filter(boolean.to_column(boolean.parse(_QUERY), F.col("tokens"))).select("doc_id")


@query(f"""WITH {SQL_DOCS}, s AS (SELECT CAST(count(*) FILTER ({_SQL_HAS} AND y = 1) AS BIGINT) AS tp, CAST(count(*) FILTER ({_SQL_HAS}) AS BIGINT) AS returned, CAST(count(*) FILTER (y = 1) AS BIGINT) AS positives FROM docs),
p AS (SELECT *, {sql_ratio("tp", "returned")} AS precision, {sql_ratio("tp", "positives")} AS recall FROM s)
SELECT tp, returned, positives, round(precision, 6) AS precision, round(recall, 6) AS recall, round({sql_f("precision", "recall", 1)}, 6) AS f1, round({sql_f("precision", "recall", 3)}, 6) AS f3 FROM p""")
def bool_query_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage.mask_metrics(labelled(spark, sf_dir), boolean.to_column(boolean.parse(_QUERY), F.col("tokens")), F.col("y"), betas=(1.0, 3.0))
    return rounded(out, "precision", "recall", "f1", "f3")


@query(f"WITH {SQL_TEXTS} SELECT doc_id FROM texts WHERE list_contains(tokens, 'the') AND NOT (list_contains(tokens, 'was') OR list_contains(tokens, 'for'))")
def bool_query_not_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = boolean.parse("NOT (was OR for) AND the")
    return texts(spark, sf_dir).filter(boolean.to_column(node, F.col("tokens"))).select("doc_id")


@query(f"WITH {SQL_POST}, h AS (SELECT doc_id, list(term) AS t FROM post GROUP BY doc_id) SELECT doc_id FROM documents LEFT JOIN h USING (doc_id) WHERE NOT list_contains(coalesce(t, []), 'he') OR (list_contains(t, 'her') AND list_contains(t, 'trash'))")
def bool_query_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boolean.matches(boolean.parse("NOT he OR (her AND trash)"), postings(spark, sf_dir), table(spark, sf_dir, "documents"))


RULES = [
    rule([(("trash", "clown", "worthless"), True)]),
    rule([(("idiot", "moron"), True), (("er", "on"), True), (("disgusting",), False)]),
    rule([(("les", "une"), True), (("he",), False)]),
    rule([(("no-such-word",), True)]),
    rule([(("stupid", "loser", "scum"), True), (("he", "les", "der"), True)]),
]
_HIT = [
    "list_has_any(terms, ['trash', 'clown', 'worthless'])",
    "list_has_any(terms, ['idiot', 'moron']) AND list_has_any(terms, ['er', 'on']) AND NOT list_contains(terms, 'disgusting')",
    "list_has_any(terms, ['les', 'une']) AND NOT list_contains(terms, 'he')", "list_contains(terms, 'no-such-word')",
    "list_has_any(terms, ['stupid', 'loser', 'scum']) AND list_has_any(terms, ['he', 'les', 'der'])",
]
SQL_COVER = f"{SQL_DOCS}, cover AS (" + " UNION ALL ".join(f"SELECT {i}::BIGINT AS rule_id, doc_id, y FROM docs WHERE {h}" for i, h in enumerate(_HIT)) + ")"


def _cover(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What rules cover of all documents, the labels that rate it, and the rules."""
    table_ = coverage.rule_table(spark, RULES)
    return coverage.coverage(postings(spark, sf_dir), table_), labels(spark, sf_dir), table_


@query(f"WITH {SQL_TEXTS} " + " UNION ALL ".join(f"SELECT {i}::BIGINT AS rule_id, doc_id FROM texts WHERE {h}" for i, h in enumerate(_HIT)))
def rule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cover(spark, sf_dir)[0]


@query(f"WITH {SQL_TEXTS} SELECT doc_id, {' OR '.join(f'({h})' for h in _HIT)} AS hit FROM texts")
def rule_any_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", coverage.any_covers(RULES, F.col("terms")).alias("hit"))


@query(f"""WITH {SQL_COVER}, s AS (SELECT r.rule_id, CAST(count(doc_id) FILTER (y = 1) AS BIGINT) AS tp, CAST(count(doc_id) AS BIGINT) AS returned FROM (SELECT unnest(range(5)) AS rule_id) r LEFT JOIN cover USING (rule_id) GROUP BY 1),
p AS (SELECT rule_id, tp, returned, {sql_ratio("tp", "returned")} AS precision, {sql_ratio("tp", "(SELECT count(*) FROM docs WHERE y = 1)")} AS recall FROM s)
SELECT rule_id, tp, returned, round(precision, 6) AS precision, round(recall, 6) AS recall, round({sql_f("precision", "recall", 1)}, 6) AS f FROM p""")
def rule_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cover, lab, table_ = _cover(spark, sf_dir)
    return rounded(coverage.rule_metrics(cover, lab, table_), "precision", "recall", "f")


def _moves_sql() -> str:
    f = sql_f("p", "r", 2.0)
    return f"""WITH {SQL_COVER}, costs AS (SELECT unnest([2.5, 5.5, 4.0, 2.0, 4.5])::DOUBLE AS cost, unnest(range(5)) AS rule_id),
sets AS (SELECT r AS r_in, NULL::BIGINT AS r_out, [0, 1, r] AS s FROM (SELECT unnest([2, 3, 4])::BIGINT AS r)
  UNION ALL SELECT NULL, r, list_filter([0, 1], lambda x: x <> r) FROM (SELECT unnest([0, 1])::BIGINT AS r)
  UNION ALL SELECT a, b, list_filter([0, 1], lambda x: x <> b) || [a] FROM (SELECT unnest([2, 3, 4])::BIGINT AS a), (SELECT unnest([0, 1])::BIGINT AS b)),
u AS (SELECT DISTINCT r_in, r_out, doc_id, y FROM sets JOIN cover ON list_contains(s, rule_id)),
c AS (SELECT r_in, r_out, sum(cost) AS cost FROM sets JOIN costs ON list_contains(s, rule_id) GROUP BY 1, 2),
t AS (SELECT c.r_in, c.r_out, cost, CAST(count(*) FILTER (u.y = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (u.y = 0) AS BIGINT) AS fp FROM c LEFT JOIN u ON c.r_in IS NOT DISTINCT FROM u.r_in AND c.r_out IS NOT DISTINCT FROM u.r_out GROUP BY 1, 2, 3),
x AS (SELECT *, (SELECT count(*) FROM docs WHERE y = 1) - tp AS fn, {sql_ratio("tp", "tp + fp")} AS p, {sql_ratio("tp", "(SELECT count(*) FROM docs WHERE y = 1)")} AS r FROM t)
SELECT r_in, r_out, tp, fp, fn, round(cost, 6) AS cost, round({f} - 0.002 * cost, 6) AS score FROM x"""


@query(_moves_sql())
def move_scores_add_remove_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cover, lab, _ = _cover(spark, sf_dir)
    costs = literal(spark, list(enumerate([2.5, 5.5, 4.0, 2.0, 4.5])), "rule_id long, cost double")
    selected = literal(spark, [(0,), (1,)], "rule_id long")
    return rounded(coverage.move_scores(cover, lab, selected, costs, 2.0, 0.002), "cost", "score")


_URL_SQL = "x AS (SELECT page_id, unnest(w) AS name, unnest(range(len(w))) AS pos FROM (SELECT page_id, regexp_extract_all(lower(url), '[a-z0-9]+') AS w FROM pages))"


def _url_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, pos, name): the tokens of a page's url, which stand for the terms of a query."""
    tokens = F.regexp_extract_all(F.lower("url"), F.lit("[a-z0-9]+"), 0)
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(tokens).alias("pos", "name"))


@query(f"WITH {_URL_SQL} SELECT page_id, count(*) AS n, round((count(*) - count(DISTINCT name)) * 100.0 / count(*), 6) AS pct FROM x GROUP BY page_id")
def duplicate_feature_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.duplicate_share(_url_items(spark, sf_dir), "page_id", "name", "pos"), "pct")


@query(f"""WITH {_URL_SQL}, d AS (SELECT DISTINCT a.page_id, a.pos FROM x a JOIN x b ON a.page_id = b.page_id AND b.pos < a.pos AND (contains(a.name, b.name) OR contains(b.name, a.name)))
SELECT page_id, count(*) AS n, round(count(d.pos) * 100.0 / count(*), 6) AS pct FROM x LEFT JOIN d USING (page_id, pos) GROUP BY page_id""")
def similar_feature_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.duplicate_share(_url_items(spark, sf_dir), "page_id", "name", "pos", substring=True), "pct")


_GAIN = "2 * (w1 / w) * (1 - w1 / w) - (w_l * 2 * (w1_l / w_l) * (1 - w1_l / w_l) + (w - w_l) * 2 * ((w1 - w1_l) / (w - w_l)) * (1 - (w1 - w1_l) / (w - w_l))) / w"
_SPLIT = f"""{SQL_POST}, st AS (SELECT doc_id, toxic AS y, CASE WHEN toxic = 1 THEN 300 ELSE 100 END::DOUBLE AS w FROM labels),
tot AS (SELECT count(*) AS n, sum(w) AS w, sum(w * y) AS w1 FROM st),
tt AS (SELECT term, count(*) AS n_l, sum(w) AS w_l, sum(w * y) AS w1_l FROM post JOIN st USING (doc_id) GROUP BY term),
g AS (SELECT term, n_l, {_GAIN} AS gain, w1_l / w_l > (w1 - w1_l) / (w - w_l) AS positive FROM tt, tot WHERE n_l >= 3 AND n - n_l >= 3 AND w_l >= 0.001 * w AND w - w_l >= 0.001 * w)"""


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = labels(spark, sf_dir)
    return lab.select("doc_id", F.lit(0).alias("node"), "y", F.when(F.col("y") == 1, 300).otherwise(100).alias("w"))


def _root_splits(spark: SparkSession, sf_dir: str, prefer: float | None = None, post: DataFrame | None = None) -> DataFrame:
    state = _state(spark, sf_dir)
    nodes = splits.node_totals(state)
    return splits.rated(splits.term_totals(postings(spark, sf_dir) if post is None else post, state), nodes, float(nodes.first()["w"]), 3, 0.001, prefer)


@query(f"WITH {_SPLIT} SELECT term, n_l, round(gain, 6) AS gain, positive FROM g")
def split_gain_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_root_splits(spark, sf_dir).select("term", "n_l", "gain", "positive"), "gain")


@query(f"WITH {_SPLIT} SELECT term, round(CASE WHEN positive THEN gain * 1.1 ELSE gain END, 6) AS gain, CAST(row_number() OVER (ORDER BY round(CASE WHEN positive THEN gain * 1.1 ELSE gain END, 9) DESC, term) AS INTEGER) AS rank FROM g QUALIFY rank <= 50")
def best_split_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = _root_splits(spark, sf_dir, 1.1).withColumn("gain", F.round("gain", 9))
    return rounded(splits.best_terms(rated, 50).select("term", "gain", "rank"), "gain")


@query(f"""WITH {_SPLIT}, cov AS (SELECT DISTINCT doc_id FROM post WHERE term IN ('trash', 'clown')),
m AS (SELECT term, (SELECT count(*) FROM cov JOIN st USING (doc_id)) + count(st.doc_id) AS n_l, (SELECT sum(w) FROM cov JOIN st USING (doc_id)) + coalesce(sum(st.w), 0) AS w_l, (SELECT sum(w * y) FROM cov JOIN st USING (doc_id)) + coalesce(sum(st.w * st.y), 0) AS w1_l
  FROM (SELECT term FROM g WHERE term NOT IN ('trash', 'clown')) c JOIN post USING (term) LEFT JOIN (SELECT * FROM st WHERE doc_id NOT IN (SELECT doc_id FROM cov)) st USING (doc_id) GROUP BY term),
b AS (SELECT n_c, w_c, w1_c, 2 * (w1 / w) * (1 - w1 / w) - ({_GAIN.replace("w1_l", "w1_c").replace("w_l", "w_c")}) AS before FROM (SELECT count(*) AS n_c, sum(w) AS w_c, sum(w * y) AS w1_c FROM cov JOIN st USING (doc_id)), tot)
SELECT term, round(before - (2 * (w1 / w) * (1 - w1 / w) - ({_GAIN})), 6) AS "drop" FROM m, tot, b WHERE n_l >= 3 AND n - n_l >= 3""")
def or_expand_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = cut(_state(spark, sf_dir))
    post = cut(postings(spark, sf_dir).join(state.select("doc_id"), "doc_id", "left_semi"))  # read three times
    chosen = spark.createDataFrame([(0, "trash"), (0, "clown")], "node int, term string")
    candidates = _root_splits(spark, sf_dir, post=post).select("node", "term").filter(~F.col("term").isin("trash", "clown"))
    root = float(splits.node_totals(state).first()["w"])
    return rounded(splits.or_candidates(post, state, chosen, candidates, root, 3, 0.001).select("term", "drop"), "drop")


@query(f"""WITH {SQL_TEXTS} SELECT doc_id, CAST(CASE WHEN list_has_any(terms, ['trash', 'clown']) THEN CASE WHEN list_contains(terms, 'he') THEN 0.9 ELSE 0.6 END
WHEN list_contains(terms, 'moron') THEN 0.8 ELSE 0.0 END AS DOUBLE) AS p FROM texts""")
def tree_predict_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", trees.tree_column(_TREE, F.col("terms"), _NAMES).alias("p"))


_NAMES = ["trash", "clown", "he", "moron"]
_TREE = trees.Node(1, 1, 0.5, [0, 1], trees.Node(1, 1, 0.7, [2], trees.Node(1, 1, 0.9), trees.Node(1, 1, 0.6)), trees.Node(1, 1, 0.2, [3], trees.Node(1, 1, 0.8), trees.Node(1, 1, 0.1)))


@query(f"""WITH {SQL_DOCS}, s AS (SELECT y, list_has_any(terms, ['trash', 'clown'])::INT + list_contains(terms, 'idiot')::INT + list_contains(terms, 'he')::INT * 0.5 AS s FROM docs),
t AS (SELECT DISTINCT s AS t FROM s WHERE s > 0), m AS (SELECT t, CAST(count(*) FILTER (y = 1) AS BIGINT) AS tp, CAST(count(*) AS BIGINT) AS returned FROM t JOIN s ON s.s >= t GROUP BY t)
SELECT t::DOUBLE AS threshold, tp, returned, round({sql_ratio("tp", "returned")}, 6) AS precision, round({sql_ratio("tp", "(SELECT count(*) FROM docs WHERE y = 1)")}, 6) AS recall FROM m""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda *w: text.has_token(F.col("text"), *w).cast("double")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.join(small(labels(spark, sf_dir), LABEL_ROWS), "doc_id").select("y", (has("trash", "clown") + has("idiot") + has("he") * 0.5).alias("s"))
    by = rows.groupBy("s").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("p"), F.count("*").alias("n"))
    total = by.agg(F.sum("p").alias("positives"))
    grid = F.broadcast(by.filter("s > 0").select(F.col("s").alias("threshold")))  # a tree's leaves
    sums = by.join(grid, F.col("s") >= F.col("threshold")).groupBy("threshold").agg(F.sum("p").alias("tp"), F.sum("n").alias("returned"))
    return sums.join(F.broadcast(total)).select("threshold", "tp", "returned", r6(precision(F.col("tp"), F.col("returned"))).alias("precision"), r6(recall(F.col("tp"), F.col("positives"))).alias("recall"))


@query(f"""WITH {SQL_POST}, {SQL_LAB}, cov AS (SELECT DISTINCT doc_id FROM post WHERE term = 'trash'), t AS (SELECT term, count(*) AS total FROM post JOIN lab USING (doc_id) GROUP BY term),
f AS (SELECT term, count(*) AS fresh FROM post JOIN lab USING (doc_id) WHERE y = 1 AND doc_id NOT IN (SELECT doc_id FROM cov) GROUP BY term)
SELECT term, total, fresh, round(fresh / total::DOUBLE, 6) AS score FROM t JOIN f USING (term) WHERE total >= 5 AND fresh >= 3""")
def set_cover_greedy_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = postings(spark, sf_dir)
    covered = post.filter("term = 'trash'").select("doc_id")
    return rounded(setcover.candidates(post, labels(spark, sf_dir), covered, 5, 3), "score")


_ABLATED = "(trash OR clown OR nonsense) AND (the OR is)"
_VARIANTS = {
    "base": "list_has_any(tokens, ['trash', 'clown', 'nonsense']) AND list_has_any(tokens, ['the', 'is'])",
    "0": "list_has_any(tokens, ['clown', 'nonsense']) AND list_has_any(tokens, ['the', 'is'])", "1": "list_has_any(tokens, ['trash', 'nonsense']) AND list_has_any(tokens, ['the', 'is'])",
    "2": "list_has_any(tokens, ['trash', 'clown']) AND list_has_any(tokens, ['the', 'is'])", "3": "list_has_any(tokens, ['trash', 'clown', 'nonsense']) AND list_has_any(tokens, ['is'])",
    "4": "list_has_any(tokens, ['trash', 'clown', 'nonsense']) AND list_has_any(tokens, ['the'])",
}


def _variants_sql(conditions: dict[str, str]) -> str:
    each = " UNION ALL ".join(f"SELECT '{k}' AS v, count(*) FILTER ({c} AND y = 1) AS tp, count(*) FILTER ({c}) AS n, count(*) FILTER (y = 1) AS pos FROM docs" for k, c in conditions.items())
    return f"""{SQL_DOCS}, vs AS ({each}), pr AS (SELECT v, {sql_ratio("tp", "n")} AS p, {sql_ratio("tp", "pos")} AS r FROM vs), fs AS (SELECT v, p, r, {sql_f("p", "r", 50)} AS f FROM pr), b AS (SELECT * FROM fs WHERE v = 'base')"""


@query(f"""WITH {_variants_sql(_VARIANTS)} SELECT ['trash', 'clown', 'nonsense', 'the', 'is'][fs.v::INT + 1] AS term, fs.v::INT AS place, round(fs.f, 6) AS f, round(fs.f - b.f, 6) AS f_gain,
round(fs.p - b.p, 6) AS precision_gain, round(fs.r - b.r, 6) AS recall_gain, fs.f >= b.f AS useless FROM fs, b WHERE fs.v <> 'base'""")
def useless_term_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ablation.useless_terms(labelled(spark, sf_dir), _ABLATED), "f", "f_gain", "precision_gain", "recall_gain")


_PAIRS = [(a, b) for a in ("trash", "clown") for b in ("idiot", "moron", "the")]
_SUBST = {"base": "list_has_any(tokens, ['trash', 'clown'])"} | {f"{a}>{b}": f"list_has_any(tokens, {[b if x == a else x for x in ('trash', 'clown')]})" for a, b in _PAIRS}


@query(f"WITH {_variants_sql(_SUBST)} SELECT split_part(fs.v, '>', 1) AS term, split_part(fs.v, '>', 2) AS other, round(fs.f - b.f, 6) AS f_gain FROM fs, b WHERE fs.v <> 'base'")
def term_substitution_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ablation.substitutions(labelled(spark, sf_dir), "trash OR clown", "(idiot OR moron) AND the"), "f_gain")


@query(f"""WITH {_variants_sql(_SUBST)} SELECT split_part(fs.v, '>', 1) AS term, split_part(fs.v, '>', 2) AS other, round(fs.f - b.f, 6) AS f_gain,
CAST(row_number() OVER (PARTITION BY split_part(fs.v, '>', 1) ORDER BY fs.f - b.f DESC, split_part(fs.v, '>', 2)) AS INTEGER) AS rank FROM fs, b WHERE fs.v <> 'base' QUALIFY rank <= 2""")
def best_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ablation.best_replacements(ablation.substitutions(labelled(spark, sf_dir), "trash OR clown", "(idiot OR moron) AND the"), 2), "f_gain")


@query(f"""WITH {SQL_DOCS}, s AS (SELECT count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM docs), w AS (SELECT greatest(1, round((n0 / n1::DOUBLE) ** 0.2)) * 100 AS w1, n0, n1 FROM s)
SELECT CAST(sum(CASE WHEN y = 1 THEN w1 ELSE 100 END) AS BIGINT) AS weight, round(sum(CASE WHEN y = 1 THEN w1 ELSE 0 END) / sum(CASE WHEN y = 1 THEN w1 ELSE 100 END), 6) AS p1,
round(2 * (sum(CASE WHEN y = 1 THEN w1 ELSE 0 END) / sum(CASE WHEN y = 1 THEN w1 ELSE 100 END)) * (1 - sum(CASE WHEN y = 1 THEN w1 ELSE 0 END) / sum(CASE WHEN y = 1 THEN w1 ELSE 100 END)), 6) AS gini FROM docs, w""")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boolsieve.functions.safe import gini
    from boolsieve.plans.learn import weighted

    p = ratio(F.sum(F.col("w") * F.col("y")), F.sum("w"))
    return weighted(labels(spark, sf_dir), 0.2).agg(F.sum("w").alias("weight"), r6(p).alias("p1"), r6(gini(p)).alias("gini"))


@query("""SELECT doc_id, CAST((length(text) - length(replace(text, 'OR', ''))) / 2 AS BIGINT) AS "OR", CAST((length(text) - length(replace(text, 'AND', ''))) / 3 AS BIGINT) AS "AND",
CAST((length(text) - length(replace(text, 'NOT', ''))) / 3 AS BIGINT) AS "NOT", CAST((length(text) - length(replace(text, 'OR', ''))) / 2 + (length(text) - length(replace(text, 'AND', ''))) / 3
+ (length(text) - length(replace(text, 'NOT', ''))) / 3 AS BIGINT) AS "SUM" FROM documents""")
def operator_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = strategies.keyword_counts(F.col("text"), ("OR", "AND", "NOT"))
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in counts.items()])


@query("""SELECT n_nationkey, replace(replace(lower(n_name), '_', ' '), 'nation', 'country') AS mapped FROM nation""")
def synonym_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    canonical = F.create_map(F.lit("nation"), F.lit("country"))
    words = F.replace(F.lower("n_name"), F.lit("_"), F.lit(" "))
    return table(spark, sf_dir, "nation").select("n_nationkey", strategies.map_words(words, canonical).alias("mapped"))


@query("""WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS e, vec_id // 60 AS q, label AS clause, vec_id % 3 AS literal FROM embeddings),
p AS (SELECT CASE WHEN a.literal = b.literal THEN 'or' ELSE 'and' END AS kind, list_cosine_similarity(a.e, b.e) AS s FROM t a JOIN t b ON a.q = b.q AND a.clause = b.clause AND a.vec_id::VARCHAR < b.vec_id::VARCHAR),
o AS (SELECT e, row_number() OVER (ORDER BY md5('7:' || vec_id::VARCHAR), vec_id::VARCHAR) - 1 AS at FROM t),
u AS (SELECT * FROM p UNION ALL SELECT 'random', list_cosine_similarity(x.e, y.e) FROM o x JOIN o y ON x.at % 2 = 0 AND y.at = x.at + 1 AND y.at < 400)
SELECT kind, count(*) AS n, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.5), 6) AS median, round(min(s), 6) AS low, round(max(s), 6) AS high FROM u GROUP BY kind""")
def term_pair_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stand for terms, sixty in a query."""
    v = table(spark, sf_dir, "embeddings")
    terms = v.select(F.floor(F.col("vec_id") / 60).alias("query_id"), F.col("label").alias("clause"), (F.col("vec_id") % 3).alias("literal"), F.col("vec_id").cast("string").alias("term"))
    out = ablation.pair_similarities(terms, v.select(F.col("vec_id").cast("string").alias("term"), F.col("embedding").alias("vector")), random_pairs=200, seed=7)
    return rounded(out, "mean", "median", "low", "high")
