"""Query variants and what they retrieve: ablation and substitution of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boolsieve.functions import boolean
from boolsieve.functions.safe import f_beta, precision, recall


def variant_metrics(docs: DataFrame, variants: dict[str, boolean.Node], tokens: str = "tokens", y: str = "y", beta: float = 50.0) -> DataFrame:
    """(variant, tp, returned, precision, recall, f) of every query over all documents, in one pass."""
    flags = [boolean.to_column(node, F.col(tokens)).alias(f"v{i}") for i, node in enumerate(variants.values())]
    hits = docs.select((F.col(y) == 1).alias("_y"), *flags)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = hits.agg(n(F.col("_y")).alias("pos"), *[a for i in range(len(variants)) for a in (n(F.col(f"v{i}") & F.col("_y")).alias(f"t{i}"), n(F.col(f"v{i}")).alias(f"r{i}"))])
    rows = [F.struct(F.lit(name).alias("variant"), F.coalesce(f"t{i}", F.lit(0)).alias("tp"), F.coalesce(f"r{i}", F.lit(0)).alias("returned")) for i, name in enumerate(variants)]
    out = sums.select("pos", F.inline(F.array(*rows)))
    out = out.withColumn("precision", precision(F.col("tp"), F.col("returned"))).withColumn("recall", recall(F.col("tp"), F.col("pos")))
    return out.withColumn("f", f_beta(F.col("precision"), F.col("recall"), beta)).drop("pos")


def useless_terms(docs: DataFrame, query: str, beta: float = 50.0) -> DataFrame:
    """(term, place, f, f_gain, precision_gain, recall_gain, useless) for each occurrence of a term, taken out by itself.

    An occurrence is useless if the query without it has at least the same F. An occurrence that is the whole query stays.
    """
    node = boolean.parse(query)
    cut = [(t, k, v) for t, k, v in boolean.variants_without(node) if v is not None]
    found = variant_metrics(docs, {"base": node} | {str(k): v for _, k, v in cut}, beta=beta)
    spark = docs.sparkSession
    names = spark.createDataFrame([(str(k), t.text, k) for t, k, _ in cut], "variant string, term string, place int")
    base = found.filter("variant = 'base'").select(F.col("f").alias("f0"), F.col("precision").alias("p0"), F.col("recall").alias("r0"))
    rows = found.join(F.broadcast(names), "variant").join(F.broadcast(base))  # a query's variants
    return rows.select("term", "place", "f", (F.col("f") - F.col("f0")).alias("f_gain"), (F.col("precision") - F.col("p0")).alias("precision_gain"), (F.col("recall") - F.col("r0")).alias("recall_gain"), (F.col("f") >= F.col("f0")).alias("useless"))


def substitutions(docs: DataFrame, first: str, second: str, beta: float = 50.0) -> DataFrame:
    """(term, other, f_gain): each term of the first query exchanged, wherever it stands, for each term of the second."""
    node = boolean.parse(first)
    own = list(dict.fromkeys(t.text for t in boolean.terms_of(node)))
    others = list(dict.fromkeys(t.text for t in boolean.terms_of(boolean.parse(second))))
    pairs = [(a, b) for a in own for b in others if a != b]
    found = variant_metrics(docs, {"base": node} | {f"{i}": boolean.replace_term(node, a, b) for i, (a, b) in enumerate(pairs)}, beta=beta)
    names = docs.sparkSession.createDataFrame([(str(i), a, b) for i, (a, b) in enumerate(pairs)], "variant string, term string, other string")
    base = found.filter("variant = 'base'").select(F.col("f").alias("f0"))
    return found.join(F.broadcast(names), "variant").join(F.broadcast(base)).select("term", "other", (F.col("f") - F.col("f0")).alias("f_gain"))


def best_replacements(gains: DataFrame, k: int) -> DataFrame:
    """The k best replacements of each term, with ``rank``; ties by the other term."""
    return gains.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("f_gain"), "other"))).filter(F.col("rank") <= k)


def pair_similarities(terms: DataFrame, vectors: DataFrame, random_pairs: int = 0, seed: int = 0) -> DataFrame:
    """(kind, n, mean, median, low, high): cosine of term pairs in the same OR and of those in the same AND but other ORs.

    terms: (query_id, clause, literal, term), those of queries; vectors: (term, vector). ``random_pairs`` adds the kind
    "random": so many pairs of different terms of ``vectors``, neighbours in the order of a hash of seed and term.
    """
    from boolsieve.operators.ranking import cosine

    rows = terms.join(vectors, "term")
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.clause") == F.col("b.clause")) & (F.col("a.term") < F.col("b.term")))
    kind = F.when(F.col("a.literal") == F.col("b.literal"), "or").otherwise("and")
    scored = pairs.select(kind.alias("kind"), cosine(F.col("a.vector"), F.col("b.vector")).alias("s"))
    if random_pairs:
        drawn = vectors.withColumn("hash", F.md5(F.concat(F.lit(f"{seed}:"), "term"))).orderBy("hash", "term").limit(2 * random_pairs)
        at = F.row_number().over(Window.orderBy("hash", "term")) - 1  # over the drawn rows only
        paired = drawn.withColumn("at", at).groupBy(F.floor(F.col("at") / 2).alias("pair")).agg(F.min_by("vector", "at").alias("v"), F.max_by("vector", "at").alias("w"), F.count("*").alias("n"))
        scored = scored.unionByName(paired.filter("n = 2").select(F.lit("random").alias("kind"), cosine(F.col("v"), F.col("w")).alias("s")))
    return scored.groupBy("kind").agg(F.count("*").alias("n"), F.avg("s").alias("mean"), F.percentile("s", 0.5).alias("median"), F.min("s").alias("low"), F.max("s").alias("high"))


def date_windows(counts: list[tuple[int, int]], target: int, most: int, first_width: int = 365) -> list[tuple[int, int, int]]:
    """(from, to, rows) windows of days, walked backwards from the last one so that each holds fewer than ``most`` rows.

    ``counts`` are (day, rows) pairs. A window's width follows its count: shrunk in proportion if it holds too many,
    doubled if none, else scaled towards ``target``. A single day is taken whole. When what is left fits, it is one window.
    """
    if not counts:
        return []
    by_day = dict(counts)
    low, at = min(by_day), max(by_day)
    total = lambda a, b: sum(by_day.get(d, 0) for d in range(a, b + 1))
    out, width = [], first_width
    while at >= low:
        rest = total(low, at)
        if rest < most:
            out.append((low, at, rest))
            break
        begin = max(low, at - width + 1)
        n = total(begin, at)
        while n >= most and begin < at:
            width = max(1, min(width - 1, int(width * target / n)))
            begin = at - width + 1
            n = total(begin, at)
        out.append((begin, at, n))
        at = begin - 1
        width = width * 2 if not n else max(1, round(width * target / n))
    return out
