"""Source divergence audit: how far the term frequencies of each source lie from those of others and of their language.

Every source has a count for every kept term, most of them zero. A pair of sources is never compared term by term: what
its terms would give if they were in one source alone is priced from histograms of counts, terms that both have are
corrected by a join of postings, and terms that neither has are a constant.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boolsieve.llm.common import STEP_BYTES, slices, utf8
from boolsieve.session import cut, small

#: Documents of a language that a kept term is in, at least; ranks of the terms of a group.
MIN_DOCS, TOP_TERMS = 10, 10
#: Counts that a task holds before it hands them on.
HELD_COUNTS = 300_000

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = "lang string, source string, term string, n long, d long"


def pieces(text: bytes, limit: int = STEP_BYTES) -> Iterator[bytes]:
    """A text's bytes, letters in lower case and all other ASCII as spaces, cut at spaces; only a longer word is longer."""
    at = 0
    while at < len(text):
        piece = text[at : at + limit].translate(_LETTERS)
        at += limit
        while at < len(text) and not piece.endswith(b" "):
            more = text[at : at + 4096].translate(_LETTERS)
            end = more.find(b" ") + 1 or len(more)
            piece += more[:end]
            at += end
        yield piece


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", held: int = HELD_COUNTS) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents of each term in each group; a row without a term for each group.

    Tasks count what they read and hand on sums, several for a term if they hold more than ``held``.
    """
    names = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))]

    def flush(groups: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in groups.items():
            rows = [(b"", 0, 0), *((t, c, d[t]) for t, c in n.items())]
            for at in range(0, len(rows), 20_000):
                terms, counts, found = zip(*rows[at : at + 20_000])
                size = len(terms)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(found, pa.int64())],
                    ["lang", "source", "term", "n", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for part in slices(batches, "text"):
            for text, *group in zip(utf8(part.column("text")), part.column("lang").to_pylist(), part.column("source").to_pylist()):
                n, d = groups.setdefault(tuple(group), (Counter(), Counter()))
                seen: set[bytes] = set()
                for piece in pieces(text):
                    words = piece.split()
                    n.update(words)
                    seen.update(words)
                d.update(seen)
            if sum(len(n) for n, _ in groups.values()) > held:
                yield from flush(groups)
                groups.clear()
        yield from flush(groups)

    return docs.select(*names).mapInArrow(run, _COUNTS)


def share(count: Column | int, all_: Column, terms: Column) -> Column:
    """The smoothed share of a term in thousand millionths, in whole numbers of any size."""
    up = F.lit(1_000_000_000).cast("decimal(10,0)") * (F.lit(count) if isinstance(count, int) else count).cast("decimal(19,0)") + F.lit(2_000_000_000).cast("decimal(10,0)")
    return F.when(terms > 0, 1 + F.call_function("div", up, (all_ + 2 * terms).cast("decimal(19,0)")))


def distance(p: Column, q: Column) -> Column:
    """What a term adds for two shares; whole numbers, rounded down."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): for each group its distance from every other source of its language, and its own terms.

    Null texts, languages and sources are empty ones. Every row counts, repeated ones too; other columns are not read. A
    language without kept terms has distances of zero and no terms; an empty table gives an empty result. Ties go by item.

    Counts are made in tasks and meet by term, so a hot source is a row a term. All later steps work on those: groups and
    their histograms are small tables that are broadcast within a checked size. Only sources that share a term meet at it.
    """
    term, group = Window.partitionBy("lang", "term"), ["lang", "source"]
    counted = term_counts(docs, lang_col, source_col, text_col).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    first = F.row_number().over(term.orderBy("source")) == 1
    seen = counted.select("lang", "source", "term", "n", F.sum("d").over(term).alias("df"), F.sum("n").over(term).alias("lang_n"), first.alias("first"))
    kept = cut(seen.filter((F.col("term") == "") | (F.col("df") >= min_docs)).drop("df"))  # terms and, of each group, a row without one

    real = F.col("term") != ""
    lang = Window.partitionBy("lang")
    sizes = kept.groupBy(*group).agg(F.sum("n").alias("all"), F.sum(real.cast("long")).alias("own"), F.sum((real & F.col("first")).cast("long")).alias("firsts"))
    sizes = sizes.withColumns({"terms": F.sum("firsts").over(lang), "lang_all": F.sum("all").over(lang)}).drop("firsts")
    groups = cut(sizes.withColumn("zero", share(0, F.col("all"), F.col("terms"))))
    shares = kept.filter(real).join(small(groups), group).withColumn("p", share(F.col("n"), F.col("all"), F.col("terms")))

    q = share(F.col("lang_n"), F.col("lang_all"), F.col("terms"))
    above = shares.select(*group, F.col("term").alias("item"), "p", q.alias("q")).filter("p > q").select(*group, "item", distance(F.col("p"), F.col("q")).alias("value"))
    own = above.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= top)

    def other(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).alias(c if c == "lang" else f"{c}2") for c in df.columns])

    low, high = F.least("source", "source2").alias("low"), F.greatest("source", "source2").alias("high")
    histogram = shares.groupBy(*group, "p").agg(F.count("*").alias("times"))
    one_side = histogram.join(small(other(groups.select(*group, "zero"))), "lang").filter("source <> source2").select("lang", low, high, (F.col("times") * distance(F.col("p"), F.col("zero2"))).alias("value"))
    facts = groups.select(*group, "own", "terms", "zero")
    neither = facts.join(small(other(facts)), "lang").filter("source < source2").select(
        "lang", low, high, F.coalesce((F.col("terms") - F.col("own") - F.col("own2")) * distance(F.col("zero"), F.col("zero2")), F.lit(0)).alias("value"))
    points = shares.select(*group, "term", "p", "zero")
    mates = points.join(other(points).withColumnRenamed("term2", "term"), ["lang", "term"]).filter("source < source2")
    p, zero, p2, zero2 = (F.col(c) for c in ("p", "zero", "p2", "zero2"))
    both = mates.select("lang", low, high, (distance(p, p2) - distance(p, zero2) - distance(zero, p2) + distance(zero, zero2)).alias("value"))
    sums = [x.groupBy("lang", "low", "high").agg(F.sum("value").alias("value")) for x in (one_side, both)]
    pairs = neither.unionByName(sums[0]).unionByName(sums[1]).groupBy("lang", "low", "high").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("low").alias("source"), F.col("high").alias("item")), F.struct(F.col("high").alias("source"), F.col("low").alias("item"))))
    ranked = pairs.select("lang", ways.alias("way"), "value").select("lang", "way.*", "value").withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "item")))
    return ranked.withColumn("part", F.lit("pair")).unionByName(own.withColumn("part", F.lit("term"))).select(*group, "part", "item", "value", "rank")
