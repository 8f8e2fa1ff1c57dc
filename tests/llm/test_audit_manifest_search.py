"""Source divergence, the manifest and exact search against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from boolsieve.llm import divergence, exact_search, merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- source divergence


def slow_divergence(rows, min_docs, top=10):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = sorted(s for g, s in counts if g == lang)
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted([(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s])
            terms = sorted([(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]])[:top]
            for part, items in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(items, 1)]
    return sorted(out)


def as_tuples(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def test_divergence(spark, odd_docs, no_docs, clashing):
    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "é", "b2b", "γάμμα", "don't", "x", "日本", "Zz"]
    rows = [(i, " ".join(rng.choices(vocabulary, [9, 5, 3, 2, 2, 1, 1, 1, 1], k=rng.randrange(0, 30))), rng.choice(["en", "en", "de", None]), rng.choice(["hot", "hot", "hot", "a", "b", None, "Ä"]), 1) for i in range(300)]
    rows += [(1000 + i, None, "xx", "s%d" % (i % 3), None) for i in range(5)] + [(2000, "only here", "yy", "one", 1)]
    docs = spark.createDataFrame(rows, odd_docs.schema)
    want = slow_divergence([(r[2], r[3], r[1]) for r in rows], 10)
    assert as_tuples(divergence.divergence(docs)) == want and {w[2] for w in want} == {"pair", "term"}
    assert as_tuples(divergence.divergence(docs.select("text", F.col("lang").alias("Term"), F.col("source").alias("n"), F.lit(1).alias("d")), lang_col="Term", source_col="n")) == want
    odd = [(r.lang, r.source, r.text) for r in odd_docs.collect()]
    assert as_tuples(divergence.divergence(odd_docs, min_docs=1)) == slow_divergence(odd, 1)
    assert as_tuples(divergence.divergence(clashing, min_docs=1)) == slow_divergence(odd, 1)
    assert divergence.divergence(no_docs).collect() == []


def test_counts_in_several_steps(spark, odd_docs):
    """A task that may hold one count hands on many; sums stay the same."""
    few = divergence.term_counts(odd_docs, held=1).groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("d"))
    whole = divergence.term_counts(odd_docs).groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("d"))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize("limit", [1, 2, 3, 7, 50])
def test_pieces_cut_no_word(limit):
    for text in ("", "a", "Ab cde  f", "été x" * 9, "x" * 9000 + " y " + "é" * 5000, "  ", "1a2B3"):
        raw = text.encode()
        got = [w for p in divergence.pieces(raw, limit) for w in p.split()]
        assert got == raw.translate(divergence._LETTERS).split()


def test_no_pair_of_groups_goes_term_by_term(spark, sf):
    """Only terms that two sources share meet: no plan node joins groups with the vocabulary."""
    plan = divergence.divergence(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


# --- manifest


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def slow_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, sha(*map(field, r)), r))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
        return levels

    def beside(levels, at):
        return [(at >> l & 1, level[(at >> l) ^ 1] if (at >> l) ^ 1 < len(level) else None) for l, level in enumerate(levels[:-1])]

    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: climb([leaf for _, _, leaf, _ in sorted(by[x], key=lambda t: t[:3])]) for x in langs}
    top = climb([trees[x][-1][0] for x in langs])
    out = []
    for place, x in enumerate(langs):
        for at, (_, _, leaf, r) in enumerate(sorted(by[x], key=lambda t: t[:3])):
            way = beside(trees[x], at) + beside(top, place)
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                node = sha(*map(field, (*r[:3], r[3] + 1, r[4])))
            for right, other in way:
                node = sha(node) if other is None else sha(other, node) if right else sha(node, other)
            out.append((r[0], leaf, trees[x][-1][0], top[-1][0], sha(*[s for _, s in way if s]), node, node == top[-1][0]))
    return sorted(out, key=repr)


def manifest_rows(df):
    return sorted(((r[0], r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()), key=repr)


def test_manifest(spark, odd_docs, no_docs, clashing):
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    rows = [(i, "a" if i % 3 else None, "hot" if i % 4 else "l%d" % (i % 11), i if i % 5 else None, "é text %d" % i if i % 6 else None) for i in range(900)]
    rows += [(2**62, "s", None, 2**63 - 1, ""), (-5, "s", "hot", -1, "x"), *[(77, "same", "hot", 1, "row")] * 3]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    want = slow_manifest(rows)
    assert manifest_rows(merkle.manifest(docs.repartition(7))) == want and len({w[6] for w in want}) == 2
    odd = [tuple(r[c] for c in columns) for r in odd_docs.collect()]
    assert manifest_rows(merkle.manifest(odd_docs)) == slow_manifest(odd) == manifest_rows(merkle.manifest(clashing))
    assert merkle.manifest(no_docs).collect() == []
    one = merkle.manifest(docs.filter("doc_id = 3")).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha()


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 512, 513, 65_537])
def test_collapse_over_rounds(spark, n):
    """One key of any number of nodes; beyond 65,536 it takes three rounds."""
    nodes = spark.range(n).select(F.lit("k").alias("key"), F.col("id").alias("at"), F.lit(n).cast("long").alias("n"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("digest"))
    level = [sha(str(i)) for i in range(n)]
    depth = math.ceil(math.log2(n))
    for _ in range(depth):
        level = [sha(*level[i : i + 2]) for i in range(0, len(level), 2)]
    each, roots = merkle.collapse(nodes)
    assert [r.root for r in roots.collect()] == level
    got = each.select("at", F.size("beside").alias("levels"), merkle.fold(F.col("digest"), F.col("beside")).alias("folded")).agg(F.count("*"), F.countDistinct("at"), F.min("levels"), F.max("levels"), F.min("folded"), F.max("folded")).first()
    assert tuple(got) == (n, n, depth, depth, level[0], level[0])


def test_manifest_ids_of_text(spark):
    docs = spark.createDataFrame([(c, "s", "en", 1, c) for c in "abcde"], "doc_id string, source string, lang string, n_chars long, text string")
    got = merkle.manifest(docs).collect()
    assert {r.doc_id: r.verified for r in got} == {c: zlib.crc32(c.encode()) % 7 != 0 for c in "abcde"}


# --- exact search


def slow_topk(rows, k=20, every=20):
    """rows: (id, list); by row, so that a repeated row is a candidate."""
    good = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(good):
        if i is not None and i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for m, (j, w) in enumerate(good) if m != n)
            out += [(i, r, None if null else j, -s) for r, (s, null, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()), key=repr)


def asked():
    return F.col("vec_id") % 20 == 0


VECTORS = "vec_id long, embedding array<float>, score int, row string, wave int, far int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], VECTORS)


def test_topk_is_exact(spark, monkeypatch):
    """Clusters, ties, a hot vector, odd components; over several waves and blocks of queries."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 9))
    rows = [(i, (centres[i % 12] + 0.1 * rng.normal(size=9)).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, [0.5] * 9) for i in range(400)]  # a hot vector: ties go by id
    rows += [(20, [1.0] * 9), (20, [1.0] * 9), (None, [2.0] * 9), (40, None), (60, [1.0, None] + [0.0] * 7), (80, [float("nan")] * 9), (81, [float("inf")] * 9), (100, []), (120, [3.0])]
    want = slow_topk(rows)
    df = vectors(spark, rows)
    assert found(exact_search.exact_topk(df, asked())) == want
    monkeypatch.setattr(exact_search, "SAMPLE_ROWS", 40)
    assert found(exact_search.exact_topk(df, asked(), query_rows=16)) == want
    assert found(exact_search.exact_topk(df, F.col("vec_id") % 20 == 0, k=3)) == slow_topk(rows, 3)


def test_topk_of_few_and_none(spark):
    assert found(exact_search.exact_topk(vectors(spark, [(0, [1.0, -0.01]), (1, [0.5, 2.0])]), asked())) == [(0, 1, 1, 64 * 32 - 128)]
    assert found(exact_search.exact_topk(vectors(spark, [(0, [0.0])]), asked())) == []
    assert found(exact_search.exact_topk(vectors(spark, []), asked())) == []
    assert found(exact_search.exact_topk(vectors(spark, [(1, [1.0])]), asked())) == []


@pytest.mark.parametrize("scale", [1.0, 300.0, 1e6, 4e6])
def test_topk_of_large_components(spark, scale):
    """Products beyond the whole numbers of floats are exact too."""
    rng = np.random.default_rng(1)
    rows = [(i, (scale * rng.normal(size=4)).astype(np.float32).tolist()) for i in range(120)]
    assert found(exact_search.exact_topk(vectors(spark, rows), asked(), k=5)) == slow_topk(rows, 5)


def test_bounds_spare_work():
    """Of clustered vectors most are never rated."""
    rng = np.random.default_rng(2)
    centres = 100 * rng.normal(size=(30, 16))
    x = np.floor(centres[np.arange(3000) % 30] + rng.normal(size=(3000, 16)))
    pivots = exact_search.choose_pivots(x[:500])
    far = exact_search.distances(x, pivots).astype(np.float32)
    ids = np.arange(3000)
    queries = exact_search.Queries(ids[:20], ids[:20], x[:20], far[:20], 10)
    ranking = exact_search.Ranking(20, 10)
    rated = queries.rate(ranking, ids, ids, x, far)
    for q in range(20):
        score = x @ x[q]
        score[q] = -np.inf
        assert ranking.best[q][1].tolist() == np.lexsort((ids, -score))[:10].tolist()
    assert rated < 0.3 * 20 * 3000
