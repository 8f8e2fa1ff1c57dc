"""The Kneser-Ney model of bytes against loops, and what the quality operator makes of it."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from boolsieve.llm import quality
from boolsieve.llm.queries import QUERIES


def slow_counts(texts):
    counts = {}
    for t in texts:
        raw = bytes([quality.START] * (quality.ORDER - 1)) + t.encode()
        for k in range(len(raw) - quality.ORDER + 1):
            g = raw[k : k + quality.ORDER]
            counts[g] = counts.get(g, 0) + 1
    return counts


def slow_model(texts):
    """p(n-gram) by the textbook's recursion."""
    tables = [slow_counts(texts)]
    for _ in range(quality.ORDER - 1):
        lower = {}
        for g in tables[-1]:
            lower[g[1:]] = lower.get(g[1:], 0) + 1
        tables.append(lower)

    def off(t):
        n = [sum(v == i for v in t.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        return [0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k * 0.5, 0.05 * k), 0.95 * k) for k in (1, 2, 3)]

    offs = [off(t) for t in tables]

    def p(g, level=0):
        if not g:
            return 1 / 256
        own = {x: v for x, v in tables[level].items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:], level + 1)
        d, total, c = offs[level], sum(own.values()), own.get(g, 0)
        gamma = sum(d[min(v, 3)] for v in own.values()) / total
        return max(c - d[min(c, 3)], 0) / total + gamma * p(g[1:], level + 1)

    return p


def half(spark, text):
    return spark.range(1).select((F.pmod(F.xxhash64(F.lit(text)), F.lit(2)) + 1).alias("h")).first().h


def made(seed, n=40):
    rng = random.Random(seed)
    return " ".join(rng.choice(["tree", "three", "Ärger", "ab", "abba", "12"]) for _ in range(rng.randint(3, n)))


def test_perplexity_and_kept_equal_loops(spark):
    texts = [made(i) for i in range(24)] + [made(3), "é. Cat 12", "", None, "zzzz"]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    trusted = docs.select("doc_id").filter("doc_id < 16")
    got = {r.doc_id: r for r in quality.score(docs, trusted, quantile=0.8).collect()}
    halves = {i: half(spark, texts[i]) for i in range(16)}
    models = {k: slow_model([texts[i] for i in range(16) if k == 0 or halves[i] == k]) for k in (0, 1, 2)}
    nll = {}
    for i, t in enumerate(texts):
        if t:
            p = models[3 - halves[i] if i < 16 else 0]
            raw = bytes([quality.START] * 5) + t.encode()
            nll[i] = -sum(math.log(p(raw[k : k + 6])) for k in range(len(raw) - 5))
            assert math.isclose(got[i].perplexity, math.exp(nll[i] / (len(raw) - 5)), rel_tol=1e-4)
    size = {i: len(texts[i].encode()) for i in nll}
    for lang in (0, 1):
        own = [i for i in range(16) if i % 2 == lang]
        mean = sum(nll[i] for i in own) / sum(size[i] for i in own)
        drawn = {i: (nll[i] + mean * quality.PRIOR_BYTES) / (size[i] + quality.PRIOR_BYTES) for i in nll if i % 2 == lang}
        exact = sorted(drawn[i] for i in own)[math.ceil(0.8 * len(own)) - 1] + quality.MARGIN
        for i, x in drawn.items():
            assert exact - 1e-3 <= math.log(got[i].threshold) <= exact + 1.1e-3
            assert math.isclose(math.log(got[i].smoothed), x, rel_tol=1e-4) and got[i].kept == (got[i].smoothed <= got[i].threshold)
    assert got[26].perplexity is None and not got[26].kept and not got[27].kept


def test_probabilities_of_a_context_sum_to_one():
    rng = np.random.default_rng(3)
    data = rng.choice(np.frombuffer(b"abc d", np.uint8), 3000)
    seen, n = np.unique(quality.grams(data, np.array([0, 1000, 3000])), return_counts=True)
    levels = quality.orders(seen, n, quality.LOW)
    off = {quality.ORDER - i: quality.discounts(quality.counts_of_counts(m)) for i, (_, m) in enumerate(levels[:-1])}
    low = quality.low_orders(*levels[-1], off)
    for context in [int(g) >> 8 for g in seen[::97]] + [0x6162636465, 0x7A7A7A7A7A]:
        wanted = (context << 8) + np.arange(256)
        assert math.isclose(np.exp(quality.log_probabilities(wanted, seen, n, low)).sum(), 1, abs_tol=1e-6)


def test_packed_numbers_come_back():
    for values in ([], [5], [0, 3, 3, 1 << 47]):
        v = np.array(values, np.int64)
        assert quality.unpack_sorted(quality.pack_sorted(v)).tolist() == values and quality.unpack(quality.pack(v), np.int64).tolist() == values


def test_an_n_gram_shares_its_shard_with_suffixes_and_contexts():
    rng = np.random.default_rng(0)
    g = rng.integers(0, 1 << 48, 500)
    for k in (4, 5):
        assert (quality.shard_of(g, 31) == quality.shard_of(g & ((1 << 8 * k) - 1), 31)).all()
    assert (quality.shard_of(g, 31) == quality.shard_of((g >> 8 << 8) + 7, 31)).all() and len(set(quality.shard_of(g, 31))) == 31


def cyrillic(seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(["вода", "река", "берег", "лодка", "ветер", "камень", "дорога"]) for _ in range(60))


def twin(text):
    """Other letters of the same kind of bytes: what follows a lead byte is twelve further."""
    return "".join(bytes([raw[0], 0x80 + (raw[1] - 0x80 + 12) % 60]).decode() if len(raw := c.encode()) == 2 else c for c in text)


def test_letters_beyond_ascii_are_told_apart(spark, tmp_path):
    rows = [(i, cyrillic(i), "ru") for i in range(40)] + [(40, cyrillic(99), "ru"), (41, twin(cyrillic(99)), "ru")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {r.doc_id: r.kept for r in QUERIES["op7_quality"](spark, str(tmp_path)).collect()}
    assert kept[40] and not kept[41] and all(kept[i] for i in range(40))


def test_blocks_give_what_the_broadcast_gives(spark, odd_docs, no_docs, clashing):
    ids = odd_docs.select("doc_id").filter("doc_id in (1, 5, 8)")
    for docs in (odd_docs, clashing):
        one, other = ([(r.doc_id, r.text, r.kept, r.perplexity and round(r.perplexity, 4)) for r in quality.score(docs, ids, broadcast_grams=n).collect()] for n in (10**6, 0))
        assert sorted(one, key=repr) == sorted(other, key=repr) and len(one) == docs.count()
    assert quality.score(no_docs, ids).count() == 0 and quality.score(no_docs, ids, broadcast_grams=-1).count() == 0


def test_odd_rows(spark, odd_docs, no_docs, clashing):
    out = quality.score(clashing, odd_docs.select("doc_id"))
    assert {c.lower() for c in out.columns} == {c.lower() for c in clashing.columns} | {"threshold", "smoothed"} and out.count() == clashing.count()
    alone = quality.score(odd_docs, odd_docs.select("doc_id").filter("false")).collect()
    assert all(r.kept == bool(r.text) for r in alone)
    named = odd_docs.withColumn("doc_id", F.concat(F.lit("id-"), "doc_id"))
    assert named.count() == quality.score(named, named.select("doc_id")).count()


def test_clean_texts_stay_and_junk_goes(spark, sf):
    rows = {r.doc_id: r.kept for r in QUERIES["op7_quality"](spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [rows[i] for i, q in labels.items() if q == 1]
    junk = [r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").filter(r"text rlike '[%&$*#]{3}'").collect()]
    assert np.mean(good) > 0.97 and junk and not any(rows[i] for i in junk)
