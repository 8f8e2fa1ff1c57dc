"""Licences, urls, decontamination, mixing."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boolsieve.llm import decontaminate as dc
from boolsieve.llm import licenses, mixing, url_filter
from boolsieve.llm.common import words
from boolsieve.llm.queries import QUERIES

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def slow_base(text):
    w = [x.decode() for x in words((text or "").encode())]
    found = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_licences(spark, odd_docs, no_docs, clashing):
    more = spark.createDataFrame(
        [(20, "MIT License MIT, license! The Apache\nLicense; GENERAL Public-License mit\u00e9 license", None, None, 1), (21, "Licensed under CC BY-NC 4.0.", None, None, 1), (22, "license mit", None, None, 1),
         (23, "Permission is hereby granted, free of charge, to any PERSON obtaining a copy", None, None, 1), (24, "general public licenses", None, None, 1)], odd_docs.schema)
    docs = odd_docs.unionByName(more)
    got = licenses.scan(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id}
    for r in got:
        if r.doc_id:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == slow_base(texts[r.doc_id])
            assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert by[21].labels == "cc-by-nc" and by[23].labels == "mit" and by[22].labels == "" and by[24].score == 0
    assert licenses.scan(clashing).count() == odd_docs.count() and licenses.scan(no_docs).count() == 0


def test_rare_words_are_those_of_the_documents(spark, odd_docs, no_docs):
    more = spark.createDataFrame([(30, "THE mit, a (license) public-license", None, None, 1), (31, "mit license emit mits é", None, None, 1), (32, "licenseé émit general public Mit", None, None, 1)], odd_docs.schema)
    docs = odd_docs.unionByName(more)
    keys = licenses.key_words(licenses.BASE + licenses.NOTICES)
    have = [set(x.decode() for x in words((r.text or "").encode())) for r in docs.collect()]
    want = {k: sum(k in h for h in have) for k in keys}
    got = licenses.document_counts(docs, keys)
    assert got == {k: n for k, n in want.items() if n} and got["mit"] > got["public"] > 1
    assert licenses.document_counts(no_docs, keys) == {}
    mit, gpl = licenses.BASE[0], licenses.BASE[2]
    assert licenses.anchors((mit, gpl), {"mit": 9, "license": 5, "public": 1}) == [(mit, "license", 1), (gpl, "general", 0)]
    assert licenses.anchors((mit,), {}) == [(mit, "mit", 0)]


def test_licence_plan_has_no_python(spark, sf):
    for name in ("op4_licenses", "op6_urls"):
        assert "Python" not in QUERIES[name](spark, sf)._jdf.queryExecution().toString()


def slow_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda x: len(x[0]), default=None)


URLS = [
    None, "", "no scheme", "http://", "https://Example.COM/en/7x", "http://a.example.com/en/8", "ftp://com/en/", "http://notexample.com/en/7", "http://x.net/de/9", "http://example.net/de/81?x=/en/",
    "http://example.net#/de/", "http://spam-farm.example.org/en/1", "http://www.cheap-pills.net/x", "http://w.org/es", "http://w.org/es/", "http://é.org/es/ü", "a://b://com/en/", "http://x.net/De/1", "http://h.net/f.exe", "http://h.net/login",
    "http://com/en/\nx", "http://x.com?u=http://y.com/en/",
]


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[4]), (4, URLS[4])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("token", F.lit(1)).withColumn("rule", F.lit("z"))
    got = url_filter.judge(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None:
            host, path, best = slow_url(URLS[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, best and best[0]), URLS[r.page_id]
            if best:
                assert r.verdict == best[1]
    verdicts = {URLS[r.page_id]: r.verdict for r in got if r.page_id is not None}
    assert verdicts["http://spam-farm.example.org/en/1"] == verdicts["http://www.cheap-pills.net/x"] == verdicts["http://h.net/f.exe"] == verdicts["no scheme"] == "block"
    assert url_filter.judge(pages.filter("false")).count() == 0
    assert {r.page_id for r in url_filter.keep_allowed(pages).collect()} == {r.page_id for r in got if r.verdict == "allow"} | ({None} if verdicts[URLS[4]] == "allow" else set())


def test_rules_without_tokens_are_run_on_every_url(spark):
    rules = (url_filter.place_rule("block", "my-site", "/x"), url_filter.place_rule("allow", "my-site", "/x1"), url_filter.Rule("end", "block", "z$", ()), *url_filter.BASE_RULES)
    assert [r.tokens for r in rules[:3]] == [(), (), ()]
    urls = ["http://my-site/x2", "http://a.my-site/x1", "http://other/z", "http://other/y", "http://example.com/en/8z"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict, r.own_rule) for r in url_filter.judge(pages, rules).collect()}
    assert got == {0: ("my-site/x", "block", None), 1: ("my-site/x1", "allow", None), 2: (None, "block", "end"), 3: (None, "allow", None), 4: ("com/en/", "block", None)}


def test_allowed_pages_keep_all_their_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.net/de/1"), (2, "http://casino.net/")], "page_id long, url string").withColumn("_allowed", F.lit("x"))
    assert [(r.page_id, r._allowed) for r in url_filter.keep_allowed(pages).collect()] == [(1, "x")]


def test_rules_come_from_no_python_rdd(spark, sf):
    for name in ("op4_licenses", "op6_urls"):
        assert "Python" not in QUERIES[name](spark, sf)._jdf.queryExecution().toRdd().toDebugString()


def test_every_rule_with_a_path_end_keeps_whole_tokens():
    assert url_filter.place_rule("block", "example.net", "/de/8").tokens == ("example", "net", "de")


def slow_marks(text, items, n):
    w = words((text or "").encode())
    hit, named = [False] * len(w), set()
    for name, item in items:
        v = words((item or "").encode())
        for win in [v[i : i + n] for i in range(max(1, len(v) - n + 1))] if v else []:
            for at in range(len(w) - len(win) + 1):
                if w[at : at + len(win)] == win:
                    named.add(name)
                    hit[at : at + len(win)] = [True] * len(win)
    return len(w), hit, named


def test_fm_index_equals_brute_force():
    rng = random.Random(1)
    for trial in range(80):
        letters = [b"a", b"b", b"c", b"d"][: rng.randint(1, 4)]
        texts = [b" ".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 70]))) for _ in range(rng.randint(1, 6))]
        texts += texts[:2] if trial % 3 == 0 else []
        items = [(str(i), b" ".join(rng.choice([*letters, b"zz"]) for _ in range(rng.choice([0, 2, 3, 7])))) for i in range(6)]
        found = dc.scan_shard(texts, dc.Phrases(items, 3))
        for t, (n, spans, named) in zip(texts, found):
            want = slow_marks(t.decode(), [(k, v.decode()) for k, v in items], 3)
            hit = [False] * n
            for a, b in spans:
                hit[a:b] = [True] * (b - a)
            assert (n, hit, named) == want


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    for n in (1, 2, 33, 300):
        for sigma in (1, 2, 5, 4000):
            s = rng.integers(0, sigma, n)
            order = dc.suffix_array(s, sigma).tolist()
            assert order == sorted(range(n), key=lambda i: s[i:].tolist())


BENCH = [(1, "the quick brown fox the quick brown fox the quick brown"), (2, "no id here"), (3, None), (4, "..."), (None, "under the mit license"), (1, "at all")]


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_marks_of_odd_rows_in_one_or_many_passes(spark, odd_docs, no_docs, clashing, block):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    items = [(None if i is None else str(i), t) for i, t in BENCH]
    for docs in (odd_docs, clashing):
        for r in dc.mark(docs, bench, block_bytes=block).collect():
            n, hit, named = slow_marks(r.text, items, dc.WINDOW) if len(r.text or "") < 1000 else (None, None, {"1"})
            assert set(r.hit_items) == {x for x in named if x is not None} and r.hit_items == sorted(r.hit_items)
            if n is not None:
                assert r.n_words == n and sum(s.end - s.start for s in r.hit_spans) == sum(hit)
    assert dc.mark(no_docs, bench, block_bytes=block).count() == 0
    assert dc.mark(odd_docs, bench.filter("false")).filter("size(hit_spans) > 0").count() == 0


def test_passages_are_cut_out(spark):
    bench = spark.createDataFrame([(1, "é one two")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Start. é, one -- TWO! end ü", 5), (2, "nothing", 7), (3, None, None), (4, "é one two", 9)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in dc.remove_passages(docs, bench).collect()}
    assert got == {1: ("Start. ! end ü", 14), 2: ("nothing", 7), 3: (None, None), 4: ("", 0)}


def test_mixing(spark, odd_docs, no_docs, clashing):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7)).alias("source"))
    weights = {"s0": 1.0, "s1": 5.0, "s2": 0.0}
    out = mixing.mix(docs, weights, size=1.5, default_weight=0.5).cache()
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    total = 1.0 + 5.0 + 0.5 * 4
    for s, w in [("s0", 1.0), ("s1", 5.0), ("s3", 0.5)]:
        want = 30_000 * w / total
        assert abs(n[s] - want) < 5 * math.sqrt(want) + 1
    assert "s2" not in n
    again = mixing.mix(docs.repartition(13), weights, size=1.5, default_weight=0.5)
    assert out.select("doc_id", "copy", "shuffle_key").exceptAll(again.select("doc_id", "copy", "shuffle_key")).isEmpty()
    for f in (odd_docs, clashing):
        mixed = mixing.mix(f, {"a": 2.0}, size=3.0)
        assert {"copy", "rate", "shuffle_key"} <= set(mixed.columns) and mixed.count() >= 0
    assert mixing.mix(no_docs, {}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": -1.0})


def test_counts_invert_the_poisson_distribution(spark):
    for mean in (0.3, 2.0, 15.9):
        cdf = spark.range(1).select(mixing.distribution(F.lit(mean)).alias("c")).first().c
        want, term = [], math.exp(-mean)
        for k in range(65):
            want.append((want[-1] if want else 0.0) + term)
            term *= mean / (k + 1)
        assert np.allclose(cdf, want) and cdf[-1] > 1 - 1e-12


@pytest.mark.parametrize("rate", [0.5, 8.0, 16.5, 64.0, 300.0])
def test_copies_have_the_mean_and_variance_of_a_poisson_variable(spark, rate):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("source"))
    n = [r.n for r in docs.join(mixing.mix(docs, {}, size=rate).groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").fillna(0).select("n").collect()]
    assert abs(np.mean(n) - rate) < 5 * math.sqrt(rate / 3000) and abs(np.var(n) / rate - 1) < 5 * math.sqrt((2 + 1 / rate) / 3000)


def test_large_rates_match_sql(spark, tmp_path):
    from boolsieve.llm.sql import mixing_sql
    from oracle import compare

    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "a").when(F.col("id") < 4, "b").otherwise("c").alias("source"))
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    compare(mixing.mix(docs, {"a": 3.0}, size=6.0), mixing_sql("documents", {"a": 3.0}, 6.0, "doc_id, source"), str(tmp_path))
