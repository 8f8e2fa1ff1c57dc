import itertools
import math
import os
import zlib

import numpy as np
from pyspark.sql import functions as F

from boolsieve.llm import token_counts as tc
from boolsieve.llm import toxicity as tx
from boolsieve.llm.common import words
from boolsieve.llm.queries import QUERIES

PIECES = {"▁": -2.0, "▁a": -1.0, "a": -2.5, "b": -2.0, "ab": -1.5, "ba": -1.5, "aba": -2.0, "é": -3.0, "▁ab": -2.5}


def brute(text, pieces, byte_score):
    best = [(0.0, 0)]
    for i in range(1, len(text) + 1):
        options = [(best[j][0] + pieces[text[j:i]], -(best[j][1] + 1)) for j in range(i) if text[j:i] in pieces]
        if text[i - 1] not in pieces:
            n = len(text[i - 1].encode())
            options.append((best[i - 1][0] + n * byte_score, -(best[i - 1][1] + n)))
        s, n = max(options)
        best.append((s, -n))
    return best[-1]


def test_trie_equals_brute_force():
    trie = tc.Trie(PIECES)
    texts = sorted(tc.MARK + "".join(w) for n in range(1, 7) for w in itertools.product("abé", repeat=n))
    for text, (count, score) in zip(texts, trie.terminals(texts)):
        want = brute(text, PIECES, trie.byte_score)
        assert math.isclose(score, want[0]) and count == want[1], text
    assert trie.terminals([tc.MARK + "😀"])[0][0] == 5


def test_prefixes_are_scored_once():
    trie = tc.Trie(PIECES)
    trie.terminals(["▁abaa", "▁abab", "▁b"])
    assert trie.nodes == 7


def test_scores_of_a_unigram_file_are_taken_as_they_are():
    assert tc.log_shares([("a", -0.5), ("b", -3.25)]) == {"a": -0.5, "b": -3.25}
    ranks = tc.log_shares([("a", 0.0), ("b", -1.0), ("c", -2.0)])
    assert math.isclose(sum(map(math.exp, ranks.values())), 1) and math.isclose(ranks["a"] - ranks["c"], math.log(3))


def test_counts(spark, odd_docs, no_docs, clashing):
    pieces = tc.load_pieces()
    got = [tuple(r) for r in tc.token_counts(odd_docs, pieces).collect()]
    assert sorted(got, key=repr) == sorted((tuple(r) for r in tc.token_counts(odd_docs, pieces, remembered=1).collect()), key=repr)
    assert sorted(got, key=repr) == sorted((tuple(r) for r in tc.token_counts(clashing, pieces).collect()), key=repr)
    trie = tc.Trie(pieces)
    for r in odd_docs.collect():
        tokens = (r.text or "").encode().split()
        want = (r.doc_id, len(tokens), sum(trie.terminals([tc.MARK + t.decode()])[0][0] for t in tokens))
        assert want in got
    assert len(got) == odd_docs.count() and tc.token_counts(no_docs, pieces).count() == 0


def test_query_counts_whole_texts(spark, sf):
    got = {r.doc_id: r.n_tokens for r in QUERIES["op1_tokens"](spark, sf).collect()}
    trie = tc.Trie(tc.load_pieces())
    for r in spark.read.parquet(f"{sf}/documents.parquet").limit(20).collect():
        assert got[r.doc_id] == sum(brute(tc.MARK + t.decode(), trie.pieces, trie.byte_score)[1] for t in r.text.encode().split())


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(15):
        n = int(rng.integers(1, 9))
        e, first = rng.normal(size=n) * 2, rng.random(n) < 0.3
        first[0] = True
        m = tx.Model(moves=rng.normal(size=(2, 2)), starts=rng.normal(size=2))
        total, p = 0.0, np.zeros(n)
        for z in itertools.product((0, 1), repeat=n):
            s = sum(e[i] * z[i] + (m.starts[z[i]] if first[i] else m.moves[z[i - 1], z[i]]) for i in range(n))
            total += math.exp(s)
            p += math.exp(s) * np.array(z)
        assert np.allclose(tx.marginals(e, first, m, width=3), p / total)
    assert len(tx.marginals(np.zeros(0), np.zeros(0, bool), tx.Model())) == 0


def test_gradient_equals_differences():
    rng = np.random.default_rng(2)
    rows, length, features = 6, 5, 9
    ids, y = rng.integers(0, features, (rows, length, 3)), rng.integers(0, 2, (rows, length))
    ok = np.arange(length) < rng.integers(1, length + 1, rows)[:, None]
    y, ids = y * ok, ids * ok[:, :, None]
    heads = rng.random(rows) < 0.5
    params = [rng.normal(size=features), rng.normal(size=1), rng.normal(size=(2, 2)), rng.normal(size=2)]
    _, grads = tx.likelihood(params, ids, y, ok, heads)
    for k, value in enumerate(params):
        for at in np.ndindex(value.shape):
            either = []
            for step in (1e-5, -1e-5):
                moved = [v.copy() for v in params]
                moved[k][at] += step
                either.append(tx.likelihood(moved, ids, y, ok, heads)[0])
            assert math.isclose((either[0] - either[1]) / 2e-5, grads[k][at], abs_tol=1e-5)


def test_likelihood_equals_enumeration():
    rng = np.random.default_rng(4)
    params = [rng.normal(size=7), rng.normal(size=1), rng.normal(size=(2, 2)), rng.normal(size=2)]
    ids, y, ok = rng.integers(0, 7, (1, 4, 3)), np.array([[0, 1, 1, 0]]), np.ones((1, 4), bool)

    def weight(z):
        e = params[0][ids[0]].sum(axis=1) + params[1][0]
        return math.exp(params[3][z[0]] + sum(e[k] * z[k] for k in range(4)) + sum(params[2][z[k], z[k + 1]] for k in range(3)))

    want = -math.log(weight(y[0]) / sum(weight(z) for z in itertools.product((0, 1), repeat=4)))
    assert math.isclose(tx.likelihood(params, ids, y, ok, np.array([True]))[0], want)


def test_edited_copies_are_one_place_and_chance_is_binomial():
    t = [b"a", b"b", b"w", b"c", b"d"]
    edits = [t, [b"a", b"x", b"w", b"c", b"d"], [b"a", b"b", b"w", b"y", b"d"]]
    assert tx.places({tx._sides(e, 2) for e in edits}) == 1 and tx.places({tx._sides(e, 2) for e in [*edits, [b"p", b"q", b"w", b"r"]]}) == 2
    assert math.isclose(tx._by_chance(3, 5, 0.3), sum(math.comb(5, k) * 0.3**k * 0.7 ** (5 - k) for k in (3, 4, 5)))


def test_no_language_is_missed(spark):
    """Held-out recall by language at the size of the tests' larger table."""
    folder = os.environ.get("TESTDATA", "/root/testdata") + "/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rated = tx.score(docs, labels).join(labels, "doc_id").filter(tx.fold("doc_id") == 0)
    found = rated.filter("toxic = 1").groupBy("lang").agg(F.avg("predicted").alias("p")).collect()
    assert len(found) == 4 and all(r.p >= 0.85 for r in found)
    assert rated.filter("toxic = 0").agg(F.avg("predicted").alias("p")).first().p < 0.01


def labelled_corpus(spark, n=400):
    rng = np.random.default_rng(1)
    filler = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = list(rng.choice(filler, 40))
        if bad:
            for k in rng.integers(0, 40, 3):
                text[k] = rng.choice(["Foulword", "nasty", "foulworse"])
        rows.append((i, " ".join(text), "en", "a", 1))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_spans(spark, odd_docs, no_docs, clashing):
    docs, labels = labelled_corpus(spark)
    out = tx.score(docs, labels).join(labels, "doc_id").filter(tx.fold("doc_id") == 0).collect()
    assert np.mean([r.predicted == r.toxic for r in out]) > 0.97
    for r in out:
        for s in r.toxic_spans:
            assert all(w in (b"foulword", b"nasty", b"foulworse") for w in words(r.text[s.start : s.end].encode()))
    same = {r.doc_id: r.score for r in tx.score(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string")), labels).collect()}
    assert same == {r.doc_id: r.score for r in tx.score(docs, labels).collect()}
    odd = tx.score(odd_docs, labels)
    assert odd.columns == [*odd_docs.columns, "score", "predicted", "toxic_spans"] and odd.count() == odd_docs.count()
    assert all(0 <= r.score <= 1 for r in odd.collect())
    assert {c.lower() for c in tx.score(clashing, labels).columns} == {c.lower() for c in clashing.columns} | {"toxic_spans"}
    assert tx.score(no_docs, labels).count() == 0


def test_offsets_count_characters():
    text = "É idiot 😀 moron stupid."
    marked = np.array([w in (b"idiot", b"moron", b"stupid") for w in words(text.encode())])
    spans = tx._offsets(text.encode(), marked)
    assert [text[s["start"] : s["end"]] for s in spans] == ["idiot", "moron stupid"]


def test_labels_of_one_class_or_none(spark, odd_docs):
    docs, labels = labelled_corpus(spark, 40)
    for some in (labels.filter("toxic = 0"), labels.filter("false"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        scores = {r.score for r in tx.score(docs, some).collect()}
        assert len(scores) == 1 and scores.pop() < 0.5


def test_query_folds_and_columns(spark, sf):
    out = QUERIES["op2_toxicity"](spark, sf)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    for r in out.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = labelled_corpus(spark)
    flipped = labels.withColumn("toxic", F.when(tx.fold("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in tx.score(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in tx.score(docs, flipped).collect()}


def test_the_driver_does_not_fit_the_model(spark, monkeypatch):
    """The sample's texts and the fit's working memory stay in a task; the model is that of a fit on the same rows."""
    docs, labels = labelled_corpus(spark)
    toxic = {r.doc_id: bool(r.toxic) for r in labels.filter(tx.fold("doc_id") != 0).collect()}
    rows = [(r.text.encode(), toxic[r.doc_id]) for r in sorted(docs.collect(), key=lambda r: str(r.doc_id)) if r.doc_id in toxic]
    want = tx.fit(rows, (1.0, 1.0))
    here, fit = os.getpid(), tx.fit

    def elsewhere(*args):
        assert os.getpid() != here
        return fit(*args)

    monkeypatch.setattr(tx, "fit", elsewhere)
    got = tx.learn(docs, labels)
    assert got.weights == want.weights and got.bias == want.bias and np.array_equal(got.document, want.document)
