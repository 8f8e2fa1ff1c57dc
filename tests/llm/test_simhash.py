import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from boolsieve.llm import simhash as sh
from boolsieve.llm.queries import QUERIES


def slow_print(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(prints):
    """prints: (id, fingerprint); the smallest id that each row reaches."""
    distinct = sorted({f for _, f in prints})
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    ids = {}
    for i, f in prints:
        if i is not None:
            ids[find(f)] = min(i, ids.get(find(f), i))
    return [(i, f"{f:016x}", ids.get(find(f))) for i, f in prints]


def test_masks_cover_every_pair():
    masks = sh.masks()
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_fingerprints_equal_brute_force():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 4, 40, 700):
        text = " ".join(rng.choice(["A", "bb", "É", "x\ty", "Zz"]) for _ in range(n))
        assert sh.fingerprint(text.encode()) == slow_print(text)


def test_components_of_planted_fingerprints(spark):
    """Chains, a crowded bucket of near fingerprints, copies and null ids, against brute force."""
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    prints = []
    for k, b in enumerate(base):
        f = b
        for _ in range(8):  # a chain: each one or two bits from the last
            prints.append((len(prints) + 100 * (k % 3), f))
            for bit in rng.choice(64, int(rng.integers(1, 3)), replace=False):
                f ^= 1 << int(bit)
    crowd = base[0] ^ (1 << 63)
    prints += [(1000 + i, crowd ^ (1 << i % 64) ^ (1 << (i * 7 + 3) % 64)) for i in range(150)]
    prints += [(None, base[1]), (5000, 0), (5001, 0), (None, 12345678901)]
    rows = spark.createDataFrame([(i, sh.signed(f)) for i, f in prints], "id long, fp long")
    distinct = rows.groupBy("fp").agg(F.min("id").alias("rep"))
    heads = {r.fp: r.head for r in sh._heads(distinct, sh.links(distinct)).collect()}
    for i, hexed, head in slow_groups(prints):
        assert heads[sh.signed(int(hexed, 16))] == head


def test_query_equals_brute_force(spark, sf):
    got = sorted(tuple(r) for r in QUERIES["op3_simhash"](spark, sf).select("doc_id", "fingerprint", "component_id").collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted(slow_groups([(r.doc_id, slow_print(r.text)) for r in docs]))


def test_odd_rows(spark, odd_docs, no_docs, clashing):
    want = sorted(slow_groups([(r.doc_id, slow_print(r.text)) for r in odd_docs.collect()]), key=repr)
    for docs in (odd_docs, clashing):
        assert sorted((tuple(r) for r in sh.simhash_groups(docs).collect()), key=repr) == want
    assert sh.simhash_groups(no_docs).count() == 0
    kept = sh.drop_near_copies(clashing)
    assert kept.columns == clashing.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert ids == sorted({head for _, _, head in want if head is not None}, key=repr)
    assert sh.drop_near_copies(no_docs).count() == 0


def test_rows_without_ids_keep_one(spark):
    rows = [(None, "some text here", 1), (None, "some text here", 2), (None, "another text here", 3), (4, "a third text", 4), (4, "a third text", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    kept = sh.drop_near_copies(docs)
    assert sorted(r.text for r in kept.collect()) == ["a third text", "another text here", "some text here"]


def test_hot_copies_are_one_node(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same words every time").otherwise(F.concat(F.lit("only "), F.col("id"), F.lit(" of these"))).alias("text"))
    got = {r.doc_id: r.component_id for r in sh.simhash_groups(docs).collect()}
    assert all(got[i] == 0 for i in range(0, 3000, 3))


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_sketches_estimate_the_share_of_shingles():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(500)]
    for changes in (0, 1, 3, 8, 20, 60):
        a = list(rng.choice(words, 400))
        b = list(a)
        for k in rng.integers(0, 400, changes):
            b[k] = "new"
        sa, sb = shingles(" ".join(a)), shingles(" ".join(b))
        x, y = (np.frombuffer(sh.sketch_of(sh.shingle_hashes(" ".join(t).encode())), np.uint8)[None] for t in (a, b))
        assert abs(sh.alike(x, y)[0] - len(sa & sb) / len(sa | sb)) < 0.09
    assert sh.sketch_of(sh.shingle_hashes(b"")) == bytes(256) and 0 not in sh.sketch_of(sh.shingle_hashes(b"a b"))


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(3000)]
    rows, groups = [], []
    common = " ".join(rng.choice(words, 60))
    for g in range(60):
        text = list(rng.choice(words, int(rng.integers(60, 500))))
        ids = []
        for c in range(4):
            t = list(text)
            for k in rng.integers(0, len(t), max(1, len(t) // 120) if c else 0):
                t[k] = f"x{rng.integers(1000)}"
            ids.append(len(rows))
            rows.append((len(rows), " ".join(t) + (f" {common}" if g % 3 == 0 else "")))
        groups.append(ids)
    rows.append((len(rows), common))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in sh.drop_near_copies(docs).collect()}
    texts = dict(rows)
    near = lambda a, b: len(shingles(texts[a]) & shingles(texts[b])) / len(shingles(texts[a]) | shingles(texts[b]))
    assert all(ids[0] in kept for ids in groups) and len(rows) - 1 in kept
    should_go = [i for ids in groups for i in ids[1:] if any(near(i, j) >= 0.8 for j in ids if j < i)]
    assert len(should_go) > 120 and np.mean([i not in kept for i in should_go]) > 0.97
