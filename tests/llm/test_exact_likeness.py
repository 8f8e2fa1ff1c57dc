"""Near copies by what their shingles share, not by what sketches say of it."""

import numpy as np
import pytest

from boolsieve.llm import simhash as sh


def pairs():
    """A pair over 0.8 that sketches put under it, and one under that they put over it."""
    rng = np.random.default_rng(7)
    words, found = [f"w{i}" for i in range(3000)], {}
    while len(found) < 2:
        a = list(rng.choice(words, 300))
        b = list(a)
        for k in rng.integers(0, 300, 7):
            b[k] = "new"
        texts = [" ".join(t) for t in (a, b)]
        sa, sb = (set(sh.shingle_hashes(t.encode()).tolist()) for t in texts)
        true = len(sa & sb) / len(sa | sb)
        sketch = sh.alike(*(np.frombuffer(sh.sketch_of(sh.shingle_hashes(t.encode())), np.uint8)[None] for t in texts))[0]
        far = (sh.fingerprint(texts[0].encode()) ^ sh.fingerprint(texts[1].encode())).bit_count() > 2
        if far and (true >= 0.8) != (sketch >= 0.8):
            found.setdefault(bool(true >= 0.8), texts)
    return found


def test_texts_of_one_fingerprint_keep_their_own_links(spark):
    """Two texts with one fingerprint, of which the second alone is like a third: none of the three is lost."""
    distinct = []
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 1 << 62, 200) for _ in range(2)]
    sets.append(np.concatenate([sets[1][:190], rng.integers(0, 1 << 62, 10)]))
    for k, x in enumerate(sets):
        h = np.unique(x).astype(np.uint64)
        distinct.append((k, bytearray(sh.sketch_of(h)), h.view(np.int64).tolist()))
    df = spark.createDataFrame(distinct, "node long, sketch binary, shingles array<long>").selectExpr("*", "bigint(size(shingles)) n")
    assert [tuple(r) for r in sh.like_links(df, lambda _: df.select("node", "shingles")).collect()] == [(2, 1)]


def test_members_that_centres_miss_meet_all_others(spark):
    """A bucket full of unlike texts but for one pair: no cap on comparisons hides it."""
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 62, 400)).astype(np.uint64)
    rows = []
    for k in range(40):
        own = np.unique(np.concatenate([rng.choice(base, 240, replace=False), rng.integers(0, 1 << 62, 160).astype(np.uint64)]))
        rows.append([k, own])
    rows.append([40, np.unique(np.concatenate([rows[17][1][:-30], rng.integers(0, 1 << 62, 30).astype(np.uint64)]))])
    same = sh.sketch_of(base)
    made = [(k, bytearray(same[:8] + sh.sketch_of(h)[8:]), h.view(np.int64).tolist()) for k, h in rows]  # all share a band
    df = spark.createDataFrame(made, "node long, sketch binary, shingles array<long>").selectExpr("*", "bigint(size(shingles)) n")
    assert {tuple(r) for r in sh.like_links(df, lambda _: df.select("node", "shingles")).collect()} == {(40, 17)}


def test_groups_that_share_a_full_bucket_meet(spark):
    """Two linked pairs whose only common bucket is full: the link between them is found, too."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 62, 400))]
    for _ in range(3):
        sets.append(np.concatenate([sets[-1][30:], rng.integers(0, 1 << 62, 30)]))  # like the one before it alone
    sets += [rng.integers(0, 1 << 62, 400) for _ in range(3)]
    sketches = []
    for k in range(len(sets)):
        sketch = np.arange(256, dtype=np.uint8)
        for band in range(1, 32):
            own = {(1, 1): 0, (3, 2): 2}.get((k, band), k)  # one pair shares the second band, the other the third
            sketch[8 * band + own % 8] = 255 - 8 * band % 97 - own
        sketches.append(bytearray(sketch.tobytes()))
    rows = [(k, sketches[k], np.unique(x).tolist()) for k, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "node long, sketch binary, shingles array<long>").selectExpr("*", "bigint(size(shingles)) n")
    assert {tuple(r) for r in sh.like_links(df, lambda _: df.select("node", "shingles"), meet_groups=True).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_pairs_about_the_bound_are_compared_exactly(spark):
    found = pairs()
    docs = spark.createDataFrame(list(enumerate(found[True] + found[False])), "doc_id long, text string")
    assert {r.doc_id for r in sh.drop_near_copies(docs).collect()} == {0, 2, 3}


def test_overlaps_equal_sets():
    rng = np.random.default_rng(4)
    left, right = ([np.unique(rng.integers(0, 6000, int(rng.integers(0, 900)))) for _ in range(n)] for n in (5, 7))
    assert sh.overlaps(left, right).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in right] for a in left]
    assert sh.overlaps([np.zeros(0, np.int64)], left[:1]).tolist() == [[0]]


def test_blocks_of_a_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(sh, "BLOCK_SHINGLES", 150)
    test_members_that_centres_miss_meet_all_others(spark)


def _chained(seed):
    """Texts whose links join groups: each chain's next text is like the one before it alone; a common line is in all."""
    rng = np.random.default_rng(seed)
    line = [f"line{i}" for i in range(12)]
    texts = []
    for c in range(6):
        words = [f"c{c}w{i}" for i in range(int(rng.integers(60, 200)))]
        for _ in range(5):
            texts.append(" ".join(words + line))
            words = list(words)
            at = int(rng.integers(0, len(words) - 20))
            words[at : at + max(1, len(words) // int(rng.integers(8, 30)))] = [f"n{rng.integers(1 << 30)}"]
    return texts + ["few words", "few words", "", "some other few words here", "some other few words"]


def _one_of_each_group(texts):
    sets = [set(sh.shingle_hashes(t.encode()).tolist()) for t in texts]
    prints = [sh.fingerprint(t.encode()) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (prints[i] ^ prints[j]).bit_count() <= 2 or (sets[i] and sets[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i for i in range(len(texts)) if top(i) == i}


@pytest.mark.parametrize("meeting", [64, 1])
@pytest.mark.parametrize("blind", [True, False])
def test_no_link_depends_on_sketches(spark, monkeypatch, meeting, blind):
    """Even if no sketches agree in a band, every link that joins groups is found, as pairs and in blocks."""
    if blind:
        monkeypatch.setattr(sh, "bands", lambda distinct: distinct.limit(0).selectExpr("node AS bucket", "node"))
    monkeypatch.setattr(sh, "MEETING", meeting)
    texts = _chained(meeting)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in sh.drop_near_copies(df).collect()} == _one_of_each_group(texts)


def test_alike_texts_share_as_many_first_shingles_as_are_asked_for(spark):
    """Of sets over the bound none shares fewer; of two texts of 396 shingles 69 are asked for, not 34."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    first = lambda x: set(np.sort(x)[: len(x) - int(np.ceil(0.8 * len(x) - 1e-9)) + sh._needed(len(x))].tolist())
    rows = []
    for _ in range(3000):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 1 << 40, n))
        both = rng.choice(a, int(rng.integers(int(0.75 * len(a)), len(a) + 1)), replace=False)
        b = np.unique(np.concatenate([both, rng.integers(0, 1 << 40, int(rng.integers(0, n // 4 + 1)))]))
        if len(both) and len(both) >= 0.8 * (len(a) + len(b) - len(both)):
            rows.append((min(len(a), len(b)), max(len(a), len(b)), len(first(a) & first(b))))
    assert len(rows) > 500
    df = spark.createDataFrame(rows, "low long, high long, k long")
    assert df.filter(F.col("k") < sh._shared(F.col("low"), F.col("high"), 0.8)).count() == 0
    assert spark.range(1).select(sh._shared(F.lit(396), F.lit(396), 0.8)).first()[0] == 69  # 34 before


def test_buckets_of_the_same_texts_are_sent_once(spark):
    """Ten buckets of the same texts and one of others: their shingles are sent once, not ten times."""
    rows = [(b, node, node == 3) for b in range(100, 110) for node in range(20)] + [(200, node, True) for node in range(50, 60)]
    sizes = spark.createDataFrame([(node, 30) for node in range(60)], "node long, n long")
    out = sh.joined_buckets(spark.createDataFrame(rows, "bucket long, node long, open boolean"), sizes).collect()
    assert sorted((r.node, r.open) for r in out) == [(k, k == 3) for k in range(20)] + [(k, True) for k in range(50, 60)]
    assert len({r.bucket for r in out}) == 2


def test_a_chain_of_buckets_is_not_joined_where_that_costs_more(spark, monkeypatch):
    monkeypatch.setattr(sh, "BLOCK_TEXTS", 10)
    rows = [(b, node, True) for b in range(20) for node in range(9 * b, 9 * b + 10)]
    sizes = spark.createDataFrame([(node, 30) for node in range(200)], "node long, n long")
    out = sh.joined_buckets(spark.createDataFrame(rows, "bucket long, node long, open boolean"), sizes).collect()
    assert sorted((r.bucket, r.node, r.open) for r in out) == rows
