"""SimHash fingerprints, linked through covering locality-sensitive hashing."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boolsieve.llm.common import free, slices, utf8
from boolsieve.session import cut, forget

BITS = 64
SEED = 42
#: Fingerprints that differ in this many bits or fewer are linked.
RADIUS = 2
#: Words of the shingles, and their share, by which ``drop_near_copies`` calls texts alike.
LIKE_WORDS, LIKENESS = 5, 0.8
#: Bins of a text's sketch and how many make a band: texts of likeness 0.8 share one of the 32 bands with a chance of 0.997.
BINS, ROWS = 256, 8
#: How much less alike sketches of BINS different shingles may say that texts are for their shingles to be compared: four times
#: the standard error, which grows with the root of fewer shingles.
SLACK = 0.1
#: Members of a bucket up to which all are compared with each other.
FEW = 3
#: Shingles and number of the texts that a task compares with each other, and shingles of those that it counts together.
BLOCK_SHINGLES, BLOCK_TEXTS, COLUMNS = 500_000, 2048, 2048
#: Texts that share a band with another up to which tasks get their hashes as a broadcast, 8 bytes each; more are joined by a shuffle.
BROADCAST_TEXTS = 4_000_000
#: Slots of shingles' hashes that are counted, and a share of a task's texts, one of so many, from which on a slot's shingles are common.
SLOTS, COMMON = 1 << 20, 200
#: Texts of a shared shingle up to which those of different groups are compared as pairs.
MEETING = 256
#: One shingle more of so many must be shared for texts to be compared.
NEEDED = 12
#: Rounds of ``components`` after which the driver forgets those before.
FORGET_ROUNDS = 4


def fingerprint(text: bytes, shingle: int = 3, seed: int = SEED) -> int:
    """SimHash of one text: a bit is set if it is set in over half of the shingles' XXH64; no words: zero."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) <= shingle:
        grams = [b" ".join(tokens)]
    else:
        grams = map(b" ".join, zip(*[tokens[i:] for i in range(shingle)]))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(bits), 255):  # sums of up to 255 ones fit a byte
        counts += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): a signed 64-bit fingerprint for every row; null and blank texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = np.array([fingerprint(t, shingle) for t in utf8(part.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Structured bit masks of which at least one misses any ``radius`` positions.

    Each bit gets a non-zero vector of ``radius + 1`` coordinates over GF(2), dealt evenly. Mask v keeps the bits whose
    vector has an odd product with v. The vectors of ``radius`` differing bits can't span the space, so some v is
    orthogonal to them all, and its mask hides every difference.
    """
    vectors = [1 + i % ((1 << (radius + 1)) - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) star links, a > b, whose transitive closure is that of all fingerprints within ``RADIUS`` bits.

    Only fingerprints that share a masked value with another go on. Within such a bucket two of them differ by at most
    two bits exactly if one value lies within one bit of both. So each offers itself and its flips of hidden bits as
    meeting points, and every meeting point links its members to the smallest: work and rows are linear in the bucket.
    """
    cover = masks()
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in cover])).alias("t", "key"))
    shared = keyed.groupBy("t", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo < hi").select("t", "key")
    members = keyed.join(cut(shared), ["t", "key"])
    flips = [F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in cover]
    chosen = F.when(F.col("t") == 0, flips[0])
    for t, hidden in enumerate(flips[1:], 1):
        chosen = chosen.when(F.col("t") == t, hidden)
    meeting = members.select("fp", F.explode(chosen).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z")).distinct()
    low = meeting.groupBy("z").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).filter("b < top").select("z", "b")
    return meeting.join(cut(low), "z").filter("fp > b").select(F.col("fp").alias("a"), "b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches, by alternating large and small stars.

    Every round ends in a checkpoint; only a count and a checksum reach the driver.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    mark = None
    for done in range(1, max_rounds + 1):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        large = cut(large)
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        joined = large.join(low, "a")
        now = cut(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(joined.select("a", F.col("m").alias("b"))).filter("a > b").distinct())
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == (seen["n"], seen["h"]):
            del both, low, large, joined
            forget(edges.sparkSession)
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = (seen["n"], seen["h"])
        if done % FORGET_ROUNDS == 0:
            del both, low, large, joined
            forget(edges.sparkSession)
    raise RuntimeError("components did not settle")


def _heads(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, root, head): for each distinct fingerprint (fp, rep) its component by links (a, b) and the smallest id in that."""
    roots = cut(components(edges))
    known = roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = distinct.join(known, distinct["fp"] == known["node"]).select("fp", "root", "rep")
    named = linked.groupBy("root").agg(F.min("rep").alias("head"))
    names = linked.join(named, "root").select("fp", "root", "head")
    return cut(distinct.join(names, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("head", "rep").alias("head")))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row for each row of ``docs``: id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Texts link if their fingerprints differ in two bits or fewer; ``component_id`` is the smallest id reachable.
    Null, empty and blank texts have fingerprint zero and link like others; repeated rows each return; a null id links
    but never names a component (null if it reaches no other id); an empty table gives an empty result. Only the two
    named columns are read, so others may have any name. Copies meet as one distinct fingerprint before any join.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    return prints.join(_heads(distinct, links(distinct)), "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("head").alias("component_id")
    )


def _one_each(df: DataFrame, key: str) -> DataFrame:
    """One row of each value of a column that goes: the one whose other columns have the smallest hash."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != key])
    return df.select(F.col(key).alias("k"), row.alias("row")).groupBy("k").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")


def shingle_hashes(text: bytes) -> np.ndarray:
    """The hash of each five-word shingle of a text, in its order; of all words if there are fewer."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    n = min(LIKE_WORDS, len(tokens))
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*[tokens[i:] for i in range(n)])), repeat(SEED)), np.uint64)


def _turns() -> np.ndarray:
    """The bins that each bin asks in turn if it is empty: another order for each, the same in every text."""
    order = np.arange(1, BINS)
    return (np.arange(BINS)[:, None] + (order * (2 * np.arange(BINS)[:, None] + 1)) % BINS) % BINS


_TURNS = _turns()


def sketch_of(hashes: np.ndarray) -> bytes:
    """BINS bytes of a text's shingles: two texts have the same byte in a bin with the chance of their likeness.

    A bin has a byte of the smallest hash that falls in it; an empty one takes that of the first full bin in its own turn.
    """
    sketch = np.zeros(BINS, np.uint8)
    if not len(hashes):
        return sketch.tobytes()
    ordered = np.sort(hashes)[::-1]  # of those in a bin the last and smallest stays
    sketch[(ordered & np.uint64(BINS - 1)).astype(np.int64)] = 1 + ((ordered >> np.uint64(8)) % np.uint64(255)).astype(np.uint8)
    empty = np.flatnonzero(sketch == 0)
    if len(empty):
        full = sketch[_TURNS[empty]]
        sketch[empty] = full[np.arange(len(empty)), (full > 0).argmax(axis=1)]
    return sketch.tobytes()


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of common shingles for rows of sketches."""
    return (a == b).mean(axis=1)


def word_hash(text: bytes) -> int:
    """The hash of a text's words: texts of the same words share it."""
    return xxhash.xxh64_intdigest(b" ".join(text.lower().split()), SEED)


def features(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, text_id, fp, sketch, n) of every row: the hash of its words, its fingerprint, and its sketch and number of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = utf8(part.column("text"))
            prints, same = (np.array([f(t) for t in texts], np.uint64).view(np.int64) for f in (lambda t: fingerprint(t, shingle), word_hash))
            hashes = [np.unique(shingle_hashes(t)) for t in texts]
            columns = [part.column("id"), pa.array(same), pa.array(prints), pa.array(list(map(sketch_of, hashes)), pa.binary()), pa.array([len(h) for h in hashes], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_id", "fp", "sketch", "n"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, text_id long, fp long, sketch binary, n long")


def shingle_sets(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(node, shingles): the distinct shingles' hashes of the texts whose word hash is in ``wanted`` (node)."""
    few = None
    if wanted.count() <= BROADCAST_TEXTS:
        few = docs.sparkSession.sparkContext.broadcast(np.sort(wanted.toArrow()["node"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for part in slices(batches, "text"):
            texts = utf8(part.column("text"))
            nodes = np.array([word_hash(t) for t in texts], np.uint64).view(np.int64)
            if few is not None and len(few.value):
                known = few.value[np.minimum(np.searchsorted(few.value, nodes), len(few.value) - 1)] == nodes
            else:
                known = np.full(len(nodes), few is None)
            new = [k for k in np.flatnonzero(known).tolist() if nodes[k] not in done and not done.add(nodes[k])]
            sets = [np.unique(shingle_hashes(texts[k])).view(np.int64) for k in new]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[new]), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    made = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "node long, shingles array<long>")
    if few is None:
        made = made.join(wanted, "node", "left_semi")
    return cut(made.groupBy("node").agg(F.first("shingles").alias("shingles")))


def bands(distinct: DataFrame) -> DataFrame:
    """(bucket, node): the buckets of each node (node, sketch), one for each band of its sketch, that others are in, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keys = np.frombuffer(b"".join(utf8(part.column("sketch"))), np.uint64).reshape(-1, BINS // ROWS)
            keys = (keys + np.arange(1, BINS // ROWS + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(29)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(part.column("node").to_numpy(), BINS // ROWS))], ["bucket", "node"])

    keyed = distinct.filter("n > 0").select("node", "sketch").mapInArrow(run, "bucket long, node long")
    several = keyed.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("bucket")
    return cut(keyed.join(cut(several), "bucket"))


def verified(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that share ``least`` of their shingles; sketches only spare the comparison of what is far apart."""
    both = pairs.join(sketches.toDF("a", "sa", "na"), "a").join(sketches.toDF("b", "sb", "nb"), "b").select("a", "b", "sa", "sb", F.least("na", "nb").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "sa"):
            sa, sb = (np.frombuffer(b"".join(utf8(part.column(c))), np.uint8).reshape(-1, BINS) for c in ("sa", "sb"))
            slack = SLACK * np.sqrt(BINS / np.minimum(part.column("n").to_numpy(), BINS))
            yield part.filter(pa.array(alike(sa, sb) >= least - slack)).select(["a", "b"])

    return _exact(cut(both.mapInArrow(run, "a long, b long")), sets, least)


def _exact(near: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    exact = near.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    common = exact.select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    return cut(common.filter(F.col("both") >= F.lit(least) * (F.col("n") - F.col("both"))).select("a", "b"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of the left shares with each of the right. Those of one set alone don't count."""
    both = left + right
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    _, token, n = np.unique(np.concatenate([*both, np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
    shared = n[token] > 1
    _, token = np.unique(token[shared], return_inverse=True)
    owner = owner[shared]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(token[-1]) + 1 if len(token) else 0, COLUMNS):
        a, b = np.searchsorted(token, [at, at + COLUMNS])
        has = np.zeros((len(both), COLUMNS), np.float32)
        has[owner[a:b], token[a:b] - at] = 1
        out += has[: len(left)] @ has[len(left) :].T
    return out


def _blocks() -> Column:
    """Into how many blocks texts of ``n`` shingles each are cut."""
    return F.ceil(F.greatest(F.sum("n") / F.lit(float(BLOCK_SHINGLES)), F.count("*") / F.lit(float(BLOCK_TEXTS))))


def rest_links(alone: DataFrame, member: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): exact links of the members ``alone`` (bucket, node) with all members of their buckets.

    A bucket is cut into blocks of BLOCK_SHINGLES and BLOCK_TEXTS by a hash of its members; a task compares one block with
    another and gives links only, so no task holds a whole bucket and no pairs are written.
    """
    own = member.join(alone.select("bucket").distinct(), "bucket", "left_semi")
    size = own.join(sets.select("node", F.size("shingles").alias("n")), "node").groupBy("bucket").agg(_blocks().cast("int").alias("blocks"))
    size = cut(size)
    block, every = F.pmod(F.xxhash64("bucket", "node"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = alone.join(size, "bucket").select("bucket", "node", block.alias("i"), every.alias("j"), F.lit(True).alias("open"))
    right = own.join(size, "bucket").select("bucket", "node", every.alias("i"), block.alias("j"), F.lit(False).alias("open"))

    def compare(table: pa.Table) -> pa.Table:
        mine = table["open"].to_numpy()
        nodes, found = table["node"].to_numpy(), [np.asarray(x, np.int64) for x in table["shingles"].to_numpy()]
        x, y = np.flatnonzero(mine), np.flatnonzero(~mine)
        n = np.array([len(f) for f in found], np.float32)
        common = overlaps([found[k] for k in x], [found[k] for k in y])
        hit = (common >= least * (n[x][:, None] + n[y][None, :] - common)) & (nodes[x][:, None] != nodes[y][None, :])
        p, q = np.nonzero(hit)
        one, other = nodes[x[p]], nodes[y[q]]
        return pa.table({"a": np.maximum(one, other), "b": np.minimum(one, other)})

    rows = left.unionAll(right).join(sets, "node")
    return cut(rows.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long").distinct())


def like_links(distinct: DataFrame, sets_of: Callable[[DataFrame], DataFrame], least: float = LIKENESS, meet_groups: bool = False) -> DataFrame:
    """(a, b), a > b: links between distinct texts (node, sketch, n) that share ``least`` of their shingles.

    ``sets_of`` gives (node, shingles) of the nodes (node) that share a bucket with another; the rest are never compared.
    Texts whose sketches agree in a whole band are in a bucket. Up to FEW of them are compared with each other. Of more, each
    is compared with the one that meets most others in all its buckets, which is what they are copies of: a hot bucket
    of copies costs a comparison for each. Those that are like none of these are then compared with all members of their
    buckets, by their shingles and in blocks. So no text stays without a link that it has, however full its buckets are.
    With ``meet_groups`` so are, in every full bucket that still holds several groups of what is linked, the members that
    are not in its largest group: then no two groups that share a bucket stay apart if a link joins them.
    """
    member = bands(distinct)
    wanted = cut(member.select("node").distinct())
    sets = sets_of(wanted)
    sketches = cut(distinct.select("node", "sketch", "n").join(F.broadcast(wanted) if wanted.count() <= BROADCAST_TEXTS // 8 else wanted, "node", "left_semi"))
    sizes = cut(member.groupBy("bucket").agg(F.count("*").alias("size")))
    weight = cut(member.join(sizes, "bucket").groupBy("node").agg(F.sum("size").alias("weight")))
    central = member.join(weight, "node").groupBy("bucket").agg(F.max_by("node", F.struct("weight", "node")).alias("centre"))
    few = member.join(sizes.filter(F.col("size") <= FEW), "bucket").select("bucket", F.col("node").alias("centre"))
    ends = member.join(cut(central.unionAll(few).distinct()), "bucket").filter("node <> centre")
    pairs = cut(ends.select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b")).distinct())
    del weight, central, few, ends
    found = verified(pairs, sketches, sets, least)
    forget(distinct.sparkSession)
    full = cut(member.join(sizes.filter(F.col("size") > FEW), "bucket", "left_semi"))
    linked = found.select(F.col("a").alias("node")).unionAll(found.select(F.col("b").alias("node"))).distinct()
    alone = cut(full.join(linked, "node", "left_anti"))
    if not alone.isEmpty():
        found = cut(found.unionAll(rest_links(alone, member, sets, least)).distinct())
        forget(distinct.sparkSession)
    if not meet_groups:
        return found
    apart = cut(_apart(full, found).join(linked, "node", "left_semi"))  # the others have met all members
    return found if apart.isEmpty() else found.unionAll(rest_links(apart, member, sets, least)).distinct()


def _apart(member: DataFrame, found: DataFrame) -> DataFrame:
    """The members (bucket, node) that are not in the largest group, by links (a, b), of their bucket; ties to the smaller root."""
    return _groups(member, found).filter("root <> most").select("bucket", "node")


def _groups(member: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, node, root, most): the members of buckets that hold several groups, with their group and the largest one."""
    roots = components(found)
    known = cut(roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct()))
    grouped = cut(member.join(known, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")))
    sizes = grouped.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(F.min_by("root", F.struct((-F.col("n")).alias("n"), "root")).alias("most"), F.count("*").alias("groups"))
    return grouped.join(largest.filter("groups > 1").select("bucket", "most"), "bucket")


def common_shingles(docs: DataFrame, text_col: str) -> np.ndarray:
    """How common shingles are: of each of SLOTS slots of their hashes the logarithm of its texts if it is in one of COMMON, else 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(SLOTS, np.int64), 0
        for part in slices(batches, "text"):
            hashes = [np.unique(shingle_hashes(t)) for t in utf8(part.column("text"))]
            n += len(hashes)
            seen += np.bincount((np.concatenate([*hashes, np.zeros(0, np.uint64)]) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        slot = np.flatnonzero(seen >= max(4, n / COMMON))
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(seen[slot])], ["slot", "n"])

    found = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "slot long, n long")
    rows = found.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # a row a slot at most
    out = np.zeros(SLOTS, np.uint8)
    out[rows["slot"].to_numpy()] = np.log2(rows["n"].to_numpy().astype(float)).astype(np.uint8)
    return out


def _needed(n: int) -> int:
    """How many of their ``first_shingles`` two texts must share, by the smaller one's number of shingles."""
    return 1 + n // NEEDED


def first_shingles(docs: DataFrame, text_col: str, least: float) -> DataFrame:
    """(bucket, node): the shingles that texts must share some of if they share ``least`` of all, if others have them, too.

    In any order of shingles that is the same for all, two such texts share k of their first n - ceil(least n) + k, for each k. Rare
    ones come first, so that few texts meet. Each text's shingles are dealt by their hash, and those of one text alone go as they are read.
    """
    order = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for part in slices(batches, "text"):
            nodes, tokens = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for t in utf8(part.column("text")):
                node = word_hash(t)
                if node in done:
                    continue
                done.add(node)
                h = np.unique(shingle_hashes(t))
                first = h[np.argsort(order.value[(h & np.uint64(SLOTS - 1)).astype(np.int64)], kind="stable")]
                first = first[: len(h) - math.ceil(least * len(h) - 1e-9) + _needed(len(h))]
                tokens.append(first)
                nodes.append(np.full(len(first), node, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (tokens, nodes)], ["bucket", "node"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, node, kept = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        for part in batches:
            bucket, node = (np.concatenate([x, part.column(c).to_numpy()]) for x, c in ((bucket, "bucket"), (node, "node")))
            kept = np.concatenate([kept, np.zeros(len(bucket) - len(kept), bool)])
            new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1])])[: len(bucket)]
            bucket, node, kept = bucket[new], node[new], kept[new]
            same = bucket[1:] == bucket[:-1]
            kept[1:] |= same
            kept[:-1] |= same
            ready = kept[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[:-1][ready]), pa.array(node[:-1][ready])], ["bucket", "node"])
            bucket, node, kept = bucket[-1:], node[-1:], kept[-1:]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[kept]), pa.array(node[kept])], ["bucket", "node"])

    made = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "bucket long, node long")
    return cut(made.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(shared, "bucket long, node long"))


def _shared(low: Column, high: Column, least: float) -> Column:
    """How many of their ``first_shingles`` texts of ``low`` and ``high`` shingles share if they share ``least`` of all.

    Of the text whose first ones end earlier in the order, whatever else both share is among the other ones.
    """
    other = [F.ceil(F.lit(least) * n - F.lit(1e-9)) - 1 - F.floor(n / NEEDED) for n in (low, high)]
    common = F.ceil(F.lit(least / (1 + least)) * (low + high) - F.lit(1e-9))
    return F.greatest(1 + F.floor(low / NEEDED), common - F.greatest(*other))


def joined_buckets(member: DataFrame, sizes: DataFrame) -> DataFrame:
    """(bucket, node, open) with buckets that share members as one bucket, where fewer shingles then go to tasks. No pair is lost.

    Many shingles of one passage have the same texts: these are sent once, not for each shingle. ``sizes`` has the texts' (node, n).
    """
    low = member.groupBy("bucket").agg(F.min("node").alias("b"))
    roots = components(member.join(low, "bucket").select(F.col("node").alias("a"), "b"))
    known = roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "whole")
    rows = cut(member.join(known, "node").join(sizes, "node"))
    cost = F.sum("n") * _blocks()
    apart = rows.groupBy("whole", "bucket").agg(cost.alias("cost")).groupBy("whole").agg(F.sum("cost").alias("apart"))
    at_once = rows.select("whole", "node", "n").distinct().groupBy("whole").agg(cost.alias("at_once"))
    chosen = cut(apart.join(at_once, "whole").select("whole", (F.col("at_once") <= F.col("apart")).alias("join")))
    out = rows.join(chosen, "whole").select(F.when(F.col("join"), F.col("whole")).otherwise(F.col("bucket")).alias("bucket"), "node", "open")
    return cut(out.groupBy("bucket", "node").agg(F.max("open").alias("open")))


def missing_links(docs: DataFrame, text_col: str, sizes: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """(a, b), a > b: the links between groups of texts (node, n), by links ``found``, that sketches and full buckets left out. None is lost.

    Where texts of several groups share one of their ``first_shingles``, those that are not in the largest group there meet all others:
    as pairs where few do, which are compared if they share enough of these and their sizes allow it; in the blocks of ``rest_links``
    where many do, once for all shingles of a passage.
    """
    member = first_shingles(docs, text_col, least)
    forget(docs.sparkSession)
    groups = cut(_groups(member, found))
    del member
    if groups.isEmpty():
        return found.limit(0)
    full = cut(groups.groupBy("bucket").agg(F.count("*").alias("size")).filter(F.col("size") > MEETING).select("bucket"))
    few = groups.join(full, "bucket", "left_anti").join(sizes, "node")
    other = few.select("bucket", *[F.col(c).alias(f"{c}2") for c in ("node", "root", "n", "most")])
    once = (F.col("root2") == F.col("most2")) | (F.col("node") < F.col("node2"))
    low, high = F.least("n", "n2"), F.greatest("n", "n2")
    met = few.filter("root <> most").join(other, "bucket").filter((F.col("root") != F.col("root2")) & once & (low >= F.lit(least - 1e-9) * high))
    shared = met.groupBy(F.greatest("node", "node2").alias("a"), F.least("node", "node2").alias("b")).agg(F.count("*").alias("k"), F.min(low).alias("low"), F.min(high).alias("high"))
    pairs = cut(shared.filter(F.col("k") >= _shared(F.col("low"), F.col("high"), least)).select("a", "b"))
    many = groups.join(full, "bucket", "left_semi").select("bucket", "node", (F.col("root") != F.col("most")).alias("open")) if not full.isEmpty() else None
    asked = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node")))
    if many is not None:
        many = joined_buckets(cut(many), sizes)
        asked = asked.unionAll(many.select("node"))
    del groups, few, other, met, shared
    forget(docs.sparkSession)
    sets = shingle_sets(docs, text_col, cut(asked.distinct()))
    out = _exact(pairs, sets, least)
    forget(docs.sparkSession)
    if many is None:
        return out
    return out.unionAll(rest_links(many.filter("open").select("bucket", "node"), many.select("bucket", "node"), sets, least))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, least: float = LIKENESS, meet_groups: bool = False) -> DataFrame:
    """``docs`` with one row of every group of near copies, the one of its smallest id, and all columns.

    Texts link if their fingerprints differ in two bits or fewer, or if they share ``least`` of their five-word
    shingles; a group is what links connect. Fingerprints alone can't reach a likeness of 0.8: it stands for
    some ten bits, and covering masks double with each. Bands of sketches find most links and ``missing_links`` all others
    that join groups. Of repeated rows with a group's smallest id one stays, the one with
    the smallest hash of all columns; so it is in groups without any id. ``meet_groups`` is that of ``like_links``. Null and blank texts are copies of each other. An
    empty table stays empty.
    """
    found = cut(features(docs, id_col, text_col, shingle))
    prints = found.select("id", "fp")
    distinct = found.groupBy(F.col("text_id").alias("node")).agg(F.min("id").alias("rep"), F.min(F.struct("fp", "sketch", "n")).alias("s"))
    distinct = cut(distinct.select("node", "rep", "s.*"))
    nodes = cut(distinct.groupBy("fp").agg(F.min("rep").alias("rep")))
    of = distinct.select("node", "fp")
    alike_texts = like_links(distinct.select("node", "sketch", "n"), lambda wanted: shingle_sets(docs, text_col, wanted), least, meet_groups)
    forget(docs.sparkSession)
    alike_texts = alike_texts.unionAll(missing_links(docs, text_col, distinct.select("node", "n"), alike_texts, least))
    between = alike_texts.join(of.toDF("a", "fa"), "a").join(of.toDF("b", "fb"), "b").filter("fa <> fb").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    between = cut(between)
    del alike_texts
    forget(docs.sparkSession)
    heads = _heads(nodes, links(nodes).unionByName(between))
    chosen = cut(prints.join(heads, "fp").filter(F.col("head").eqNullSafe(F.col("id"))).groupBy("root", "head").agg(F.count("*").alias("n")))
    this = F.col(f"`{id_col}`").cast("long")
    head, key, own, fp = free(docs, "_head", "_key", "_fp", "_f")
    kept = docs.join(chosen.filter("n = 1 and head is not null").select(F.col("head").alias(head)), this == F.col(head), "left_semi")
    odd = chosen.filter("n > 1 or head is null")
    if not odd.isEmpty():
        several = odd.filter("head is not null").select(F.col("head").alias(head))
        kept = kept.unionByName(_one_each(docs.withColumn(key, this).join(several, this == F.col(head), "left_semi"), key))
        nameless = docs.filter(this.isNull()).withColumn(own, _print_of(text_col, shingle))
        roots = heads.filter("head is null").select(F.col("fp").alias(fp), F.col("root").alias(key))
        kept = kept.unionByName(_one_each(nameless.join(roots, F.col(own) == F.col(fp)).drop(own, fp), key))
    return kept


def _print_of(text_col: str, shingle: int) -> Column:
    """The fingerprint as a column; for the few rows without an id."""
    one = F.udf(lambda t: signed(fingerprint((t or "").encode(), shingle)), "long")
    return one(F.col(f"`{text_col}`").cast("string"))
