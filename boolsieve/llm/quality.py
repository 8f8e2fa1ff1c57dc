"""Quality by the perplexity of an interpolated modified Kneser-Ney model of bytes, whose n-grams grow with the trusted texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boolsieve.llm.common import free, offsets, release, slices, without
from boolsieve.session import Shared, cut

#: Bytes of an n-gram, all 256 of them told apart: six pack into 48 bits of a long.
ORDER, ALPHABET = 6, 256
#: Orders up to this are one table, which has at most ALPHABET ** LOW rows whatever the corpus; higher ones stay in shards.
LOW = 3
START = 0xFF  # stands before a text; UTF-8 has no such byte
#: Share of a language's trusted texts that the threshold lets pass.
QUANTILE = 0.995
#: Added to the threshold's mean negative log probability, in nats.
MARGIN = 0.05
#: Bytes of a text's prior, which has the mean of its language: short texts vary too much by themselves.
PRIOR_BYTES = 40
#: Trusted ids up to which they are broadcast, some 50 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Distinct n-grams of all documents up to which their scores are broadcast, 20 bytes each; beyond, blocks of texts ask the shards.
BROADCAST_GRAMS = 4_000_000
#: Text for each shard of the n-grams and each block of texts, in bytes, and the fewest of either.
SHARD_BYTES, LEAST_SHARDS = 64 << 20, 12
#: Text that a task looks at at a time, and distinct n-grams that it holds before it hands them on.
STEP_BYTES, HELD_GRAMS = 512 << 10, 600_000
_STEP = 1000.0  # of the histogram from which quantiles are read: thousandths of a nat
_LOW_BITS = [(1 << 8 * k) - 1 for k in range(ORDER + 1)]

#: Which texts a model has seen. A trusted text is in half 1 or 2 and is judged by the counts of the other half; the rest by both.
BOTH, ONE, TWO = range(3)


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes."""
    return zstandard.ZstdCompressor(level=3).compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())


def unpack(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=0))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.int64))


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends."""
    ends = offsets(column)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)), ends - ends[0]


def grams(data: np.ndarray, ends: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at every byte of some texts, as a number."""
    pad = order - 1
    real = np.ones(len(data) + pad * (len(ends) - 1), bool)
    heads = ends[:-1] + pad * np.arange(len(ends) - 1)
    real[(heads[:, None] + np.arange(pad)).ravel()] = False
    padded = np.full(len(real), START, np.int64)
    padded[real] = data
    numbers = np.zeros(max(len(padded) - pad, 0), np.int64)
    for k in range(order):
        numbers <<= 8
        numbers |= padded[k : k + len(numbers)]
    return numbers[real[pad:]]


def shard_of(numbers: np.ndarray, shards: int) -> np.ndarray:
    """By the last LOW bytes before an n-gram's last one: its suffixes of more than LOW bytes and all their contexts are in its shard."""
    return ((numbers >> 8 & _LOW_BITS[LOW]) * 0x9E3779B1 >> 16) % shards


def merged(numbers: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in order, and the sums of their counts."""
    g, m = np.concatenate(numbers), np.concatenate(n)
    if not len(g):
        return g, m
    order = np.argsort(g, kind="stable")
    g = g[order]
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    return g[starts], np.add.reduceat(m[order], starts, axis=0)


_COUNTS = "shard long, grams binary, n0 binary, n1 binary, n2 binary"


def _count_rows(shard: int, numbers: np.ndarray, n: np.ndarray) -> dict:
    return {"shard": shard, "grams": pack_sorted(numbers), **{f"n{k}": pack(n[:, k].copy()) for k in range(3)}}


def _unpacked(rows: dict) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [unpack_sorted(r) for r in rows["grams"]], [np.stack([unpack(x, np.int64) for x in r], axis=1) for r in zip(rows["n0"], rows["n1"], rows["n2"])]


def _batch(rows: list[dict], spec: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in spec.split(", "))])
    return pa.RecordBatch.from_pylist(rows, fields)


def count_grams(texts: DataFrame, shards: int) -> DataFrame:
    """One row for each shard: its distinct n-grams, and how often each stands in texts (text, kind) of each kind.

    Tasks add up what they have read, so a text with many copies costs no more than a rare one; shards add up the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for part in slices(batches, "text", STEP_BYTES):
            data, ends = raw_texts(part.column("text"))
            keys = grams(data, ends) << 2
            keys |= np.repeat(part.column("kind").to_numpy(), np.diff(ends))
            own, counts = np.unique(keys, return_counts=True)
            held.append(own)
            n.append(counts)
            size += len(own)
            if size > 2 * HELD_GRAMS:
                one, sums = merged(held, n)
                held, n, size = [one], [sums], len(one)
                if size > HELD_GRAMS:
                    yield dealt(*by_kind(one, sums))
                    held, n, size = [one[:0]], [sums[:0]], 0
        yield dealt(*by_kind(*merged(held, n)))

    def by_kind(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        numbers, at = np.unique(keys >> 2, return_inverse=True)
        out = np.zeros((len(numbers), 3), np.int64)
        out[at, keys & 3] = n
        return numbers, out

    def dealt(numbers: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        to = shard_of(numbers, shards)
        order = np.argsort(to, kind="stable")  # leaves the n-grams of a shard sorted
        edges = np.searchsorted(to[order], np.arange(shards + 1))
        return _batch([_count_rows(s, numbers[order[a:b]], n[order[a:b]]) for s, (a, b) in enumerate(zip(edges, edges[1:])) if b > a], _COUNTS)

    def add(table: pa.Table) -> pa.Table:
        held, n, size, most = [np.zeros(0, np.int64)], [np.zeros((0, 3), np.int64)], 0, HELD_GRAMS // 4
        for batch in table.to_batches():
            for i in range(batch.num_rows):
                own, counts = _unpacked(batch.slice(i, 1).to_pydict())
                held += own
                n += counts
                size += len(own[0])
                if size > most:
                    one, sums = merged(held, n)
                    held, n, size = [one], [sums], len(one)
                    most = max(HELD_GRAMS // 4, 2 * size)
        return pa.Table.from_batches([_batch([_count_rows(table["shard"][0].as_py(), *merged(held, n))], _COUNTS)])

    return texts.mapInArrow(run, _COUNTS).groupBy("shard").applyInArrow(add, _COUNTS)


def counts_of(n: np.ndarray, model: int) -> np.ndarray:
    """What the model's n-grams count: those of its half, or of both."""
    return n[:, 1] + n[:, 2] if model == BOTH else n[:, model]


def orders(numbers: np.ndarray, n: np.ndarray, least: int = LOW + 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted n-grams and counts of order ORDER down to ``least``: an order below the highest counts the different bytes before it."""
    out = [(numbers[n > 0], n[n > 0])]
    for k in range(ORDER - 1, least - 1, -1):
        out.append(np.unique(out[-1][0] & _LOW_BITS[k], return_counts=True))
    return out


def discounts(of: list[int]) -> np.ndarray:
    """Discounts of n-grams that count 1, 2 and more, from how many count 1, 2, 3 and 4."""
    n1, n2, n3, n4 = of
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = []
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * b / a if a else k * 0.5
        out.append(min(max(d, 0.05 * k), 0.95 * k))
    return np.array(out)


def counts_of_counts(n: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5].tolist()


def _interpolate(keys: np.ndarray, n: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The discounted share of each n-gram in its context; the contexts, and the weight of the lower order in each."""
    context = keys >> 8
    starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
    d = off[np.minimum(n, 3) - 1]
    total, mass = (np.add.reduceat(x, starts) if len(starts) else np.zeros(0) for x in (n.astype(float), d))
    return (n - d) / np.repeat(total, np.diff(np.append(starts, len(keys)))), context[starts], mass / total


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    """The value of each wanted key in sorted ``keys``."""
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


@dataclass
class Low:
    """The orders up to LOW, and the discounts of those above."""

    keys: np.ndarray
    p: np.ndarray
    gamma: np.ndarray  # by context of the highest of them
    below: np.ndarray  # by n-gram of one less
    off: dict[int, np.ndarray]

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        own = _at(self.keys, self.p, wanted, -1.0)
        return np.where(own >= 0, own, self.gamma[wanted >> 8] * self.below[wanted & _LOW_BITS[LOW - 1]])


def low_orders(keys: np.ndarray, n: np.ndarray, off: dict[int, np.ndarray]) -> Low:
    """From the n-grams of order LOW, sorted, and how many different bytes stand before each."""
    levels = [(keys, n)]
    for k in range(LOW - 1, 0, -1):
        levels.append(np.unique(levels[-1][0] & _LOW_BITS[k], return_counts=True))
    below = np.full(1, 1.0 / ALPHABET)
    for k, (own, m) in enumerate(reversed(levels), 1):
        share, contexts, weight = _interpolate(own, m, discounts(counts_of_counts(m)))
        gamma = np.ones(ALPHABET ** (k - 1))
        gamma[contexts] = weight
        if k == LOW:
            return Low(own, share + gamma[own >> 8] * below[own & _LOW_BITS[k - 1]], gamma, below, off)
        full = np.repeat(gamma, ALPHABET) * (below[0] if k == 1 else np.tile(below, ALPHABET))
        full[own] += share
        below = full
    raise AssertionError


def log_probabilities(wanted: np.ndarray, numbers: np.ndarray, n: np.ndarray, low: Low) -> np.ndarray:
    """Of all wanted n-grams of a shard, sorted and distinct, seen or not, from the shard's n-grams and counts."""
    levels = orders(numbers, n)
    needed = [wanted]
    for k in range(ORDER - 1, LOW - 1, -1):
        needed.append(np.unique(needed[-1] & _LOW_BITS[k]))
    suffixes, p = needed[-1], low(needed[-1])
    for k in range(LOW + 1, ORDER + 1):
        keys, m = levels[ORDER - k]
        share, contexts, gamma = _interpolate(keys, m, low.off[k])
        own = needed[ORDER - k]
        p = _at(keys, share, own, 0.0) + _at(contexts, gamma, own >> 8, 1.0) * p[np.searchsorted(suffixes, own & _LOW_BITS[k - 1])]
        suffixes = own
    return np.log(p)


_VALUES = "shard long, n long, grams binary, v0 binary, v1 binary, v2 binary"


def values_of(counts: DataFrame) -> DataFrame:
    """One row for each shard of ``counts``: its n-grams, and the log probability of each by the three models.

    Two passes over the shards: the first adds up counts of counts and the n-grams of order LOW, at most ALPHABET ** LOW
    rows; the second has these, and joins everything above within the shard.
    """

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, n, _ in _shards(batches):
            for model in range(3):
                levels = orders(numbers, counts_of(n, model), LOW)
                rows = [(-(10 * (ORDER - i) + j), c) for i, (_, m) in enumerate(levels[:-1]) for j, c in enumerate(counts_of_counts(m))]
                keys = np.concatenate([[k for k, _ in rows], levels[-1][0]]).astype(np.int64)
                sums = np.concatenate([[c for _, c in rows], levels[-1][1]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), model)), pa.array(keys), pa.array(sums)], ["model", "key", "n"])

    table = counts.mapInArrow(facts, "model long, key long, n long").groupBy("model", "key").agg(F.sum("n").alias("n")).toArrow()
    model, key, n = (table[c].to_numpy() for c in ("model", "key", "n"))
    lows = []
    for k in range(3):
        own = (model == k) & (key >= 0)
        by = np.argsort(key[own])
        told = dict(zip(key[(model == k) & (key < 0)].tolist(), n[(model == k) & (key < 0)].tolist()))
        off = {o: discounts([told.get(-(10 * o + j), 0) for j in range(4)]) for o in range(LOW + 1, ORDER + 1)}
        lows.append(low_orders(key[own][by], n[own][by], off))
    shared = Shared(counts.sparkSession, lows)
    del table, model, key, n, lows
    release()

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, n, shard in _shards(batches):
            logs = [log_probabilities(numbers, numbers, counts_of(n, model), shared.value[model]) for model in range(3)]
            yield _batch([{"shard": shard, "n": len(numbers), "grams": pack_sorted(numbers), **{f"v{k}": pack(v.astype(np.float32)) for k, v in enumerate(logs)}}], _VALUES)

    return cut(counts.mapInArrow(values, _VALUES))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    for batch in batches:
        for i in range(batch.num_rows):
            rows = batch.slice(i, 1).to_pydict()
            numbers, n = _unpacked(rows)
            yield numbers[0], n[0], rows["shard"][0]


class Scores:
    """Log probabilities by n-gram, in a hash table that is built once."""

    def __init__(self, numbers: np.ndarray, values: np.ndarray) -> None:
        self.numbers, self.values, self.index = numbers, values, None

    def sums(self, column: pa.Array, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of each text, and the sum of their negative log probabilities by the model of its kind."""
        data, ends = raw_texts(column)
        sizes = np.diff(ends)
        if not len(data):
            return sizes, np.zeros(len(sizes))
        if self.index is None:
            self.index = pd.Index(self.numbers)
        model = np.array([BOTH, TWO, ONE])[kinds]
        logs = self.values[np.repeat(model, sizes), self.index.get_indexer(grams(data, ends))]
        total = np.concatenate([[0.0], np.cumsum(-logs.astype(np.float64))])
        return sizes, np.round(total[ends[1:]] - total[ends[:-1]], 6)


def _scores(rows: dict) -> Scores:
    """From packed shards or answers."""
    numbers = [unpack_sorted(r) for r in rows["grams"]]
    values = [[unpack(x, np.float32) for x in rows[f"v{k}"]] for k in range(3)]
    return Scores(np.concatenate([np.zeros(0, np.int64), *numbers]), np.stack([np.concatenate([np.zeros(0, np.float32), *v]) for v in values]))


Scored = Callable[[DataFrame, str, str], DataFrame]


def _by_broadcast(values: DataFrame, text_col: str, kind_col: str) -> Scored:
    known = _scores(values.toArrow().to_pydict())
    table = values.sparkSession.sparkContext.broadcast((known.numbers, known.values))
    del known
    release()

    def scored(of: DataFrame, size: str, nll: str) -> DataFrame:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in of.schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Scores(*table.value)
            for part in slices(batches, text_col, STEP_BYTES):
                column = part.column(text_col)
                sizes, sums = own.sums(column.fill_null("") if column.null_count else column, part.column(kind_col).to_numpy())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes.astype(np.int64)), pa.array(sums)], [*part.schema.names, size, nll])

        return of.mapInArrow(run, f"{fields}, {size} long, {nll} double")

    return scored


def _by_blocks(values: DataFrame, rows: DataFrame, blocks: int, shards: int, id_col: str, text_col: str, kind_col: str) -> Scored:
    """Every block of texts asks each shard once for its distinct n-grams and sums the answers for its texts.

    What leaves a block is a row for each text: two hashes of it, its kind, bytes and sum.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    h1, h2, kind = F.xxhash64(text), F.xxhash64(F.lit(1), text), F.col(kind_col)
    block = F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("string"), text), F.lit(blocks))
    texts = rows.select(block.alias("block"), h1.alias("h1"), h2.alias("h2"), kind.cast("long").alias("kind"), text.alias("text"))
    asked, answered = "block long, shard long, grams binary", "block long, grams binary, v0 binary, v1 binary, v2 binary"

    def ask(table: pa.Table) -> pa.Table:
        numbers = np.zeros(0, np.int64)
        for part in slices(iter(table.select(["text"]).to_batches()), "text", STEP_BYTES):
            numbers = np.union1d(numbers, grams(*raw_texts(part.column("text"))))
        to, own = shard_of(numbers, shards), table["block"][0].as_py()
        return pa.Table.from_batches([_batch([{"block": own, "shard": int(s), "grams": pack_sorted(numbers[to == s])} for s in np.unique(to)], asked)])

    def answer(questions: pa.Table, known: pa.Table) -> pa.Table:
        shard, out = _scores(known.to_pydict()), []
        by = np.argsort(shard.numbers)
        for q in questions.to_pylist():
            at = by[np.searchsorted(shard.numbers, unpack_sorted(q["grams"]), sorter=by)]
            out.append({"block": q["block"], "grams": q["grams"], **{f"v{k}": pack(shard.values[k][at]) for k in range(3)}})
        return pa.Table.from_batches([_batch(out, answered)])

    def sums(table: pa.Table, answers: pa.Table) -> pa.Table:
        known, out = _scores(answers.to_pydict()), []
        for part in slices(iter(table.select(["h1", "h2", "kind", "text"]).to_batches()), "text", STEP_BYTES):
            sizes, nll = known.sums(part.column("text"), part.column("kind").to_numpy())
            out.append(pa.table({"h1": part.column("h1"), "h2": part.column("h2"), "kind": part.column("kind"), "size": pa.array(sizes.astype(np.int64)), "nll": pa.array(nll)}))
        return pa.concat_tables(out)

    questions = texts.groupBy("block").applyInArrow(ask, asked)
    answers = cut(questions.groupBy("shard").cogroup(values.groupBy("shard")).applyInArrow(answer, answered))
    narrow = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(sums, "h1 long, h2 long, kind long, size long, nll double")
    narrow = cut(narrow.dropDuplicates(["h1", "h2", "kind"]))

    def scored(of: DataFrame, size: str, nll: str) -> DataFrame:
        a, b, c, x, y = free(of, "_h1", "_h2", "_k", "_x", "_y")
        keyed = of.withColumns({x: h1, y: h2})
        found = keyed.join(narrow.toDF(a, b, c, size, nll), (F.col(x) == F.col(a)) & (F.col(y) == F.col(b)) & (kind == F.col(c)))
        return found.select(*[f"`{f}`" for f in of.columns], size, nll)

    return scored


def score(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """``docs`` with ``perplexity`` (of a byte), ``smoothed``, ``threshold`` and ``kept``.

    The model learns from the whole texts of all rows whose id is in ``trusted_ids`` (one column; ids are compared as
    strings). No text is judged by a model that has seen it as trusted: such texts are halved by their hash, copies
    together, and each half has the model of the other. ``smoothed`` is the perplexity drawn towards its language's mean
    by PRIOR_BYTES. The threshold is ``quantile`` of the trusted texts of the language, read from a histogram, and a
    margin; ``kept`` is ``smoothed <= threshold``. A language without trusted texts (null is one) has the threshold of
    all; without any trusted text all with bytes are kept. Null and empty texts have no perplexity and are not kept.
    Repeated rows count as often as they stand. Columns with the four names are replaced; ids may be null. The scores of
    the documents' distinct n-grams are broadcast up to ``broadcast_grams`` of them, else blocks of texts ask for theirs;
    both give the same, but for the rounding of sums.
    """
    ids = cut(trusted_ids.select(F.col(trusted_ids.columns[0]).cast("string").alias("_trusted")).filter("_trusted is not null").distinct())
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = without(docs, "perplexity", "smoothed", "threshold", "kept")
    key, kind, size, nll = free(rows, "_trusted", "_kind", "_bytes", "_nll")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    half = F.when(F.col(key).isNull(), 0).otherwise(F.pmod(F.xxhash64(text), F.lit(2)) + 1).cast("int")
    named = ids.toDF(key)
    kinded = rows.join(named, F.col(f"`{id_col}`").cast("string") == F.col(key), "left").withColumn(kind, half).drop(key)
    total = rows.select(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")).cast("long"))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-total // SHARD_BYTES))
    values = values_of(cut(count_grams(kinded.select(text.alias("text"), F.col(kind).alias("kind")), shards)))
    if (values.agg(F.sum("n")).first()[0] or 0) <= broadcast_grams:
        scored = _by_broadcast(values, text_col, kind)
    else:
        scored = _by_blocks(values, kinded, shards, shards, id_col, text_col, kind)
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(""))
    known = scored(kinded.filter(F.col(kind) > 0), size, nll).select(lang.alias("_lang"), F.col(size).alias("_bytes"), F.col(nll).alias("_nll"))
    return judge(rows.columns, scored(kinded, size, nll), cut(known.filter("_bytes > 0")), lang, size, nll, quantile)


def smoothed_nats(nll: Column, size: Column, mean: Column) -> Column:
    return (nll + mean * PRIOR_BYTES) / (size + PRIOR_BYTES)


def judge(columns: list[str], scored: DataFrame, sample: DataFrame, lang: Column, size: str, nll: str, quantile: float) -> DataFrame:
    """``columns`` of ``scored`` rows with perplexity, smoothed, threshold and kept by the thresholds of ``sample``."""
    limits = thresholds(sample, quantile)
    everything = limits.filter("_lang is null").first()
    limits = cut(limits.filter("_lang is not null"))
    of_lang, own_mean, own_limit, drawn, limit = free(scored, "_lang", "_mean", "_limit", "_drawn", "_most")
    few = limits.count() <= 10_000
    joined = scored.join((F.broadcast(limits) if few else limits).toDF(of_lang, own_mean, own_limit), lang == F.col(of_lang), "left")
    mean = F.coalesce(own_mean, F.lit(everything["mean"] if everything else 0.0))
    nats = F.when(F.col(size) > 0, smoothed_nats(F.col(nll), F.col(size), mean))
    joined = joined.withColumns({drawn: F.exp(nats), limit: F.exp(F.coalesce(own_limit, F.lit(everything["limit"] if everything else float("inf"))))})
    return joined.select(
        *[f"`{c}`" for c in columns], F.when(F.col(size) > 0, F.exp(F.col(nll) / F.greatest(size, F.lit(1)))).alias("perplexity"),
        F.col(drawn).alias("smoothed"), F.col(limit).alias("threshold"), F.coalesce(F.col(drawn) <= F.col(limit), F.lit(False)).alias("kept"),
    )


def thresholds(sample: DataFrame, quantile: float) -> DataFrame:
    """(_lang, mean, limit) of each language and, with a null _lang, of all, in nats a byte, from (_lang, _bytes, _nll).

    ``limit`` is the least upper edge of a histogram's bins, a thousandth of a nat wide, up to which ``quantile`` of the texts
    are, and MARGIN: so it is at most a bin above the exact quantile.
    """
    both = sample.unionAll(sample.select(F.lit(None).cast("string").alias("_lang"), "_bytes", "_nll"))
    means = cut(both.groupBy("_lang").agg(F.sum(F.round(F.col("_nll") * 1000).cast("decimal(38,0)")).alias("nll"), F.sum("_bytes").alias("bytes"), F.count("*").alias("rows")))
    means = means.select(F.col("_lang").alias("_m"), (F.col("nll").cast("double") / 1000 / F.col("bytes")).alias("mean"), "rows")
    drawn = smoothed_nats(F.col("_nll"), F.col("_bytes"), F.col("mean"))
    bins = both.join(means, F.col("_lang").eqNullSafe(F.col("_m"))).groupBy("_lang", "mean", "rows", F.ceil(drawn * _STEP).alias("bin")).agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.partitionBy("_lang").orderBy("bin"))
    return bins.withColumn("upto", running).filter(F.col("upto") >= F.col("rows") * quantile).groupBy("_lang", "mean").agg((F.min("bin") / _STEP + MARGIN).alias("limit"))
