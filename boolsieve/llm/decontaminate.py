"""Finds passages of benchmark items in documents through an FM-index of each shard of the documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boolsieve.llm.common import slices, utf8, without, words
from boolsieve.session import Shared

#: Words of a window.
WINDOW = 10
#: Text of benchmark items that one pass looks for, in bytes; more items make more passes.
BLOCK_BYTES = 8 << 20
#: Every position divisible by this is kept to locate occurrences.
SAMPLE = 8

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


class WaveletMatrix:
    """Counts of a symbol before a position, for many symbols and positions at once."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels: list[tuple[int, np.ndarray, int]] = []
        now = symbols
        for level in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            ones = (now >> level & 1).astype(bool)
            before = np.zeros(len(now) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((level, before, len(now) - int(before[-1])))
            now = np.concatenate([now[~ones], now[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        start, to = np.zeros_like(at), at
        for level, before, zeros in self.levels:
            one = (symbol >> level & 1).astype(bool)
            a, b = before[start], before[to]
            start, to = np.where(one, zeros + a, start - a), np.where(one, zeros + b, to - b)
        return to - start


def suffix_array(symbols: np.ndarray, sigma: int) -> np.ndarray:
    """Positions by the order of their suffixes; a text's end sorts before every symbol. Prefix doubling, open groups only."""
    n = len(symbols)
    width = int(sigma).bit_length()
    depth = min(n, max(1, 62 // width))
    key = np.zeros(n, np.int64)
    for i in range(depth):  # symbols count from one here, so that an end is zero
        key <<= width
        key[: n - i] |= symbols[i:] + 1
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.ones(n, bool)
    first[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    while True:
        head = np.flatnonzero(first)
        if len(head) == n:
            return order
        sizes = np.diff(np.append(head, n))
        opened = np.repeat(sizes > 1, sizes)
        slots = np.flatnonzero(opened)
        at = order[slots]
        later = at + depth
        second = np.where(later < n, rank[np.minimum(later, n - 1)] + 1, 0)
        by = np.argsort(rank[at] * (n + 1) + second, kind="stable")
        at, own, second = at[by], rank[at[by]], second[by]
        order[slots] = at
        new = np.ones(len(at), bool)
        new[1:] = (own[1:] != own[:-1]) | (second[1:] != second[:-1])
        first[slots] = new
        begin = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[at] = begin
        depth *= 2


class FMIndex:
    """Backward search over one shard that ends in a zero: its Burrows-Wheeler transform in a wavelet matrix, with sampled positions."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.n = len(symbols)
        order = suffix_array(symbols, sigma)
        self.end = int(np.flatnonzero(order == 0)[0])  # its predecessor is the text's end, which no pattern holds
        bwt = symbols[order - 1]
        bwt[self.end] = sigma
        self.bwt = bwt
        self.wavelet = WaveletMatrix(bwt, sigma + 1)
        counts = np.bincount(symbols, minlength=sigma + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])[: sigma + 1]
        self.sampled = order % SAMPLE == 0
        self.place = np.cumsum(self.sampled) - 1
        self.kept = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``phrases`` that occur, with their ranges. A phrase is aligned right, with -1 before it."""
        who = np.arange(len(phrases))
        low, high = np.zeros(len(who), np.int64), np.full(len(who), self.n, np.int64)
        for t in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[who, t]
            real = c >= 0
            cc = np.where(real, c, 0)
            low = np.where(real, self.before[cc] + self.wavelet.rank(cc, low), low)
            high = np.where(real, self.before[cc] + self.wavelet.rank(cc, high), high)
            on = low < high
            who, low, high = who[on], low[on], high[on]
        return who, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions that the rows of the sorted suffixes have: steps back until a sampled one."""
        found = np.empty(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows, 0
        while len(todo):
            hit = self.sampled[at]
            found[todo[hit]] = self.kept[self.place[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            c = self.bwt[at].astype(np.int64)
            at = self.before[c] + self.wavelet.rank(c, at) + (c == 0)  # the last symbol is a zero, before an end that has no row
            steps += 1
        return found


class Phrases:
    """The distinct windows of some benchmark items, as symbols of their vocabulary."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int) -> None:
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for name, text in items:
            w = words(text)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                owners.setdefault(tuple(w[i : i + window]), set()).update([] if name is None else [name])
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for p in owners for w in p}), 1)}  # 0: any other word
        self.sigma = len(self.vocabulary) + 1
        self.table = np.full((len(owners), window), -1, np.int64)
        for row, phrase in zip(self.table, owners):
            row[window - len(phrase) :] = [self.vocabulary[w] for w in phrase]
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.owners = [sorted(x) for x in owners.values()]


def scan_shard(texts: list[bytes], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """For each text its number of words, the merged spans of words that windows hit, and the items of those windows."""
    lists = [words(t) for t in texts]
    sizes = np.array([len(w) for w in lists], np.int64)
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    if sizes.sum() and len(phrases.lengths):
        get = phrases.vocabulary.get
        symbols = np.fromiter((s for w in lists for s in (*[get(x, 0) for x in w], 0)), np.int64, int(ends[-1]))
        del lists
        index = FMIndex(symbols, phrases.sigma)
        who, low, high = index.search(phrases.table)
        if len(who):
            many = high - low
            rows = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            which = np.repeat(who, many)
            places = index.locate(rows)
            change = np.zeros(len(symbols) + 1, np.int32)
            np.add.at(change, places, 1)
            np.add.at(change, places + phrases.lengths[which], -1)
            hit = np.concatenate([[0], (np.cumsum(change) > 0).astype(np.int8)])
            edges = np.diff(hit)
            doc_of = lambda x: np.searchsorted(ends, x, side="right")
            begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            for d, a, b in zip(doc_of(begin).tolist(), begin.tolist(), end.tolist()):
                spans[d].append((a - int(starts[d]), b - int(starts[d])))
            for d, p in {*zip(doc_of(places).tolist(), which.tolist())}:
                items[d].update(phrases.owners[p])
    return list(zip(sizes.tolist(), spans, items))


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of two lists of spans; touching spans become one."""
    out: list[tuple[int, int]] = []
    for x, y in sorted([*a, *b]):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in blocks of about ``limit`` bytes of text, each small enough for the driver and a broadcast."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // limit))
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield [(r["id"], r["text"].encode()) for r in part.collect()]


def mark(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (merged word positions) and ``hit_items`` (ids as strings, sorted).

    Words are lower-cased runs of letters, digits and characters above ASCII. An item's windows are all its runs of
    ``window`` words; a shorter item is one window, one without words none. Null texts have no words. Repeated items
    count once by id; an item with a null id marks words but is not listed. Input columns of the three names are
    replaced. Every pass is narrow: a shard is a step of one task, and a block of items is broadcast to it.
    """
    made = "n_words long, hit_spans array<struct<start:int,end:int>>, hit_items array<string>"
    out = without(docs, "n_words", "hit_spans", "hit_items")
    at = out.columns.index(text_col)
    for k, items in enumerate(_blocks(benchmark, item_col, item_text_col, block_bytes)):
        shared = Shared(docs.sparkSession, Phrases(items, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, k=k) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text_col):
                found = scan_shard(utf8(part.column(at)), shared.value)
                spans, named = [s for _, s, _ in found], [x for _, _, x in found]
                columns = part.columns
                if k:
                    earlier = [[(x["start"], x["end"]) for x in row] for row in columns[-2].to_pylist()]
                    spans = [merged(a, b) for a, b in zip(spans, earlier)]
                    named = [a | set(b) for a, b in zip(named, columns[-1].to_pylist())]
                    columns = columns[:-3]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([n for n, _, _ in found], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPANS),
                     pa.array([sorted(x) for x in named], pa.list_(pa.string()))],
                    [*part.schema.names[: len(columns)], "n_words", "hit_spans", "hit_items"],
                )

        base = out.schema if not k else out.drop("n_words", "hit_spans", "hit_items").schema
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base)
        out = out.mapInArrow(run, f"{fields}, {made}")
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_hit, n_items, items_sha256 and contaminated; see ``mark``."""
    marked = mark(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")), benchmark)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return marked.select(
        F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def cut_out(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, text[at:]])


def remove_passages(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every hit passage cut from its text; ``chars_col`` (if there is one) counts what is left.

    All rows stay; those without a hit keep their text and count as they are, nulls included.
    """
    marked = mark(docs, benchmark, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            at, names = part.schema.names.index(text_col), part.schema.names
            spans = part.column(names.index("hit_spans")).to_pylist()
            raw = utf8(part.column(at))
            hit = [bool(s) for s in spans]
            columns = list(part.columns)
            if any(hit):
                texts = [cut_out(t, [(x["start"], x["end"]) for x in s]).decode() if s else v for t, s, v in zip(raw, spans, part.column(at).to_pylist())]
                columns[at] = pa.array(texts, pa.string())
                if chars_col in names:
                    c = names.index(chars_col)
                    old = columns[c].to_pylist()
                    columns[c] = pa.array([len(t) if h else v for t, h, v in zip(texts, hit, old)], columns[c].type)
            yield pa.RecordBatch.from_arrays(columns[:-3], names[:-3])

    kept = marked.columns[:-3]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema if f.name in kept)
    return marked.mapInArrow(run, fields)
