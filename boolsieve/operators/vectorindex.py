"""Nearest neighbours by an inverted file of cells and product codes, rated again exactly.

Cells and code books are fitted on a stated sample; every row is coded. A search looks into the cells nearest to a query, rates
their codes by table look-up, and takes the exact cosine of the best ones. How many cells and how many of the best are needed for
a wanted recall is measured on calibration queries, so the index says itself when vectors have no structure to use.

Vectors that are null or hold null or non-finite components take no part; all others must have one length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boolsieve.operators import ranking
from boolsieve.session import Shared, cut, fits, small

#: Rows that cells and code books are fitted on, chosen by a hash of their id, and the most cells, 32 of those rows each.
SAMPLE, MAX_CELLS = 65_536, 2_048
#: Parts of a vector that have a code of their own, a byte each, and rounds of fitting.
PARTS, ROUNDS = 16, 10
#: Coded rows that one task looks through; a cell of more is several tasks.
ROWS_PER_TASK = 500_000
#: Calibration queries, chosen by a hash, and the most rows that are rated again for each neighbour that is asked for.
CALIBRATION, MOST_WANTED = 100, 100
_BATCH = 2_048


@dataclass(frozen=True)
class Index:
    """Cells (cells, dims), code books (PARTS, 256, dims / PARTS) and the coded rows (doc_id, cell, part, code)."""

    cells: np.ndarray
    books: np.ndarray
    codes: DataFrame
    dims: int


@dataclass(frozen=True)
class Setting:
    """Cells to look into and rows to rate again for each query, and the recall that calibration queries had."""

    probes: int
    wanted: int
    recall: float


def usable(v: Column) -> Column:
    """Whether a vector is there, and all of its components are finite."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & (F.size(v) > 0)


def _means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres by Lloyd's rounds from k rows; one without rows stays where it is."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    centres = np.concatenate([centres, np.zeros((k - len(centres), x.shape[1]), x.dtype)])
    for _ in range(ROUNDS):
        own = _nearest(x, centres)
        count = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, j], minlength=k) for j in range(x.shape[1])], 1)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres).astype(x.dtype)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmin(half - x[at : at + 8192] @ centres.T, 1) for at in range(0, len(x), 8192)] or [np.zeros(0, int)])


def _unit(rows: np.ndarray, dims: int) -> np.ndarray:
    """Rows at length one, with zeros up to a multiple of PARTS; a row of zeros stays."""
    rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)
    return np.pad(rows, ((0, 0), (0, -dims % PARTS))).astype(np.float32)


def _matrix(values: pa.Array, dims: int) -> np.ndarray:
    if len(values) and not np.all(np.diff(values.offsets.to_numpy()) == dims):
        raise ValueError(f"vectors must have {dims} components")
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def build(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cells: int | None = None, sample: int = SAMPLE) -> Index:
    """Fits cells (the root of the rows, MAX_CELLS at most) and code books on ``sample`` rows, and codes every row, once."""
    own = vectors.select(F.col(id_col).alias("doc_id"), F.col(vec_col).cast("array<double>").alias("v")).filter(usable(F.col("v")))
    n = own.count()
    rows = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()  # the stated sample
    if not rows:
        return Index(np.zeros((1, PARTS), np.float32), np.zeros((PARTS, 256, 1), np.float32), cut(own.selectExpr("doc_id", "0 AS cell", "0 AS part", "CAST('' AS BINARY) AS code")), 0)
    dims = len(rows[0]["v"])
    if any(len(r["v"]) != dims for r in rows):
        raise ValueError(f"vectors must have {dims} components")
    x = _unit(np.array([r["v"] for r in rows]), dims)
    k = max(1, min(cells or min(MAX_CELLS, int(n**0.5)), len(x)))
    centres = _means(x, k, 0)
    rest = (x - centres[_nearest(x, centres)]).reshape(len(x), PARTS, -1)
    books = np.stack([_means(np.ascontiguousarray(rest[:, m]), 256, m + 1) for m in range(PARTS)])
    fitted = Shared(vectors.sparkSession, (centres, books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books = fitted.value
        for b in batches:
            x = _unit(_matrix(b.column("v"), dims), dims)
            cell = _nearest(x, centres)
            rest = (x - centres[cell]).reshape(len(x), PARTS, -1)
            code = np.stack([_nearest(rest[:, m], books[m]) for m in range(PARTS)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], ["doc_id", "cell", "code"])

    kind = own.schema["doc_id"].dataType.simpleString()
    coded = cut(own.mapInArrow(run, f"doc_id {kind}, cell int, code binary"))
    tasks = small(coded.groupBy("cell").agg(F.ceil(F.count("*") / ROWS_PER_TASK).cast("int").alias("tasks")))
    coded = coded.join(tasks, "cell").select("doc_id", "cell", F.pmod(F.xxhash64("doc_id"), F.col("tasks")).cast("int").alias("part"), "code")
    return Index(centres, books, cut(coded.repartition("cell", "part").sortWithinPartitions("cell", "part", "doc_id")), dims)


def _near_cells(index: Index, q: np.ndarray) -> np.ndarray:
    """The cells in the order of their distance from each query."""
    return np.argsort((index.cells**2).sum(1) / 2 - q @ index.cells.T, axis=1, kind="stable")


def _coded_best(index: Index, ids: list, q: np.ndarray, probes: int, wanted: int, query_kind: str) -> DataFrame:
    """(query_id, doc_id, guess): by task and query the ``wanted`` best codes of the nearest cells. A query is in as many tasks as its cells are."""
    order = _near_cells(index, q)[:, :probes]
    askers: dict[int, np.ndarray] = {int(c): np.flatnonzero((order == c).any(1)) for c in np.unique(order)}
    table = np.einsum("qmd,mkd->qmk", q.reshape(len(q), PARTS, -1), index.books).astype(np.float32)
    shared = Shared(index.codes.sparkSession, (ids, table, (q @ index.cells.T).astype(np.float32), askers))
    kind = index.codes.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, table, base, askers = shared.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        seen: list = []  # ids by number; those that no query holds go now and then
        full = 4 * ROWS_PER_TASK
        for b in batches:
            for at in range(0, b.num_rows, _BATCH):
                rows = b.slice(at, _BATCH)
                cell = rows.column("cell").to_numpy()
                code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(-1, PARTS)
                names = rows.column("doc_id").to_pylist()
                number = np.arange(len(seen), len(seen) + len(names))
                seen += names
                for c in np.unique(cell):
                    mine = np.flatnonzero(cell == c)
                    for asker in askers.get(int(c), ()):
                        guess = base[asker, c] + table[asker][np.arange(PARTS), code[mine]].sum(1)
                        old = best.get(asker)
                        both = (guess, number[mine]) if old is None else (np.concatenate([old[0], guess]), np.concatenate([old[1], number[mine]]))
                        if len(both[0]) > 2 * wanted:
                            both = _top(*both, wanted)
                        best[asker] = both
            if len(seen) > full:
                seen, best = _forget(seen, best)
                full = max(4 * ROWS_PER_TASK, 2 * len(seen))
        for asker, (guess, number) in best.items():
            guess, number = _top(guess, number, wanted)
            data = [pa.array([ids[asker]] * len(guess)), pa.array([seen[i] for i in number]), pa.array(guess.astype(np.float64))]
            yield pa.RecordBatch.from_arrays(data, ["query_id", "doc_id", "guess"])

    found = index.codes.filter(F.col("cell").isin([int(c) for c in askers])) if len(askers) < len(index.cells) else index.codes
    return found.mapInArrow(run, f"query_id {query_kind}, doc_id {kind}, guess double")


def _top(guess: np.ndarray, number: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n best; of equal ones the first, and rows come in the order of their ids."""
    keep = np.lexsort((number, -guess))[:n]
    return guess[keep], number[keep]


def _forget(seen: list, best: dict) -> tuple[list, dict]:
    """Ids that no query holds any more leave memory."""
    held = np.unique(np.concatenate([n for _, n in best.values()])) if best else np.zeros(0, int)
    return [seen[i] for i in held], {k: (g, np.searchsorted(held, n)) for k, (g, n) in best.items()}


def guesses(index: Index, queries: DataFrame, probes: int, wanted: int) -> DataFrame:
    """(query_id, doc_id, guess, rank): the ``wanted`` rows of each query (query_id, q) whose codes are nearest. Queries go in bounded blocks."""
    queries = cut(queries.filter(usable(F.col("q"))))
    kind = queries.schema["query_id"].dataType.simpleString()
    blocks = max(1, -(-queries.count() // ranking.QUERY_BLOCK))
    part = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    out = []
    for k in range(blocks):
        rows = queries.filter(part == k).select("query_id", F.col("q").cast("array<double>").alias("q")).collect()  # QUERY_BLOCK on average
        if rows and index.dims:
            q = _unit(np.array([r["q"] for r in rows]).reshape(-1, index.dims), index.dims)
            out.append(cut(_coded_best(index, [r["query_id"] for r in rows], q, probes, wanted, kind)))  # one block's tables at a time
    none = index.codes.limit(0).selectExpr(f"CAST(NULL AS {kind}) AS query_id", "doc_id", "CAST(NULL AS DOUBLE) AS guess")
    return ranking.ranked(reduce(DataFrame.unionByName, out, none).withColumnRenamed("guess", "score"), wanted).withColumnRenamed("score", "guess")


def search(index: Index, vectors: DataFrame, queries: DataFrame, k: int, setting: Setting, id_col: str = "vec_id", vec_col: str = "embedding", skip_self: bool = True) -> DataFrame:
    """(query_id, doc_id, score, rank) as ``ranking.search`` gives it, for the best rows by their codes only."""
    found = guesses(index, queries, setting.probes, setting.wanted + skip_self).select("query_id", "doc_id")
    if skip_self:
        found = found.filter(F.col("doc_id") != F.col("query_id"))
    own = vectors.select(F.col(id_col).alias("doc_id"), F.col(vec_col).alias("v"))
    asked = queries if not fits(queries) else F.broadcast(queries)
    scored = cut(found).join(own, "doc_id").join(asked, "query_id").select("query_id", "doc_id", ranking.cosine(F.col("v"), F.col("q")).alias("score"))
    return ranking.ranked(scored, k)


def calibrate(index: Index, vectors: DataFrame, k: int, recall: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", queries: int = CALIBRATION) -> Setting:
    """The fewest cells that hold enough true neighbours of ``queries`` rows, then the fewest rows to rate again, both by exact search.

    Cells and codes share the loss that ``recall`` allows. Where codes are too coarse for it, ``wanted`` is its limit and the
    setting's recall says what was reached.
    """
    asked = vectors.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("q")).filter(usable(F.col("q")))
    asked = cut(asked.orderBy(F.xxhash64(F.lit(1), "query_id"), "query_id").limit(queries))
    true = cut(ranking.search(vectors.filter(usable(F.col(vec_col))), asked, k, id_col=id_col, vec_col=vec_col).select("query_id", "doc_id"))
    rows = {r["query_id"]: r["q"] for r in asked.collect()}
    cells = [(r["query_id"], r["cell"]) for r in index.codes.join(small(true), "doc_id").select("query_id", "cell").collect()]  # queries x k
    if not cells:
        return Setting(1, k, 1.0)
    names = list(rows)
    place = np.argsort(_near_cells(index, _unit(np.array([rows[n] for n in names], float), index.dims)), axis=1)
    at = {n: i for i, n in enumerate(names)}
    needed = np.sort([place[at[q], c] for q, c in cells])
    probes = int(needed[int(np.ceil((1 + recall) / 2 * len(needed))) - 1]) + 1
    got = guesses(index, asked, probes, MOST_WANTED * k).join(small(true), ["query_id", "doc_id"]).select("rank").collect()
    ranks = np.sort([r["rank"] for r in got])
    enough = min(int(np.ceil(recall * len(cells))), len(ranks))
    wanted = max(k, int(ranks[enough - 1]) + 1) if enough else MOST_WANTED * k
    return Setting(probes, wanted, float((ranks < wanted).sum()) / len(cells))
