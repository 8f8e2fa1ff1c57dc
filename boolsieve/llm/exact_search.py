"""Exact search for the largest inner products of whole-number vectors by a pivot table.

The distances of every vector from some pivots are a table. For a query the largest difference to its own distances is a
lower bound of how far a vector is, and so, with both lengths, an upper bound of their product. Vectors are rated in the
order of that bound until it is below the k-th best product: what is left can't be among the best.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boolsieve.llm.common import release
from boolsieve.session import Shared, cut, shared_folder

#: Rows that pivots are chosen from, by hash, and that make the first wave on average; the number of pivots.
SAMPLE_ROWS, PIVOTS = 2048, 32
#: Bytes of the vectors of that sample, and of the queries that are broadcast at once, at most.
SAMPLE_BYTES, QUERY_BYTES = 64 << 20, 16 << 20
#: Each wave has as many times the rows of those before it; queries of a block at most; vectors that a task compares at once.
WAVE_GROWTH, QUERY_ROWS, TILE_ROWS = 8, 8192, 4096

_KINDS = {"i2": 1 << 15, "i4": 1 << 31, "f8": float("inf")}
_INDEXED = "row long, id long, is_query boolean, wave int, cell int, vector binary, far binary"
_FOUND = "query_row long, query_id long, row long, id long, score long"


def dense(column: pa.Array, width: int) -> np.ndarray:
    """The lists of a column as rows, zeros behind shorter ones; components times 64, rounded down."""
    ends = column.offsets.to_numpy()
    values = np.floor(64 * column.values.to_numpy()[ends[0] : ends[-1]].astype(np.float64))
    if len(values) and np.abs(values).max() >= 1 << 62:
        raise OverflowError("products of components from 2^56 on are no 64-bit numbers")
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], sizes)] = values
    return out


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Vectors of the sample, each the farthest from those before it; the first is the farthest from zero."""
    far = np.full(len(sample), np.inf)
    at = int(np.argmax((sample**2).sum(axis=1)))
    chosen = []
    while len(chosen) < n and far.max() > 0:
        chosen.append(at)
        far = np.minimum(far, ((sample - sample[at]) ** 2).sum(axis=1))
        at = int(np.argmax(far))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


class Ranking:
    """The k best of some queries: products, ids and rows, best first; ties to the smaller id, then row."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.best = k, [(np.zeros(0, object), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(n)]

    def least(self, q: int) -> float:
        """The k-th product, or none yet."""
        score = self.best[q][0]
        return score[-1] if len(score) == self.k else -np.inf

    def add(self, q: int, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        both = [np.concatenate([a, b]) for a, b in zip(self.best[q], (score, ids, rows))]
        order = np.lexsort((both[2], both[1], -both[0]))[: self.k]
        self.best[q] = tuple(a[order] for a in both)


class Queries:
    """A block of queries: their vectors, squared lengths and pivot distances, and what a k-th best is at least."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, far: np.ndarray, k: int) -> None:
        self.rows, self.ids, self.x, self.far, self.k = rows, ids, x, far, k
        self.norm = (x**2).sum(axis=1)
        self.least = np.full(len(rows), -np.inf)

    def rate(self, found: Ranking, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, far: np.ndarray) -> int:
        """Adds what some vectors give to the rankings, without those that can't be among the best; how many were rated."""
        norm = (x**2).sum(axis=1)
        largest = float(np.sqrt(norm.max() * self.norm.max()))
        exact = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else object
        vectors, asked = (x.astype(exact), self.x.astype(exact)) if exact is not object else (np.vectorize(int, otypes=[object])(x), np.vectorize(int, otypes=[object])(self.x))
        columns = np.ascontiguousarray(far.T)
        slack = 2 + 1e-5 * (norm.max() + self.norm.max())  # rounding of distances and lengths only
        rated = 0
        for q in range(len(self.rows)):
            apart = np.abs(columns - self.far[q][:, None]).max(axis=0)
            bound = 0.5 * (norm + self.norm[q] - apart.astype(np.float64) ** 2) + slack
            least = max(found.least(q), self.least[q])
            alive = np.flatnonzero(bound >= least)
            order = alive[np.argsort(-bound[alive])]
            at, step = 0, 64
            while at < len(order) and bound[order[at]] >= least:
                some = order[at : at + step]
                score = vectors[some] @ asked[q]
                good = (score >= least) & (rows[some] != self.rows[q])
                if good.any():
                    found.add(q, score[good] if exact is object else score[good].astype(np.int64), ids[some][good], rows[some][good])
                    least = max(found.least(q), self.least[q])
                rated += len(some)
                at, step = at + step, step * 8
        return rated


def _index(rows: DataFrame, pivots: np.ndarray, kind: str, width: int) -> DataFrame:
    """The pivot table."""
    dtype = np.float64 if kind == "f8" else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dense(batch.column("vector"), width)
            far = distances(x, pivots)
            packed = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (x.astype(kind), far.astype(dtype))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "id", "is_query", "wave")], pa.array(far.argmin(axis=1), pa.int32()), *packed], _names(_INDEXED))
            release()

    return rows.mapInArrow(run, _INDEXED)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _unpack(batch: pa.RecordBatch, kind: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, ids, vectors and pivot distances of a batch of the pivot table."""
    n = batch.num_rows
    x = np.frombuffer(b"".join(batch.column("vector").to_pylist()), kind).reshape(n, width).astype(np.float64)
    far = np.frombuffer(b"".join(batch.column("far").to_pylist()), np.float64 if kind == "f8" else np.float32).reshape(n, -1)
    return batch.column("row").to_numpy(), batch.column("id").fill_null(np.iinfo(np.int64).max).to_numpy(), x, far


def _wave(table: DataFrame, asked: Shared, kind: str, width: int) -> DataFrame:
    """The best of each task for the queries of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = asked.value
        found = Ranking(len(queries.rows), queries.k)
        tile: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            tile.append(_unpack(batch, kind, width))
            if sum(len(t[0]) for t in tile) >= TILE_ROWS:
                queries.rate(found, *map(np.concatenate, zip(*tile)))
                tile = []
        if tile and sum(len(t[0]) for t in tile):
            queries.rate(found, *map(np.concatenate, zip(*tile)))
        for at in range(0, len(queries.rows), 256):
            some = range(at, min(at + 256, len(queries.rows)))
            sizes = [len(found.best[q][0]) for q in some]
            own = [np.repeat(a[at : at + 256], sizes) for a in (queries.rows, queries.ids)]
            score, ids, rows = ([v for q in some for v in found.best[q][i].tolist()] for i in range(3))
            ids = pa.array([None if i == np.iinfo(np.int64).max else i for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([*map(pa.array, own), pa.array(rows, pa.int64()), ids, pa.array(score, pa.int64())], _names(_FOUND))
        release()

    return table.select("row", "id", "vector", "far").mapInArrow(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of the largest products with each query, ties to the smaller id.

    Components are floor(64 * x); ids are whole numbers. A query is any row that ``is_query`` holds for; its own row is no
    candidate, a repeated one is. Null vectors and those with a null or non-finite component take no part; a shorter vector
    has zeros behind it; a null id comes after all others; an empty table gives an empty result. Components from 2^56 on
    and products beyond 64 bits raise. Other columns are not read.

    Every row is in the pivot table, which is written by waves and, within, by the nearest pivot. Queries go in blocks of
    bounded rows and bytes, each a broadcast; a block meets wave after wave, each WAVE_GROWTH times what came before, and
    brings the k-th best so far along, so that a task hands on few rows: expected WAVE_GROWTH * k for a query and wave.
    """
    spark = vectors.sparkSession
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    whole = vector.isNotNull() & ~F.exists(F.coalesce(vector, F.array()), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), vector.alias("vector"), whole.alias("whole")).filter("whole").drop("whole")
    largest = F.array_max(F.transform("vector", lambda x: F.abs(F.lit(64.0) * x)))
    facts = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("queries"), F.max(F.size("vector")).alias("width"), F.max(largest).alias("largest")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not facts["queries"]:
        return empty
    n, width = facts["n"], max(1, facts["width"])
    kind = next(c for c, bound in _KINDS.items() if (facts["largest"] or 0) + 1 < bound)
    size = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width)))
    drawn = rows.orderBy(F.xxhash64("vector"), "id").limit(size).select("vector").toArrow()
    pivots = choose_pivots(dense(drawn["vector"].combine_chunks(), width))
    pivots = pivots if len(pivots) else np.zeros((1, width))

    place = F.pmod(F.xxhash64(F.lit("wave"), "id", "row"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wave = F.greatest(F.lit(0), F.ceil(F.log(F.greatest(place * (n / SAMPLE_ROWS), F.lit(1e-9))) / float(np.log(WAVE_GROWTH)))).cast("int")
    table = _index(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("wave", wave), pivots, kind, width)
    folder = f"{shared_folder(spark)}/topk-{uuid.uuid4().hex}"
    table.repartitionByRange("wave", "cell", "row").sortWithinPartitions("wave", "cell", "row").write.partitionBy("wave").parquet(f"{folder}/table")
    index = spark.read.schema(_INDEXED).parquet(f"{folder}/table")
    waves = sorted(r["wave"] for r in index.select("wave").distinct().collect())  # a logarithm of the rows

    most = max(1, min(query_rows, QUERY_BYTES // (width * 8 + len(pivots) * 8)))
    blocks = -(-facts["queries"] // max(1, most * 3 // 4))
    block = F.pmod(F.xxhash64(F.lit("block"), "row"), F.lit(blocks))
    while (index.filter("is_query").groupBy(block.alias("b")).count().agg(F.max("count")).first()[0] or 0) > most:
        blocks += blocks // 2 + 1
        block = F.pmod(F.xxhash64(F.lit("block"), "row"), F.lit(blocks))
    for b in range(blocks):
        held = index.filter(F.col("is_query") & (block == b)).select("row", "id", "vector", "far").toArrow()  # at most ``most`` rows
        if not held.num_rows:
            continue
        queries = Queries(*_unpack(held.combine_chunks().to_batches()[0], kind, width), k)
        best = None
        for w in waves:
            here = index.filter(F.col("wave") == w)
            found = _wave(here.coalesce(1) if w == 0 else here, Shared(spark, queries), kind, width)  # wave 0 has about SAMPLE_ROWS rows
            best = cut(_best(found if best is None else best.unionByName(found), k).drop("rank"))
            if w != waves[-1]:
                full = best.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k).toArrow()  # a row a query
                at = np.argsort(queries.rows)
                queries.least[at[np.searchsorted(queries.rows, full["query_row"].to_numpy(), sorter=at)]] = full["least"].to_numpy()
        _best(best, k).write.mode("append").parquet(f"{folder}/best")
    remove(spark, f"{folder}/table")
    return spark.read.schema(f"{_FOUND}, rank int").parquet(f"{folder}/best").select("query_id", "rank", F.col("id").alias("vec_id"), "score")
