"""A binary matrix in shards of rows. Every step of learning is a sum over them, so it gives the same however they are held."""

from __future__ import annotations

import ast
import io
import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boolsieve.functions.bitmaps import Bitmap
from boolsieve.operators.bitmaps import Sets
from boolsieve.session import cut, release, small_batches

#: Postings of a shard, at four bytes each, and up to how many in all the shards are summed in the driver, not in tasks.
SHARD_POSTINGS, DRIVER_POSTINGS = 1_000_000, 4_000_000
#: Bytes of sums that a task holds before it hands them on; terms are dealt to blocks whose sums take an eighth of it.
BLOCK_BYTES = 64 << 20
#: Sums that meet in one task for a key: those of more shards meet by salts first, level by level.
FAN_IN = 64

Step = Callable[["Part"], Iterable[tuple[tuple, np.ndarray]]]


@dataclass
class Matrix:
    """A binary matrix by columns: those that have rows, by number; the rows of the i-th are ``rows[starts[i]:starts[i + 1]]``, in order.

    It takes memory by its postings, however wide the vocabulary is.
    """

    ids: np.ndarray
    starts: np.ndarray
    rows: np.ndarray
    n_terms: int
    n_rows: int

    @classmethod
    def of(cls, term: np.ndarray, row: np.ndarray, n_terms: int, n_rows: int) -> Matrix:
        order = np.lexsort((row, term))
        ids, sizes = np.unique(term, return_counts=True)
        return cls(ids.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), row[order].astype(np.int32), n_terms, n_rows)

    @cached_property
    def place(self) -> np.ndarray:
        """Of every posting, which of the columns that have rows it is in."""
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.starts))

    @property
    def term(self) -> np.ndarray:
        """The term of every posting."""
        return self.ids[self.place]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of some row values over every column; for few columns."""
        upto = np.concatenate([[0], np.cumsum(values[self.rows])])
        out = np.zeros(self.n_terms, upto.dtype)
        out[self.ids] = upto[self.starts[1:]] - upto[self.starts[:-1]]
        return out

    def column(self, t: int) -> np.ndarray:
        i = int(np.searchsorted(self.ids, t))
        return self.rows[self.starts[i] : self.starts[i + 1]] if i < len(self.ids) and self.ids[i] == t else self.rows[:0]

    def any_of(self, terms: list[int] | tuple[int, ...]) -> np.ndarray:
        out = np.zeros(self.n_rows, bool)
        for t in terms:
            out[self.column(t)] = True
        return out

    def only(self, terms: np.ndarray) -> Matrix:
        """Some columns, numbered by their place among them."""
        at = np.minimum(np.searchsorted(self.ids, terms), max(0, len(self.ids) - 1))
        here = np.flatnonzero(self.ids[at] == terms) if len(self.ids) else np.zeros(0, np.int64)
        at = at[here]
        sizes = self.starts[at + 1] - self.starts[at]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        from_ = np.arange(starts[-1]) - np.repeat(starts[:-1] - self.starts[at], sizes)
        return Matrix(here, starts, self.rows[from_], len(terms), self.n_rows)


@dataclass
class Part:
    """One shard: its rows' terms, labels, whole-number weights, and a number that each row keeps wherever it is dealt."""

    x: Matrix
    y: np.ndarray
    w: np.ndarray
    key: np.ndarray
    targets: Matrix | None = None  # other labels, a column each

    def labels(self, target: int | None) -> np.ndarray:
        return self.y if target is None else self.targets.any_of([target]).astype(np.int64)

    def dumps(self) -> bytes:
        out = io.BytesIO()
        more = {} if self.targets is None else {"t_ids": self.targets.ids, "t_starts": self.targets.starts, "t_rows": self.targets.rows, "t_terms": self.targets.n_terms}
        np.savez_compressed(out, ids=self.x.ids, starts=self.x.starts, rows=self.x.rows, terms=self.x.n_terms, y=self.y, w=self.w, key=self.key, **more)
        return out.getvalue()

    @classmethod
    def loads(cls, raw: bytes) -> Part:
        a = np.load(io.BytesIO(raw))
        n = len(a["y"])
        targets = Matrix(a["t_ids"], a["t_starts"], a["t_rows"], int(a["t_terms"]), n) if "t_rows" in a else None
        return cls(Matrix(a["ids"], a["starts"], a["rows"], int(a["terms"]), n), a["y"], a["w"], a["key"], targets)

    @cached_property
    def sets(self) -> Sets:
        """Its terms' rows as compressed sets, made when they are asked for."""
        made: dict[int, Bitmap] = {}

        def find(t: int) -> Bitmap:
            if t not in made:
                made[t] = Bitmap.of(self.x.column(t))
            return made[t]

        return Sets(find, lambda: self.all)

    @cached_property
    def all(self) -> Bitmap:
        return Bitmap.span(len(self.y))

    @cached_property
    def positives(self) -> Bitmap:
        return Bitmap.of(np.flatnonzero(self.y == 1))


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two sparse arrays, whose first row has ids in order, by id."""
    both = np.concatenate([a, b], axis=1)
    both = both[:, np.argsort(both[0], kind="stable")]
    if not both.shape[1]:
        return both
    starts = np.flatnonzero(np.concatenate([[True], np.diff(both[0]) > 0]))
    return np.concatenate([both[:1, starts], np.add.reduceat(both[1:], starts, axis=1)])


class Sum:
    """A running sum that holds no more than what it comes to; sparse arrays wait until they are as much as the sum."""

    def __init__(self, sparse: bool) -> None:
        self.sparse, self.value, self.waiting, self.size = sparse, None, [], 0

    def add(self, values: np.ndarray) -> None:
        if self.value is None:
            self.value = values.copy()
        elif not self.sparse:
            self.value += values
        else:
            self.waiting.append(values)
            self.size += values.shape[1]
            if self.size >= self.value.shape[1]:
                self.settle()

    def settle(self) -> np.ndarray:
        if self.waiting:
            self.value = _merge(self.value, np.concatenate(self.waiting, axis=1))
            self.waiting, self.size = [], 0
        return self.value


def add_up(rows: Iterable[tuple[str, np.ndarray]], sparse: bool, held: int) -> Iterator[tuple[str, np.ndarray]]:
    """Sums by key of what comes in any order; beyond ``held`` bytes it hands on what it has and starts anew."""
    by: dict[str, Sum] = {}
    size = 0
    for key, values in rows:
        if key not in by:
            by[key] = Sum(sparse)
        by[key].add(values)
        size += values.nbytes if sparse else 0
        if max(size, 0 if sparse else len(by) * values.nbytes) > held:
            yield from ((k, s.settle()) for k, s in by.items())
            by, size = {}, 0
    yield from ((k, s.settle()) for k, s in by.items())


def add_sorted(rows: Iterable[tuple[str, np.ndarray]], sparse: bool) -> Iterator[tuple[str, np.ndarray]]:
    """Sums by key of what comes in the order of keys: one sum and one array at a time."""
    key, total = None, Sum(sparse)
    for k, values in rows:
        if k != key:
            if key is not None:
                yield key, total.settle()
            key, total = k, Sum(sparse)
        total.add(values)
    if key is not None:
        yield key, total.settle()


_SUMS = "key string, data binary"


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The values of some columns, a row at a time; what a batch took is given back before the next one is read."""
    for batch in batches:
        columns = [batch.column(name) for name in names]
        del batch
        for i in range(len(columns[0])):
            yield tuple(c[i].as_py() for c in columns)
        del columns
        release()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
    for key, data in _rows(batches, "key", "data"):
        yield key, pickle.loads(data)


def _written(rows: Iterable[tuple[str, Any]]) -> Iterator[pa.RecordBatch]:
    for key, value in rows:
        yield pa.RecordBatch.from_pydict({"key": [key], "data": pa.array([pickle.dumps(value)], pa.binary())})


class Shards:
    """The shards of a matrix, in the driver or in the checkpoint folder."""

    def __init__(self, n_terms: int, parts: list[Part] | None = None, table: DataFrame | None = None, n_shards: int = 1) -> None:
        self.n_terms, self.parts, self.table, self.n_shards = n_terms, parts, table, n_shards

    @classmethod
    def of(cls, x: Matrix, y: np.ndarray, w: np.ndarray | None = None) -> Shards:
        """A matrix as one shard."""
        w = np.full(len(y), 100) if w is None else w
        return cls(x.n_terms, [Part(x, np.asarray(y, np.int64), np.asarray(w, np.int64), np.arange(len(y)))])

    def total(self, step: Step, finish: Callable[[tuple, np.ndarray], Any] | None = None, sparse: bool = False) -> dict[tuple, Any]:
        """What ``step`` gives for each key, added up over the shards and finished where it is added up."""
        if self.parts is not None:
            sums = add_up(((repr(k), v) for part in self.parts for k, v in step(part)), sparse, 1 << 62)
            return {ast.literal_eval(k): finish(ast.literal_eval(k), v) if finish else v for k, v in sums}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = (Part.loads(raw) for (raw,) in _rows(batches, "part"))
            yield from _written(add_up(((repr(k), v) for part in parts for k, v in step(part)), sparse, BLOCK_BYTES))

        def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _written(add_sorted(_read(batches), sparse))

        def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, value in add_sorted(_read(batches), sparse):
                yield from _written([(key, finish(ast.literal_eval(key), value) if finish else value)])

        small_batches(self.table.sparkSession)
        rows, salts = self.table.select("part").mapInArrow(run, _SUMS), self.n_shards
        while salts > FAN_IN:
            salts = -(-salts // FAN_IN)
            salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
            rows = salted.repartition("key", "salt").sortWithinPartitions("salt", "key").select("key", "data").mapInArrow(level, _SUMS)
        done = rows.repartition("key").sortWithinPartitions("key").mapInArrow(last, _SUMS).toArrow()
        return {ast.literal_eval(r["key"]): pickle.loads(r["data"]) for r in done.to_pylist()}

    @property
    def block(self) -> int:
        """Terms of a block, so that the sums of one are BLOCK_BYTES // 8 bytes however many shards there are."""
        return BLOCK_BYTES // (8 * 40)


def build(post: DataFrame, docs: DataFrame, n_terms: int, targets: DataFrame | None = None, driver_postings: int | None = None) -> Shards:
    """The shards of (doc_id, term_id) postings and documents (doc_id, y, w): rows are dealt by a hash of their id.

    ``targets`` (doc_id, target) are other labels, numbered from 0. Postings of other documents don't count. A shard
    takes SHARD_POSTINGS postings or as many documents; if there are at most ``driver_postings`` the driver fetches them.
    """
    terms = post.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_set(F.col("term_id").cast("int")).alias("terms"))
    rows = docs.select("doc_id", F.col("y").cast("long").alias("y"), F.col("w").cast("long").alias("w")).join(terms, "doc_id", "left")
    n_targets = 0
    if targets is not None:
        rows = rows.join(targets.groupBy("doc_id").agg(F.collect_set(F.col("target").cast("int")).alias("targets")), "doc_id", "left")
        n_targets = (targets.agg(F.max("target")).first()[0] or 0) + 1
    rows = cut(rows.withColumn("key", F.xxhash64("doc_id")))
    size = rows.agg(F.sum(F.greatest(F.lit(1), F.size(F.coalesce("terms", F.array())))).alias("n")).first()["n"] or 0
    n_shards = max(1, -(-size // SHARD_POSTINGS))

    def pack(table: pa.Table) -> pa.Table:
        n = table.num_rows
        order = np.argsort(table["key"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))

        def matrix(name: str, width: int) -> Matrix:
            lists = table[name].combine_chunks()
            row = np.repeat(np.arange(n, dtype=np.int32), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            return Matrix.of(pc.list_flatten(lists).to_numpy(zero_copy_only=False), row, width, n)

        y, w, key = (table[c].to_numpy() for c in ("y", "w", "key"))
        part = Part(matrix("terms", n_terms), y, w, key, matrix("targets", n_targets) if n_targets else None)
        out = pa.table({"shard": table["shard"].slice(0, 1), "part": pa.array([part.dumps()], pa.binary())})
        del table, part
        release()
        return out

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(n_shards)))
    packed = cut(dealt.groupBy("shard").applyInArrow(pack, "shard long, part binary"))
    if size <= (DRIVER_POSTINGS if driver_postings is None else driver_postings):
        return Shards(n_terms, [Part.loads(r["part"]) for r in packed.orderBy("shard").collect()], None, n_shards)
    return Shards(n_terms, None, packed, n_shards)
