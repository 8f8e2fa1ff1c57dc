"""Postings as a table of compressed sets, one for each shard of rows and term, and counts of rules from it.

Documents are dealt to shards by a hash of their id and numbered in them. A rule is rated on the sets of its own terms,
shard by shard; what a task holds grows with those terms' postings in a shard, not with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boolsieve.functions.bitmaps import Bitmap, union
from boolsieve.functions.rules import Rule
from boolsieve.session import Shared, cut, literal, small

#: Rows of a shard, on average.
SHARD_ROWS = 1 << 18
#: Names of the sets of all rows, of labelled ones and of those of class 1; terms have a space before them.
ALL, LABELLED, POSITIVE = "all", "labelled", "positive"

_SETS = "shard long, name string, n long, rows binary"


def numbered_rows(docs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, shard, row): every different document once, numbered from 0 in its shard."""
    ids = cut(docs.select("doc_id").distinct())
    n = max(1, -(-ids.count() // shard_rows))
    dealt = ids.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(n)))
    return cut(dealt.withColumn("row", F.row_number().over(Window.partitionBy("shard").orderBy("doc_id")) - 1))


def bitmap_table(post: DataFrame, rows: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(shard, name, n, rows): the set of each term of (doc_id, term) and, of ``rows`` and labels (doc_id, y), those of all kinds."""
    sets = post.select("doc_id", F.concat(F.lit(" "), "term").alias("name"))
    sets = sets.unionByName(rows.select("doc_id", F.lit(ALL).alias("name")))
    if labels is not None:
        known = labels.filter("y is not null")
        sets = sets.unionByName(known.select("doc_id", F.lit(LABELLED).alias("name"))).unionByName(known.filter("y = 1").select("doc_id", F.lit(POSITIVE).alias("name")))
    lists = sets.join(rows, "doc_id").groupBy("shard", "name").agg(F.collect_list("row").alias("rows"))  # at most a shard's rows

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            ends, values = batch.column("rows").offsets.to_numpy(), batch.column("rows").values.to_numpy()
            for a, b in zip(ends, ends[1:]):
                made.append(Bitmap.of(np.unique(values[a:b])))
            counts = pa.array([len(m) for m in made], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("name"), counts, pa.array([m.dumps() for m in made], pa.binary())], ["shard", "name", "n", "rows"])

    return lists.mapInArrow(encode, _SETS)


def term_counts(table: DataFrame) -> DataFrame:
    """(term, df): documents of every term, summed over the shards."""
    return table.filter(F.startswith("name", F.lit(" "))).groupBy(F.substring("name", 2, 1 << 30).alias("term")).agg(F.sum("n").alias("df"))


class Sets:
    """The sets of one shard, and rules on them; unions of literals are made once."""

    def __init__(self, find: Callable[[object], Bitmap], every: Callable[[], Bitmap]) -> None:
        self.find, self.every, self._unions = find, every, {}

    def any_of(self, feats: tuple) -> Bitmap:
        if feats not in self._unions:
            self._unions[feats] = union(self.find(f) for f in feats)
        return self._unions[feats]

    def cover(self, r: Rule) -> Bitmap:
        """The rows that a rule fits: what its positive literals have in common, less its negative ones."""
        out: Bitmap | None = None
        for feats, pos in r:
            if pos:
                out = self.any_of(feats) if out is None else out & self.any_of(feats)
        out = self.every() if out is None else out
        for feats, pos in r:
            if not pos and out.blocks:
                out = out - self.any_of(feats)
        return out


def move_sums(hits: list[Bitmap], classes: tuple[Bitmap, ...], chosen: list[list[int]]) -> Iterator[np.ndarray]:
    """What all adds, removals and swaps of one rule change in each chosen set, by class.

    The first row of a set's array has, of each class, what no rule of the set covers of each rule, and what the set covers;
    the row of each of its rules has what that rule alone covers and of each rule, and in all.
    """
    n = len(hits)
    by_class = [[h & c for h in hits] for c in classes]
    sizes = [[len(h) for h in own] for own in by_class]
    for inside in chosen:
        any_, several = Bitmap({}), Bitmap({})
        for b in inside:
            several = several | (any_ & hits[b])
            any_ = any_ | hits[b]
        out = np.zeros((1 + len(inside), len(classes), n + 1), np.int64)
        for c in range(len(classes)):
            out[0, c, n] = any_.common(classes[c])
            out[0, c, :n] = [m - h.common(any_) for m, h in zip(sizes[c], by_class[c])]
            for k, b in enumerate(inside, 1):
                alone = by_class[c][b] - several
                out[k, c, n] = len(alone)
                out[k, c, :n] = [alone.common(h) for h in hits] if alone.blocks else 0
        yield out


def _by_shard(table: DataFrame, rules: list[Rule], step: Callable[[Sets, Bitmap, Bitmap], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that ``step`` gives of each shard's sets, labelled rows and rows of class 1."""
    terms = sorted({f" {f}" for r in rules for feats, _ in r for f in feats})
    wanted = literal(table.sparkSession, [(t,) for t in (ALL, LABELLED, POSITIVE, *terms)], "name string")
    own = table.join(small(wanted), "name", "left_semi").select("shard", "name", "rows")
    shared = Shared(table.sparkSession, step)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(shard: pa.Table) -> pa.Table:
        sets = {k: Bitmap.loads(v) for k, v in zip(shard["name"].to_pylist(), shard["rows"].to_pylist())}
        none = Bitmap({})
        rows = list(shared.value(Sets(lambda f: sets.get(f" {f}", none), lambda: sets.get(ALL, none)), sets.get(LABELLED, none), sets.get(POSITIVE, none)))
        return pa.table({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(names)})

    return own.groupBy("shard").applyInArrow(run, schema)


def rule_counts(table: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule_id, returned, tp): of each rule, by its place in the list, how many rows it fits and how many of class 1."""

    def step(sets: Sets, labelled: Bitmap, positive: Bitmap) -> Iterator[tuple]:
        for i, r in enumerate(rules):
            hit = sets.cover(r)
            yield i, len(hit), hit.common(positive)

    counted = _by_shard(table, rules, step, "rule_id long, returned long, tp long").groupBy("rule_id").agg(F.sum("returned").alias("returned"), F.sum("tp").alias("tp"))
    ids = literal(table.sparkSession, [(i,) for i in range(len(rules))], "rule_id long")
    return ids.join(counted, "rule_id", "left").fillna(0)


def move_counts(table: DataFrame, rules: list[Rule], chosen: list[int]) -> DataFrame:
    """(r_in, r_out, tp, returned): after each add, removal and swap of one rule of a chosen set, what the union covers.

    ``returned`` counts all rows, labelled or not; ``tp`` those of class 1.
    """
    outside = [r for r in range(len(rules)) if r not in chosen]
    moves = [(a, None) for a in outside] + [(None, b) for b in chosen] + [(a, b) for a in outside for b in chosen]

    def step(sets: Sets, labelled: Bitmap, positive: Bitmap) -> Iterator[tuple]:
        sums = next(move_sums([sets.cover(r) for r in rules], (positive, sets.every()), [list(chosen)]))
        n = len(rules)
        for i, (a, b) in enumerate(moves):
            k = None if b is None else 1 + chosen.index(b)
            tp, returned = (int(sums[0, c, n] + (sums[0, c, a] if a is not None else 0) - (sums[k, c, n] if k else 0) + (sums[k, c, a] if k and a is not None else 0)) for c in (0, 1))
            yield i, tp, returned

    counted = _by_shard(table, rules, step, "move long, tp long, returned long").groupBy("move").agg(F.sum("tp").alias("tp"), F.sum("returned").alias("returned"))
    named = literal(table.sparkSession, [(i, a, b) for i, (a, b) in enumerate(moves)], "move long, r_in long, r_out long")
    return named.join(counted, "move", "left").fillna(0, ["tp", "returned"]).drop("move")
