"""A hash tree over a table: a manifest with a digest and a proof for every row, collapsed in blocks by SQL functions.

The rows of a language are ordered and numbered by ranges; each run of BLOCK rows is one array, whose levels are made by
``aggregate`` over ``sequence``, ``transform`` and ``slice``. What a block comes to is a node of the next round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boolsieve.session import cut, small

#: Levels that a block collapses at once, and its rows.
LEVELS = 8
BLOCK = 1 << LEVELS

#: All levels of a run of digests, the digests first: ``up`` levels, of pairs or a last single node.
_ROWS_OF = "transform(sequence(0, (size({0}) + 1) DIV 2 - 1), i -> sha2(concat_ws('', slice({0}, CAST(2 * i + 1 AS INT), 2)), 256))"
_LEVELS = f"""aggregate(slice(sequence(1, {LEVELS}), 1, up), CAST(array(run.digest) AS ARRAY<ARRAY<STRING>>),
  (made, l) -> CAST(concat(made, array({_ROWS_OF.format("element_at(made, -1)")})) AS ARRAY<ARRAY<STRING>>))"""
#: For each node of a run, what stands beside it on each level (null: nothing), and whether the node is the right one.
_BESIDE = f"""transform(sequence(0, size(run) - 1), i -> struct(run[i] AS node, transform(slice(sequence(1, {LEVELS}), 1, up), l -> struct(
  get(levels[l - 1], shiftright(i, l - 1) ^ 1) AS digest, shiftright(i, l - 1) & 1 = 1 AS right)) AS beside))"""


def field(value: Column) -> Column:
    """A value with its length in bytes before it, or ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row."""
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def numbered(nodes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``nodes`` in the checkpoint folder with ``at``, the place within the key from 0, and ``n``, the key's rows.

    Ranges of keys and order are sorted by themselves; each then needs only the number of rows before it. A hot key is
    many ranges.
    """
    sorted_ = nodes.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    ranged = cut(sorted_.withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))
    sizes = ranged.groupBy(key, "_part").agg(F.count("*").alias("_size"), F.min("_id").alias("_from"))
    parts = Window.partitionBy(key)
    before = F.coalesce(F.sum("_size").over(parts.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut(sizes.select(key, "_part", "_from", before.alias("_before"), F.sum("_size").over(parts).alias("n")))  # a row for each range and key
    at = F.col("_id") - F.col("_from") + F.col("_before")
    return ranged.join(small(starts), [key, "_part"]).select(*nodes.columns, at.alias("at"), "n")


def collapse(nodes: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Of nodes (key, at, n, digest and others) what they give with ``beside`` on all levels, and (key, root): each key's last node.

    A round makes one array of each BLOCK nodes and as many rows as there are blocks for the next, until each key is one.
    """
    payload = [c for c in nodes.columns if c not in (key, "at", "n")]
    up = F.when(F.col("n") > 1, F.least(F.lit(LEVELS), F.length(F.bin(F.col("n") - 1)))).otherwise(0)  # the bits of n - 1
    runs = nodes.groupBy(key, F.floor(F.col("at") / BLOCK).alias("block"), "n").agg(F.array_sort(F.collect_list(F.struct("at", *payload))).alias("run"))
    blocks = cut(runs.withColumn("up", up).withColumn("levels", F.expr(_LEVELS)).withColumn("top", F.expr("element_at(levels, -1)[0]")))
    widest = blocks.agg(F.max("n")).first()[0] or 0
    if widest <= BLOCK:
        above, roots = blocks.withColumn("above", F.expr("CAST(array() AS ARRAY<STRUCT<digest: STRING, right: BOOLEAN>>)")), blocks.select(key, F.col("top").alias("root"))
    else:
        next_ = blocks.select(key, F.col("block").alias("at"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("digest"))
        higher, roots = collapse(next_, key)
        above = blocks.join(higher.select(key, F.col("at").alias("block"), F.col("beside").alias("above")), [key, "block"])
    each = above.select(key, "above", F.explode(F.expr(_BESIDE)).alias("x"))
    return each.select(key, *[F.col(f"x.node.{c}").alias(c) for c in ("at", *payload)], F.concat("x.beside", "above").alias("beside")), roots


def fold(start: Column, beside: Column) -> Column:
    """The root that a leaf and what stands beside its way give."""
    both = lambda h, x: F.when(x["digest"].isNull(), h).when(x["right"], F.concat(x["digest"], h)).otherwise(F.concat(h, x["digest"]))
    return F.aggregate(beside, start, lambda h, x: F.sha2(both(h, x).cast("binary"), 256))


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", lang_col: str = "lang", number_col: str = "n_chars", divisor: int = 7) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row.

    A leaf is made of ``columns``, nulls marked; ids of any type that has an order and a text. Leaves of a language go by
    id, a null id first, then by digest; repeated rows are leaves of their own; a null language is a group. ``folded_root``
    is made from the row's leaf, after one was added to ``number_col`` where ``divisor`` divides the CRC-32 of the id (a
    null id has none, a null number stays), and its proof. An empty table gives an empty result. Other columns are not
    read, and texts go no further than their digest. All paths of a block come from its own array and its block's path.
    """
    values = {c: F.col(f"`{c}`") for c in {*columns, id_col, lang_col, number_col}}
    changed = values | {number_col: values[number_col].cast("decimal(38,0)") + 1}
    tampered = F.coalesce(F.crc32(values[id_col].cast("string").cast("binary")) % divisor == 0, F.lit(False)) & values[number_col].isNotNull()
    key = F.coalesce(F.concat(F.lit("1"), values[lang_col].cast("string")), F.lit("0"))  # null first, then by bytes
    rows = docs.select(
        key.alias("key"), values[id_col].alias("id"), leaf(*[values[c] for c in columns]).alias("digest"), F.when(tampered, leaf(*[changed[c] for c in columns])).alias("other"), F.monotonically_increasing_id().alias("tie"),
    )
    leaves, subroots = collapse(numbered(cut(rows), "key", ["id", "digest", "tie"]))
    langs, root = collapse(numbered(subroots.select(F.lit("").alias("all"), "key", F.col("root").alias("digest")), "all", ["key"]), "all")
    tops = langs.join(F.broadcast(root), "all").select("key", F.col("digest").alias("subroot"), F.col("beside").alias("over"), "root")  # one root
    whole = leaves.join(small(cut(tops)), "key").withColumn("path", F.concat("beside", "over"))
    proof = F.sha2(F.concat_ws("", F.col("path.digest")).cast("binary"), 256)
    out = whole.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), fold(F.coalesce("other", "digest"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
