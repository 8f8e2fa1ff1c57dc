"""Session defaults."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Side tables of at most so many rows and bytes are broadcast by ``small``.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20
#: Rows and bytes of the batches that Python workers get, at most; a longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and ANSI mode; everything else is the cluster's."""
    builder = SparkSession.builder.appName("boolsieve").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.config(map=conf).getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """``df`` in the checkpoint folder that the cluster names, read back: lineage ends there and lost executors don't matter."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. One beside the warehouse stands in on a single machine; a cluster must name its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the driver's own rows that is part of the plan, so that its size is known without a job."""
    kind = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows)) or [()] * len(kind)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind), schema)


def _planned(df: DataFrame, rows: int) -> bool:
    """Whether a table is made of one ``literal`` of at most so many rows. Spark keeps only small ones in a plan."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return leaves.size() == 1 and leaves.head().nodeName() == "LocalRelation" and leaves.head().data().size() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and BROADCAST_BYTES bytes, else as it is, for a shuffled join.

    Counting costs a job but for literals, so this is for tables that are cheap to make: aggregates, checkpoints.
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if fits(df, rows) else df


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table may be broadcast, by its rows and the bytes of its columns: eight for a number, texts and arrays by their length."""
    from pyspark.sql import functions as F

    if _planned(df, rows):
        return True
    wide = [f for f in df.schema if f.dataType.typeName() in ("string", "binary", "array", "map", "struct")]
    size = F.lit(8 * len(df.schema))
    for f in wide:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        plain = kind == "array" and f.dataType.elementType.typeName() not in ("string", "binary", "array", "map", "struct")
        size = size + F.coalesce(F.octet_length(c) if kind in ("string", "binary") else F.size(c) * 8 if plain else F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    got = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(size.cast("long")).alias("b")).first()
    return got["n"] <= rows and (got["b"] or 0) <= BROADCAST_BYTES


def small_batches(spark: SparkSession) -> None:
    """The session's batches for Python are made smaller if they are larger than ours."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """Gives memory that this process has freed back to the system: workers are kept from task to task, and what they hold adds up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries lack it
        ctypes.CDLL(None).malloc_trim(0)


def forget(spark: SparkSession) -> None:
    """Lets the driver drop what finished steps left, so that Spark deletes their shuffle files and checkpoints: it does when their owners are collected."""
    gc.collect()
    release()
    spark.sparkContext._jvm.System.gc()


class Shared:
    """A broadcast of a value whose class Python workers can't import: it travels as bytes and is read once a task."""

    def __init__(self, spark: SparkSession, value: Any) -> None:
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value: Any = None

    def __getstate__(self) -> dict:
        return {"_bytes": self._bytes, "_value": None}

    @property
    def value(self) -> Any:
        if self._value is None:
            self._value = pickle.loads(self._bytes.value)
        return self._value
