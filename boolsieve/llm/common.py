"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from boolsieve.session import release, small_batches

#: Text that one step of a Python operator holds at a time, in bytes; a longer text is a step of its own.
STEP_BYTES = 2 << 20

_UPPER = {c: c + 32 for c in range(65, 91)}
#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
ALNUM_TABLE = bytes(_UPPER.get(c, c) if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))

#: The same words as a class of Java, RE2 and Python regular expressions, for text whose case is still mixed.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name in the folder. The session's batches for Python are made smaller if they are larger than ours."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns of these names in any case: an operator's own columns replace an input's."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])


def free(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores behind it as it takes to be no column of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches between rows so that the texts of a piece take ``limit`` bytes, or are a single row."""
    for batch in batches:
        release()
        ends = offsets(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
    release()


def offsets(column: pa.Array) -> np.ndarray:
    """Start of each value of a string or binary array in its data, and the end of the last."""
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def utf8(column: pa.Array) -> list[bytes]:
    """The values as UTF-8; a null is empty."""
    data = column.buffers()[2]
    data = b"" if data is None else data
    at = offsets(column).tolist()
    view = memoryview(data)
    texts = [bytes(view[a:b]) for a, b in zip(at, at[1:])]
    if column.null_count:
        texts = [t if ok else b"" for t, ok in zip(texts, column.is_valid().to_pylist())]
    return texts


def words(text: bytes) -> list[bytes]:
    """Runs of letters, digits and bytes above ASCII, A-Z lower-cased."""
    return text.translate(ALNUM_TABLE).split()
