"""Embeddings of texts by a model that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that a model gets at a time.
BATCH = 64


def embed(docs: DataFrame, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]], id_col: str = "doc_id", text_col: str = "text", batch: int = BATCH) -> DataFrame:
    """(doc_id, embedding) of length one. ``make_encoder`` runs once a task and gives a function from texts to rows of numbers.

    A null text is embedded as an empty one; a row of zeros stays zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for part in batches:
            for at in range(0, part.num_rows, batch):
                rows = part.slice(at, batch)
                v = np.asarray(encode([t or "" for t in rows.column("text").to_pylist()]), np.float32)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(list(v), pa.list_(pa.float32()))], ["doc_id", "embedding"])

    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id string, embedding array<float>")


def known_ids(vectors: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id): the ids that have an embedding."""
    return vectors.select(F.col(id_col).alias("doc_id")).distinct()


def hashed_words(size: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """An encoder without a model: words hashed to signed places. For tests and as a baseline."""

    def make() -> Callable[[list[str]], np.ndarray]:
        import zlib

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), size), np.float32)
            for row, text in zip(out, texts):
                for w in text.lower().split():
                    h = zlib.crc32(w.encode())
                    row[h % size] += 1 if h >> 16 & 1 else -1
            return out

        return encode

    return make
