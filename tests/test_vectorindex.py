"""The vector index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from boolsieve.catalog import QUERIES
from boolsieve.operators import ranking, vectorindex
from boolsieve.session import cut


def clustered(spark, n=4000, dims=30, text_ids=False):
    """Rows around 40 centres, a third of them copies of one row."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(40, dims))[rng.integers(0, 40, n)] + rng.normal(size=(n, dims)) * 0.35
    v[: n // 3] = v[0]
    name = (lambda i: f"v{i:05d}") if text_ids else int
    return cut(spark.createDataFrame([(name(i), r.astype(float).tolist()) for i, r in enumerate(v)], f"vec_id {'string' if text_ids else 'long'}, embedding array<double>"))


def asked(vectors, where):
    return vectors.filter(where).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("text_ids", [False, True])
def test_all_cells_and_rows_are_exact_search(spark, text_ids):
    vectors = clustered(spark, 700, text_ids=text_ids)
    queries = asked(vectors, "vec_id IN ('v00000', 'v00300', 'v00699')" if text_ids else "vec_id IN (0, 300, 699)")
    index = vectorindex.build(vectors)
    got = vectorindex.search(index, vectors, queries, 7, vectorindex.Setting(len(index.cells), 700, 1.0))
    assert rows(got) == rows(ranking.search(vectors, queries, 7)) and got.count() == 21


def test_calibrated_recall_looks_into_few_cells(spark, monkeypatch):
    monkeypatch.setattr(vectorindex, "ROWS_PER_TASK", 300)  # the copies' cell is several tasks, and ids leave memory
    vectors = clustered(spark)
    queries = asked(vectors, "vec_id % 20 = 0 AND vec_id >= 1334")
    index = vectorindex.build(vectors)
    assert index.codes.count() == 4000 and index.codes.filter("part > 0").count() > 0
    setting = vectorindex.calibrate(index, vectors.filter("vec_id >= 1334"), 10, 0.95)
    got = vectorindex.search(index, vectors, queries, 10, setting).select("query_id", "doc_id")
    true = ranking.search(vectors, queries, 10).select("query_id", "doc_id")
    recall = true.join(got, ["query_id", "doc_id"]).count() / true.count()
    print(setting, len(index.cells), recall)
    assert recall >= 0.9 and setting.probes <= len(index.cells) / 3 and setting.wanted <= 400


@pytest.mark.parametrize("name", ["sf0.01", "sf0.1"])
def test_recall_on_the_test_tables(spark, sf, name):
    got = QUERIES["vector_index_recall"](spark, sf.replace("sf0.001", name)).agg(F.sum("found").alias("f"), F.sum("nearest").alias("n"), F.count("*").alias("q")).first()
    print(got)
    assert got.f >= 0.9 * got.n and got.n == 10 * got.q


def test_odd_vectors(spark):
    data = [(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [0.0, 0.0]), (8, [1.0, 0.1]), (8, [1.0, 0.1])]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    index = vectorindex.build(vectors)
    assert sorted(r.doc_id for r in index.codes.collect()) == [1, 7, 8, 8]
    got = vectorindex.search(index, vectors.dropDuplicates(["vec_id"]), asked(vectors, "vec_id IN (1, 2, 4)"), 2, vectorindex.Setting(9, 9, 1.0))
    assert {r.query_id for r in got.collect()} == {1} and {r.doc_id for r in got.collect()} <= {7, 8}
    with pytest.raises(ValueError):
        vectorindex.build(vectors.union(spark.createDataFrame([(9, [1.0])], vectors.schema)))


def test_empty(spark):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    index = vectorindex.build(vectors)
    setting = vectorindex.calibrate(index, vectors, 10)
    assert vectorindex.search(index, vectors, asked(vectors, "true"), 10, setting).collect() == []
