import pickle

import numpy as np
import pyarrow as pa

from boolsieve.plans import shards as sh


def test_a_batch_is_given_back_before_the_next_one():
    base, held = pa.total_allocated_bytes(), []

    def batches():
        for k in range(4):
            held.append(pa.total_allocated_bytes() - base)
            yield pa.RecordBatch.from_pydict({"key": ["k"], "data": pa.array([pickle.dumps(np.full(1 << 18, k))], pa.binary())})

    assert [(key, int(v[0])) for key, v in sh._read(batches())] == [("k", k) for k in range(4)]
    assert max(held) < 1 << 20  # a batch is twice that


def test_sums_over_shards_ask_for_small_batches(spark):
    docs = spark.range(40).selectExpr("id as doc_id", "cast(id % 2 as int) as y", "100 as w")
    post = spark.range(40).selectExpr("id as doc_id", "cast(id % 7 as int) as term_id").filter("doc_id <> 3")
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
        held = sh.build(post, docs, 7, driver_postings=0)
        got = held.total(lambda part: [((0,), np.bincount(part.x.term, minlength=7))])[0,]
        assert got.tolist() == [sum(i % 7 == t and i != 3 for i in range(40)) for t in range(7)]
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
