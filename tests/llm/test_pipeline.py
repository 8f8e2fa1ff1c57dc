import numpy as np

import corpus_pipeline
from boolsieve.llm import decontaminate, mixing, toxicity
from boolsieve.llm.queries import QUERIES
from test_simhash import shingles, slow_groups, slow_print
from test_text_scans import slow_marks


def stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], sf).write.parquet(str(tmp_path / name))
        out.append(spark.read.parquet(str(tmp_path / name)))
    return out


def test_stages_against_plain_python(spark, sf, tmp_path):
    docs, good, clean, single, cut, mixed = stages(spark, sf, tmp_path)
    for df in (good, clean, single, cut):
        assert df.columns == docs.columns
    kept = {r.doc_id for r in QUERIES["op7_quality"](spark, sf).filter("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept
    scores = toxicity.score(good, spark.read.parquet(f"{sf}/labels.parquet"))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in scores.filter("predicted = 0").collect()}
    rows = clean.collect()
    staying = {r.doc_id for r in single.collect()}
    assert staying <= {h for _, _, h in slow_groups([(r.doc_id, slow_print(r.text)) for r in rows])}
    sets = {r.doc_id: shingles(r.text) for r in rows}
    for i, s in sets.items():
        most = max((len(s & t) / len(s | t) for j, t in sets.items() if j < i), default=0.0)
        assert i in staying if most < 0.6 else i not in staying or most < 0.8
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in single.collect()}
    after = {r.doc_id: r for r in cut.collect()}
    assert set(after) == set(before)
    changed = 0
    for i, text in list(before.items())[:60]:
        n, hit, _ = slow_marks(text, items, decontaminate.WINDOW)
        changed += any(hit)
        if not any(hit):
            assert after[i].text == text
        else:
            assert slow_marks(after[i].text, [], 10)[0] == n - sum(hit) and after[i].n_chars == len(after[i].text)
    n = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(n) <= set(after) and {r.text for r in mixed.collect()} <= {r.text for r in after.values()}
    share = mixed.count() / (mixing.SIZE * len(after))
    assert abs(share - 1) < 5 / np.sqrt(len(after))


def test_run_gives_the_last_stage(spark, sf):
    assert {"copy", "rate", "shuffle_key"} <= set(corpus_pipeline.run(spark, sf).columns)


def test_odd_and_empty_documents(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert set(docs.columns) <= set(out.columns) and out.count() >= 0
