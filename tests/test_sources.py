import gzip
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from boolsieve.operators import ablation
from boolsieve.sources import files, patents, search


def test_jsonl_is_tolerant(spark, tmp_path):
    lines = ['{"pmid": "1", "title": "t", "abstract": "a", "mesh_terms": ["x", "y"]}\0\0', "", "not json", '{"pmid": "2"}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    rows = files.read_articles(spark, str(tmp_path))
    assert {r.pmid for r in rows.collect()} == {"1", "2"}
    assert {(r.heading, r.pmid) for r in files.heading_index(rows).collect()} == {("x", "1"), ("y", "1")}
    assert files.read_articles(spark, str(tmp_path), 1).count() == 1
    assert files.sample_articles(spark, str(tmp_path), 1, 5).count() == 1


def test_medline_and_descriptors(spark, tmp_path):
    xml = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">7</PMID><Article><ArticleTitle>T</ArticleTitle>
    <Abstract><AbstractText Label="A">first</AbstractText><AbstractText>second</AbstractText></Abstract></Article>
    <MeshHeadingList><MeshHeading><DescriptorName UI="D1">Asthma</DescriptorName></MeshHeading><MeshHeading><DescriptorName UI="D2">Lung</DescriptorName></MeshHeading></MeshHeadingList>
    </MedlineCitation></PubmedArticle><PubmedArticle><MedlineCitation><PMID Version="1">8</PMID><Article><ArticleTitle>U</ArticleTitle></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"""
    with gzip.open(tmp_path / "a.xml.gz", "wt") as f:
        f.write(xml)
    rows = {r.pmid: r for r in files.medline(spark, str(tmp_path / "a.xml.gz")).collect()}
    assert (rows["7"].title, rows["7"].abstract, rows["7"].mesh_terms) == ("T", "first", ["Asthma", "Lung"])
    assert rows["8"].abstract is None and rows["8"].mesh_terms == []
    mesh = """<DescriptorRecordSet><DescriptorRecord><DescriptorUI>D1</DescriptorUI><DescriptorName><String>Asthma</String></DescriptorName>
    <TreeNumberList><TreeNumber>C08.127</TreeNumber><TreeNumber>C08</TreeNumber></TreeNumberList><ConceptList><Concept><ConceptName><String>Asthma</String></ConceptName><ScopeNote> A note. </ScopeNote>
    <TermList><Term><String>Asthma</String></Term><Term><String>Bronchial Asthma</String></Term></TermList></Concept></ConceptList></DescriptorRecord></DescriptorRecordSet>"""
    (tmp_path / "mesh.xml").write_text(mesh)
    d = files.descriptors(spark, str(tmp_path / "mesh.xml")).first()
    assert (d.ui, d.name, d.tree_numbers, d.scope_note) == ("D1", "asthma", ["C08.127", "C08"], "A note.")
    assert d.concepts[0].terms == ["Asthma", "Bronchial Asthma"]


def test_qrels_topics_and_columns(spark, tmp_path):
    (tmp_path / "q.txt").write_text("CD1 0 11 1\nCD1 0 12 0\nbad line\nCD2  0  13  1\n")
    assert {tuple(r) for r in files.qrels(spark, str(tmp_path / "q.txt")).collect()} == {("CD1", "11", 1), ("CD1", "12", 0), ("CD2", "13", 1)}
    assert {r.query_id for r in files.first_column(spark, str(tmp_path / "q.txt")).collect()} == {"CD1", "CD2", "bad"}
    topics = tmp_path / "topics"
    topics.mkdir()
    (topics / "CD1.topic").write_text("Topic: CD1\n\nTitle: a long title\n\nQuery:\nx\n")
    assert files.topics(spark, str(topics)).first().asDict() == {"query_id": "CD1", "title": "a long title"}
    assert files.file_stems(spark, str(topics)).first().stem == "CD1"


def test_maps_rankings_and_examples(spark, tmp_path):
    (tmp_path / "syn.json").write_text(json.dumps({"a": ["a", "as"], "b": []}))
    assert {r.lemma: r.forms for r in files.synonym_map(spark, str(tmp_path / "syn.json")).collect()} == {"a": ["a", "as"], "b": []}
    (tmp_path / "details.json").write_text(json.dumps({"CD1": {"title": "t", "positives": ["1", "2", "2"], "search_strategy": {"pubmed": "x"}}}))
    d = files.dataset_details(spark, str(tmp_path / "details.json")).first()
    assert (d.query_id, d.num_positives, d.search_strategy) == ("CD1", 2, {"pubmed": "x"})
    rows = spark.createDataFrame([("CD1", "1", 1), ("CD1", "2", 0), ("CD1", "1", 1)], "query_id string, doc_id string, label int")
    assert files.build_details(rows).first().asDict() == {"query_id": "CD1", "positives": ["1"], "num_positives": 1}
    ranking = spark.createDataFrame([("CD1", 0, "1", 0.9), ("CD2", 0, "5", 0.8)], files.RANKING)
    files.write_rankings(ranking, str(tmp_path / "rankings"))
    assert [r.doc_id for r in files.read_ranking(spark, str(tmp_path / "rankings"), "CD2").collect()] == ["5"]
    assert files.read_ranking(spark, str(tmp_path / "rankings"), "CD3").count() == 0
    (tmp_path / "ex.json").write_text(json.dumps({"p": {"title": "t", "name": "n", "examples": [{"query_id": "CD1", "query": "a OR b"}]}}))
    assert files.examples(spark, str(tmp_path / "ex.json"), "p").first().query == "a OR b"


def result(query_id, positives=60, **more):
    return json.dumps({"query_id": query_id, "num_positive": positives, "pubmed_precision": 0.5, "pubmed_recall": 0.4, "pubmed_query": "(a OR b) NOT c", **more})


def test_results(spark, tmp_path):
    from boolsieve.plans import reports

    size = {"paths": 1, "avg_path_len": 2.0, "ANDs": 0, "NOTs": 1, "added_ORs": 1, "synonym_ORs": 0, "ORs": 0}
    run = tmp_path / "beta" / "n3" / "ktype=cosine,x=1"
    run.mkdir(parents=True)
    (run / "qg_results.jsonl").write_text("\n".join([result("CD1", query_size=size), "", result("CD1", 99, query_size=size), result("CD2", 10, query_size=size) + "\0"]))
    (run / "qg_meta_data.json").write_text(json.dumps({"betas": {"3.0": 1, "50": 2}}))
    rows = files.read_results(spark, str(tmp_path))
    got = {r.query_id: r for r in rows.collect()}
    assert got["CD1"].num_positive == 60 and (got["CD1"].trial, got["CD1"].k_type) == (3, "cosine")
    assert set(files.read_results(spark, str(tmp_path), min_positive=50).toPandas()["query_id"]) == {"CD1"}
    assert files.read_results(spark, str(tmp_path), betas=[3.0, 50.0]).count() == 2
    assert files.read_results(spark, str(tmp_path), betas=[15.0]).count() == 0
    assert files.read_results(spark, str(tmp_path), k_types=["fixed"]).count() == 0
    assert files.run_means(rows, ["pubmed_recall"]).first()["pubmed_recall_mean"] == 0.4
    with pytest.raises(Exception, match="cutoff"):
        spark.createDataFrame([("a/b",)], "p string").select(files.k_type(F.col("p"), strict=True)).collect()
    table = {r.query_id: r for r in reports.derived(rows).collect()}
    assert table["CD1"].logical_operators == 2 and table["CD1"].num_positive_bucket == ">=50" and round(table["CD1"].f1, 6) == 0.444444
    assert "**" in reports.markup_table(rows.select("query_id", "num_positive"), ["query_id", "num_positive"], {"num_positive": "max"})
    wrong = spark.createDataFrame(rows.rdd.map(lambda r: r), rows.schema).withColumn("pubmed_query", F.lit("a"))
    with pytest.raises(Exception, match="size"):
        reports.derived(wrong).collect()


def test_names_and_upserts(spark):
    assert files.plain_values({"true": ["false", {"a": "null"}]}) == {True: [False, {"a": None}]}
    assert files.abbreviate({"max_depth": 4, "tiab": True, "min_df": 0.5}) == "md=4,md=0.5,t=T"
    assert files.params_digest({"a": 1, "b": 2}) == files.params_digest({"b": 2, "a": 1})
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, v int, t string")
    new = spark.createDataFrame([("a", 2, "z"), ("c", 1, "w")], "id string, v int, t string")
    assert {r.id: r.t for r in files.upsert(old, new, "id", "v").collect()} == {"a": "z", "b": "y", "c": "w"}
    with pytest.raises(Exception, match="no id"):
        files.upsert(None, spark.createDataFrame([(None, 1)], "id string, v int"), "id", "v").collect()


EXCHANGE = """<?xml version="1.0"?><!DOCTYPE x SYSTEM "a.dtd"><exch:exchange-documents xmlns:exch="http://x"><exch:exchange-document country="EP" doc-number="123" kind="A1" date-publ="20200101" family-id="9">
<exch:bibliographic-data><exch:classifications-ipcr><classification-ipcr sequence="1"><text>A61K  31/00        20060101AFI</text></classification-ipcr><classification-ipcr sequence="2"><text>none</text></classification-ipcr></exch:classifications-ipcr>
<exch:patent-classifications><patent-classification><classification-symbol>A61K 31/01</classification-symbol><classification-value>I</classification-value></patent-classification></exch:patent-classifications>
<exch:parties><exch:applicants><exch:applicant sequence="1"><exch:applicant-name><name>ACME &acme;</name></exch:applicant-name><addressbook><address><street>S 1</street><city>B</city></address></addressbook></exch:applicant>
<exch:applicant sequence="2"><exch:applicant-name><name> </name></exch:applicant-name></exch:applicant></exch:applicants></exch:parties>
<exch:invention-title lang="en">A title</exch:invention-title></exch:bibliographic-data><exch:abstract lang="en"><exch:p>One.</exch:p><exch:p>Two.</exch:p></exch:abstract><exch:abstract lang="fr"></exch:abstract></exch:exchange-document></exch:exchange-documents>"""
EP = """<ep-patent-document id="EP1" country="EP" doc-number="1" kind="B1" date-publ="20200202" lang="en"><SDOBI><B500><B540><B541>de</B541><B542>Titel</B542><B541>en</B541><B542>Title</B542><B541>fr</B541></B540></B500>
<B700><B720><B721><snm>Doe</snm><adr><str>S</str><city>C</city><ctry>DE</ctry></adr></B721></B720></B700><B800><B840><ctry>AT</ctry><ctry>BE</ctry></B840></B800></SDOBI>
<claims lang="en"><claim num="0001"><claim-text>A thing.</claim-text></claim></claims></ep-patent-document>"""


def test_patents(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("doc.xml", EP)
    with zipfile.ZipFile(tmp_path / "root.zip", "w") as z:
        z.writestr("DOC/a.xml", EXCHANGE)
        z.writestr("DOC/toc.xml", "<toc/>")
        z.writestr("DTD/a.dtd", '<!ENTITY acme "Corp">')
        z.writestr("DOC/inner.zip", inner.getvalue())
        z.writestr("DOC/broken.xml", "<a>")
    docs = {r.id: r for r in patents.documents(patents.archives(spark, str(tmp_path))).withColumn("full", patents.full_text()).collect()}
    assert set(docs) == {"EP-123-A1", "EP1"}
    a, e = docs["EP-123-A1"], docs["EP1"]
    assert [(x.symbol, x.version, x.is_primary) for x in a.ipc] == [("A61K 31/00", "20060101", True)]
    assert [(x.symbol, x.is_inventive) for x in a.cpc] == [("A61K 31/01", True)]
    assert [(p.name, p.address) for p in a.applicants] == [("ACME Corp", "S 1, B")]
    assert [(x.lang, x.text) for x in a.abstracts] == [("en", "One. Two.")]
    assert [(x.lang, x.text) for x in e.titles] == [("de", "Titel"), ("en", "Title")]
    assert [c.text for c in e.claims] == ["A thing."] and e.states == ["AT", "BE"] and e.inventors[0].address == "S, C"
    assert a.full.startswith("EP-123-A1 9 A title One. Two.")
    claims = patents.documents(patents.archives(spark, str(tmp_path))).filter("id = 'EP1'")
    assert [tuple(c) for c in claims.select(patents.matching_claims(["THING", "a"]).alias("c")).first().c] == [("0001", "*A* *thing*.")]
    assert claims.select(patents.matching_claims(["thin"]).alias("c")).first().c == []


ROWS = [(i, i % 40, {"a", "b"} if i % 3 else {"b"}) for i in range(500)]


def local_client():
    return search.LocalClient(ROWS)


def test_search_source(spark):
    spark.dataSource.register(search.SearchSource)
    read = spark.read.format("search").option("client", "test_sources:local_client").option("query", "b NOT a").option("to", 60).option("window_limit", 50)
    rows = read.load()
    want = sorted(str(i) for i, _, t in ROWS if "a" not in t)
    assert sorted(r.doc_id for r in rows.collect()) == want
    assert rows.rdd.getNumPartitions() > 1
    with pytest.raises(Exception, match="hits"):
        read.option("max_retrieved", 10).load().collect()


def test_windows_cover_all_days():
    client = local_client()
    windows = search.plan(lambda a, b: client.count("b", a, b), 0, 60, most=50, target=40, width=10)
    assert sum(client.count("b", a, b) for a, b in windows) == 500
    assert all(client.count("b", a, b) < 50 or a == b for a, b in windows)
    counts = [(d, 13) for d in range(40)]
    plan = ablation.date_windows(counts, 40, 50, 10)
    assert sum(n for _, _, n in plan) == 520 and all(n < 50 for _, _, n in plan)
    assert ablation.date_windows([], 1, 1) == []


def test_retries():
    calls = []

    def fails_twice():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert search.retried(fails_twice, first_wait=0) == "ok"
    with pytest.raises(OSError):
        search.retried(lambda: (_ for _ in ()).throw(OSError()), tries=2, first_wait=0)


def test_resume(spark, tmp_path):
    from boolsieve.streaming.resume import process_new

    src = tmp_path / "src"
    src.mkdir()
    (src / "a.json").write_text('{"id": 1}\n')
    run = lambda: process_new(spark, str(src), "id long", str(tmp_path / "done"), str(tmp_path / "cp"), lambda d: d.withColumn("sq", F.col("id") * F.col("id")))
    run()
    (src / "b.json").write_text('{"id": 3}\n')
    run()
    run()
    assert sorted(r.sq for r in spark.read.parquet(str(tmp_path / "done")).collect()) == [1, 9]


def test_manifest(spark):
    rows = spark.createDataFrame([([(1, [("a.zip", "http://x/a.zip", "ff")]), (2, [("b.zip", "http://x/b.zip", "ee")])],)], "items array<struct<id:int,files:array<struct<name:string,url:string,checksum:string>>>>")
    assert [r.value for r in files.manifest(rows, [2]).collect()] == ["http://x/b.zip\n  out=b.zip\n  checksum=sha-1=ee"]


class RecordClient:
    def records(self, ids):
        return [{"doc_id": i, "title": f"t{i}"} for i in ids]


def test_records_come_in_batches(spark):
    ids = spark.range(450).selectExpr("string(id) doc_id")
    rows = search.fetch(ids, "test_sources:RecordClient", "doc_id string, title string, abstract string", 100).collect()
    assert len(rows) == 450 and all(r.title == f"t{r.doc_id}" and r.abstract is None for r in rows)


def test_query_entries(spark):
    from boolsieve.plans import reports

    rows = spark.createDataFrame([("(a OR b) AND c",), ("bad (",), (None,)], "pubmed_query string")
    got = {r.pubmed_query: (r.terms, r.nested) for r in reports.query_entries(rows).collect()}
    assert got["(a OR b) AND c"] == (["a", "b", "c"], [[["a", "b"], ["c"]]]) and got["bad ("] == (None, None) and got[None] == (None, None)


@pytest.mark.parametrize("name", ["patent_archives", "patent_texts"])
def test_partitions_of_several_archives(spark, sf, name):
    """A partition of more rows than a batch has several archives."""
    from boolsieve.catalog import ORACLE_SQL, QUERIES
    from oracle import compare

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        compare(QUERIES[name](spark, sf.replace("sf0.001", "sf0.01")), ORACLE_SQL[name], sf.replace("sf0.001", "sf0.01"))
    finally:
        spark.conf.set(key, old)
