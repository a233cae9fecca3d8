"""A collection from ingest to answers, the older surfaces, and queries on the smallest data."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathom.operators import dense, fusion, lexical, router
from fathom.plans import agent, catalog, contextual, evaluation, providers
from fathom.plans.engine import Engine, EngineConfig, Tools, tools_of
from fathom.sources import collection, tables
from fathom.sources.collection import Collection, Overtaken
from fathom.streaming.ingest import ingest_stream

SF = "/root/testdata/sf0.001"
PAGES = "doc_id string, filename string, page int, text string"
ROWS = [("d1", "one.pdf", 1, "alpha beta gamma. " * 400), ("d1", "one.pdf", 2, "delta epsilon zeta"), ("d2", "two.pdf", 1, "revenue of the database grew"), ("d3", "x.pdf", 1, "  \n")]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return "file://" + str(tmp_path_factory.mktemp("collections"))


@pytest.fixture(scope="module")
def tools(spark, root):
    t = Tools(spark, root)
    assert t.engine("Test").ingest_pages(spark.createDataFrame(ROWS, PAGES), {"k": "v"}) == {"status": "success", "documents": 2, "parent_chunks_indexed": 4, "child_chunks_indexed": 10}
    return t


def test_tools(tools, spark, root):
    engine = tools.engine("Test")
    top = engine.search("database revenue", 2).orderBy("rank").first()
    assert (top.doc_id, top.tier) == ("d2", "direct")
    got = json.loads(tools.rag_ask("database revenue", "Test"))
    assert got["answer"] and got["sources"][0]["index"] == 1 and got["router_tier"] == "direct"
    found = json.loads(tools.rag_search("delta epsilon", "Test", 1))
    assert found["results_count"] == 1 and set(found["results"][0]) == {"parent_id", "doc_id", "filename", "score", "page_start", "page_end", "content"}
    assert found["results"][0]["doc_id"] == "d1" and found["results"][0]["page_start"] == 2
    assert set(json.loads(tools.rag_route_query("of the", "Test"))) == {"query", "tier", "specificity_score", "score_margin", "entropy", "reason", "expanded_queries", "hypothetical_doc"}
    bad = json.loads(tools.rag_ingest_pdf("/nowhere/x.pdf", "Test"))
    assert bad == {"status": "error", "message": "no file /nowhere/x.pdf"}
    assert tools.engine("Test") is engine and tools_of(spark, root) is tools_of(spark, root)
    assert json.loads(tools.rag_ask("anything", "Nothing"))["answer"].startswith("No relevant documents")


def test_queries_are_embedded_once(tools, monkeypatch):
    engine = tools.engine("Test")
    asked = []
    plain = engine._embedded
    monkeypatch.setattr(engine, "_embedded", lambda df, text: asked.append(text) or plain(df, text))
    engine._queries("never asked before")
    engine.route(["never asked before", "never asked before"]).collect()
    assert asked == ["query"]
    monkeypatch.setattr(engine, "config", EngineConfig(cached_queries=1))
    engine._queries(["one", "two"])
    assert list(engine._vectors) == ["two"]


@pytest.mark.parametrize("tier", ["direct", "hyde", "multi_query"])
def test_tiers(tools, spark, tier, monkeypatch):
    engine = tools.engine("Test")
    settled = {"direct": router.Thresholds(specificity=0.0), "hyde": router.Thresholds(9, 9, -1.0), "multi_query": router.Thresholds(9, 9, 9)}[tier]
    monkeypatch.setattr(engine, "config", EngineConfig(thresholds=settled))
    decided = engine.route("grown database revenue")
    d = decided.first()
    assert d.tier == tier and (d.hypothetical_doc is not None) == (tier == "hyde") and len(d.expanded_queries) == (3 if tier == "multi_query" else 0)
    assert d.reason.startswith({"direct": "High query", "hyde": "High retrieval", "multi_query": "Moderate"}[tier])
    assert engine.search_routed(decided, 1).first().doc_id == "d2"
    if tier != "direct":  # a tier without its text finds nothing, unless direct search stands in
        empty = decided.withColumn("hypothetical_doc", F.lit("")).withColumn("expanded_queries", F.array().cast("array<string>"))
        assert engine.search_routed(empty, 1).count() == 0
        monkeypatch.setattr(engine, "config", EngineConfig(thresholds=settled, fallback_direct=True))
        assert engine.search_routed(empty, 1).first().doc_id == "d2"


class Broken:
    """A reranker that fails on every batch with a certain word."""

    @staticmethod
    def made(load=lambda: "bakery"):
        def apply(word, queries, contents):
            if queries.str.contains(word).any():
                raise RuntimeError("out of memory")
            return [float(len(c)) for c in contents]

        return providers.ModelReranker(load, apply)


def test_a_failing_reranker_is_contained(tools, spark, monkeypatch):
    engine = tools.engine("Test")
    plain = engine.search(["alpha gamma", "alpha bakery"], 3, rerank=False).orderBy("qid", "rank").collect()
    by_place = [(r.qid, r.parent_id, round(1 - 0.05 * (r.rank - 1), 9)) for r in plain]

    def broken_load():
        raise OSError("no weights")

    monkeypatch.setattr(engine, "reranker", Broken.made(broken_load))
    got = engine.search(["alpha gamma", "alpha bakery"], 3).orderBy("qid", "rank").collect()
    assert [(r.qid, r.parent_id, round(r.score, 9)) for r in got] == by_place and len(got) > 3
    # the other query keeps its scores where only one fails
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        monkeypatch.setattr(engine, "reranker", Broken.made())
        got = engine.search(["alpha gamma", "alpha bakery"], 3).orderBy("qid", "rank").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.qid, r.parent_id, round(r.score, 9)) for r in got if r.qid == 1] == [x for x in by_place if x[0] == 1]
    assert all(r.score == len(r.content) for r in got if r.qid == 0)
    errors = spark.createDataFrame([("a bakery", "x"), ("y", "zz")], "q string, c string").repartition(2).select(engine.reranker.judged(F.col("q"), F.col("c")).alias("j")).select("j.*").collect()
    assert {(r.value, r.error) for r in errors} <= {(None, "RuntimeError: out of memory"), (2.0, None)} and any(r.error for r in errors)


def test_vectors_are_kept_by_content(spark, tmp_path):
    """A second ingest embeds new chunks alone, and a question that was asked before is not embedded again."""
    seen = spark.sparkContext.accumulator(0)
    plain = providers.HashEmbedder()

    class Counting:
        version = "hash-64"

        def embed(self, text):
            @F.pandas_udf("string")
            def counted(x: pd.Series) -> pd.Series:
                seen.add(len(x))
                return x

            return plain.embed(counted(text))

    e = Engine(spark, f"file://{tmp_path}", "kept", embedder=Counting())
    e.ingest_pages(spark.createDataFrame(ROWS, PAGES))
    assert seen.value == e.collection.read("children").select("contextualized_content").distinct().count() > 5
    before = seen.value
    e.ingest_pages(spark.createDataFrame([*ROWS, ("d4", "four.pdf", 1, "quite new words")], PAGES))
    assert seen.value == before + 1 and e.collection.read("children").where("embedding is null").count() == 0
    Engine(spark, f"file://{tmp_path}", "other", embedder=Counting()).ingest_pages(spark.createDataFrame(ROWS, PAGES))
    e.search_dense(spark.createDataFrame([(0, "quite new")], "qid long, query string"), 1).collect()
    assert seen.value == before + 2
    again = Engine(spark, f"file://{tmp_path}", "kept", embedder=Counting())
    assert again.search_dense(spark.createDataFrame([(0, "quite new")], "qid long, query string"), 1).first().chunk_id.startswith("d4_") and seen.value == before + 2
    want = Engine(spark, f"file://{tmp_path}", "plain")
    want.ingest_pages(spark.createDataFrame(ROWS, PAGES))
    shown = lambda x: sorted((r.chunk_id, tuple(r.embedding)) for r in x.collection.read("children").where("doc_id <> 'd4'").collect())
    assert shown(e) == shown(want)


def test_engine_with_a_kept_index(spark, tmp_path):
    """Dense search by the kept index: rows that come again count once, deleted ones are not found."""
    rows = [(f"d{n}", "f", 1, f"word{n} word{n % 7} common") for n in range(40)]
    e = Engine(spark, f"file://{tmp_path}", "near", config=EngineConfig(kept_index=True))
    e.ingest_pages(spark.createDataFrame(rows, PAGES))
    e.ingest_pages(spark.createDataFrame([*rows[:5], ("d50", "f", 1, "word3 word50 common")], PAGES))
    e.delete_document("d7")
    asked = spark.createDataFrame([(0, "word3 common"), (1, "word7"), (2, "word50")], "qid long, query string")
    vectors = e._embedded(asked, "query")
    exact = {(r.qid, r.chunk_id): (r.score, r.rank) for r in dense.nearest(e.collection.read("children"), vectors.select("qid", "vector"), 6, key="chunk_id", knn=True).collect()}
    got = {(r.qid, r.chunk_id): (r.score, r.rank) for r in e.search_dense(vectors, 6).collect()}
    assert sum(x in exact for x in got) >= 0.8 * len(exact) and all(exact[x][0] == v[0] for x, v in got.items() if x in exact) and len(got) == 18
    assert not any(c.startswith("d7_") for _, c in got) and (2, next(c for q, c in exact if q == 2 and c.startswith("d50_"))) in got
    e.clear()
    assert not e.vectors.exists()


def test_found(tools, spark):
    engine = tools.engine("Test")
    found = engine.search_found("delta epsilon", 2)
    assert [r.parent_id for r in found.top_parents.orderBy("rank").collect()] == [r.parent_id for r in engine.search("delta epsilon", 2).orderBy("rank").collect()]
    near = found.child_candidates.orderBy("rank").collect()
    assert len(near) == 4 and near[0].page_number == 2 and near[0].filename == "one.pdf" and found.missing.count() == 0
    assert found.route_decision.first().query == "delta epsilon"


def test_fold_of_rows_equals_fold(spark):
    import random

    rng, lists = random.Random(2), []
    for n in range(4):
        rows = [(q, f"c{c}", 0.5, r) for q in range(6) for r, c in enumerate(rng.sample(range(12), rng.randrange(1, 8)), 1)]
        lists.append(spark.createDataFrame(rows, "qid long, chunk_id string, rrf_score double, rank int"))
    rows = None
    for n, x in enumerate(lists):
        x = x.withColumn("n", F.lit(n))
        rows = x if rows is None else rows.unionByName(x)
    shown = lambda df: sorted((r.qid, r.rank, r.chunk_id, round(r.rrf_score, 12)) for r in df.collect())
    assert shown(fusion.fold_rows(rows, "chunk_id", 9)) == shown(fusion.fold(lists, "chunk_id", 9))


def test_kept_index_equals_search_of_the_chunks(tools, spark):
    engine = tools.engine("Test")
    asked = spark.createDataFrame([(0, "delta the database"), (1, "alpha gamma alpha"), (2, "nothing here")], "qid long, query string")
    children = engine.collection.read("children")
    got = engine.search_sparse(asked, 5).orderBy("qid", "rank").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in lexical.search(children, asked, 5, "chunk_id", {"contextualized_content": 2.0, "content": 1.0}).orderBy("qid", "rank").collect()] and got
    plan = engine.index().postings.where("shard in (1)")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(shard" in plan.replace("EqualTo(shard", "In(shard")


def test_retrieval_forms(tools, spark, monkeypatch):
    engine = tools.engine("Test")
    for hits in (engine.retrieve_rerank("database revenue", 2), engine.retrieve_chat("database revenue", 2), engine.retrieve_chat("database revenue", 2, rerank=False)):
        assert hits.orderBy("rank").first().doc_id == "d2" and hits.count() == 2
    monkeypatch.setattr(engine, "config", EngineConfig(sparse=False))
    near = engine.search_dense(engine._queries("database revenue"), 3).orderBy("rank").collect()
    assert [r.chunk_id for r in engine.search_hybrid(engine._queries("database revenue"), 3).orderBy("rank").collect()] == [r.chunk_id for r in near]
    assert engine.search_weighted("database revenue", 3).where("from_bm25").count() == 0


def test_agent(spark, root):
    a = agent.create_rag_agent(spark, root, "Agent")
    with pytest.raises(ValueError):
        a.search("x")
    a.insert_pages(spark.createDataFrame(ROWS[2:3], PAGES))
    got = agent.search_documents(a, "database revenue", 2)
    assert got["status"] == "success" and got["total_results"] == 1 and "**Sources:**\n[1] d2, p. 1" in got["answer"]
    assert set(got["results"][0]) == {"rank", "doc_id", "score", "page_start", "page_end", "content"}
    assert a.search("database", 2, rerank=False, include_context=False)["results"][0]["content"] is None
    a.engine.ingest_pages(spark.createDataFrame(ROWS[2:3], PAGES))
    assert a.search_hierarchical("database", 1).first().doc_id == "d2" and a.answer_hierarchical("database", 1).first().sources
    # another agent finds what this one has kept, and adds to it
    again = agent.create_rag_agent(spark, root, "Agent")
    assert again.insert_pages(spark.createDataFrame([("d5", "five.pdf", 3, "The ferry left the island at dawn. Gulls went with it."), ("d2", "two.pdf", 1, "revenue of the bakery grew")], PAGES), {"a": "b"}) == {"status": "success", "documents": 2, "chunks_processed": 2, "total_documents": 2}
    assert [(r["doc_id"], r["page_start"]) for r in a.search("ferry island", 1)["results"]] == [("d5", 3)]
    assert a.search("bakery", 1, rerank=False)["results"][0]["content"] == "revenue of the bakery grew"
    assert list(a.get_document_info(most=1)["documents"]) == ["d2"] and list(a.get_document_info(after="d2")["documents"]) == ["d5"]
    assert a.delete_document("d5")["status"] == "success"
    assert agent.get_document_list(a)["total_documents"] == 1 and a.get_document_info("d2")["document"]["chunks"] == 1
    assert a.get_document_info("d9")["status"] == "error" and a.delete_document("d9")["status"] == "error"
    with pytest.raises(ValueError):
        a.insert_pdfs(["x.pdf"], [{}, {}])
    for missing in (lambda: a.insert_pdfs(["/nowhere/a.pdf"]), lambda: a.insert_pdf("/nowhere/a.pdf")):
        with pytest.raises(FileNotFoundError):
            missing()
    assert agent.insert_document(a, "file:///root/repo/README.md")["status"] == "error"  # not a PDF, or no reader for one
    assert a.delete_document("d2")["status"] == "success" and a.clear_collection()["status"] == "success"
    assert a.get_document_info()["total_documents"] == 0


def test_ingest_again_replaces_and_delete_removes(spark, root):
    engine = Engine(spark, root, "again")
    engine.ingest_pages(spark.createDataFrame(ROWS, PAGES))
    before = engine.collection.read("children")
    engine.ingest_pages(spark.createDataFrame([("d2", "two.pdf", 1, "something else")], PAGES))
    assert before.count() == 10  # what was read before stays readable through the next write
    assert engine.collection.read("children").where("doc_id = 'd2'").count() == 1
    assert engine.document_info().count() == 2
    # a document that comes again with blank pages alone goes
    assert engine.ingest_pages(spark.createDataFrame([("d2", "two.pdf", 1, " ")], PAGES)) == {"status": "empty", "parents": 0, "children": 0}
    assert engine.collection.read("children").where("doc_id = 'd2'").count() == 0 and engine.index().documents.where("array_contains(owners, 'd2') and aggregate(dl, 0, (s, x) -> s + x) > 0").where("size(owners) = 1").count() == 0
    assert engine.delete_document("d1")["status"] == "success"
    assert engine.delete_document("d1")["status"] == "error"
    assert engine.collection.read("parents").count() == 0


REG = "doc_id string, filename string, pdf_path string, chunks bigint, inserted_at timestamp, custom_metadata map<string,string>"


def registered(spark, ids, chunks=1):
    return spark.createDataFrame([(i, "f", "f", chunks, None, None) for i in ids], REG)


def test_a_write_costs_what_it_brings(spark, root):
    c = Collection(spark, root, "pointers")
    many = registered(spark, [f"d{n}" for n in range(40_000)])
    c.replace(many, registry=many)
    c.replace(registered(spark, ["d3", "new"]), registry=registered(spark, ["d3", "new"], 7))
    n, segments = c._newest()
    assert n == 2 and [s["gone"] for s in segments] == [False, True] and segments[1]["bytes"] < segments[0]["bytes"] / 20
    assert c.read("registry").count() == 40_001 and c.read("registry").where("doc_id = 'd3'").first().chunks == 7
    assert c.remove("d3") and not c.remove("d3") and c.read("registry").count() == 40_000
    assert c._newest()[1][2]["bytes"] < 10_000 and c._newest()[1][2]["tables"] == []
    # a document may come back
    c.replace(registered(spark, ["d3"]), registry=registered(spark, ["d3"], 9))
    assert c.read("registry").where("doc_id = 'd3'").first().chunks == 9
    out = c._fs.create(c._path(c._pointer(5)), False)  # a writer that died while it wrote
    out.write(bytearray(b'{"regis'))
    out.close()
    assert c._newest()[0] == 4 and c.registry().count() == 40_001
    c.replace(registered(spark, ["d4"]), registry=registered(spark, ["d4"], 5))
    assert c._newest()[0] == 6 and c.read("registry").where("doc_id = 'd4'").first().chunks == 5
    assert c.compact(all_=True) and len(c._newest()[1]) == 1 and c.read("registry").count() == 40_001
    assert not c.compact() and Collection(spark, root, "nothing").registry().count() == 0


def test_writers_that_meet(spark, root):
    """What another writer does meanwhile is kept, if it touched other documents."""
    c = Collection(spark, root, "meet")
    c.replace(registered(spark, ["a", "b"]), registry=registered(spark, ["a", "b"]))

    def during(own, other):
        mine, plain = Collection(spark, root, "meet"), c._commit

        def commit(change):
            mine._commit = type(mine)._commit.__get__(mine)
            c.replace(registered(spark, other), registry=registered(spark, other, 2))
            mine._commit(change)

        mine._commit = commit
        mine.replace(registered(spark, own), registry=registered(spark, own, 3))
        assert plain is not None

    during(["a"], ["b", "c"])
    assert {r.doc_id: r.chunks for r in c.read("registry").collect()} == {"a": 3, "b": 2, "c": 2}
    with pytest.raises(Overtaken):
        during(["b"], ["b", "d"])
    assert {r.doc_id: r.chunks for r in c.read("registry").collect()} == {"a": 3, "b": 2, "c": 2, "d": 2}
    assert c.vacuum(0) == 1 and c.vacuum(0) == 0  # the folder of the write that failed


def test_segments_are_merged(spark, root, monkeypatch):
    monkeypatch.setattr(collection, "FAN", FAN := 3)
    c = Collection(spark, root, "merged")
    for n in range(7):
        c.replace(registered(spark, [f"d{n}", "often"]), registry=registered(spark, [f"d{n}", "often"], n))
        assert len(c._newest()[1]) <= FAN
    assert {r.doc_id: r.chunks for r in c.read("registry").collect()} == {**{f"d{n}": n for n in range(7)}, "often": 6}
    held = {s["id"] for s in c._newest()[1]}
    assert len([x for x in c._names(c.path) if x.startswith("segment-")]) <= len(held) + 2 * FAN


def test_deletions_reach_the_index(spark, root):
    """Scores after writes, deletions and merging are those of a search over what is left."""
    e = Engine(spark, root, "deleted")
    words = ["harbour", "lantern", "anchor", "barrel"]
    for n in (0, 3):
        e.ingest_pages(spark.createDataFrame([(f"d{m}", "f", 1, f"{words[m % 4]} {words[n]} old " * (m + 1)) for m in range(n, n + 5)], PAGES))
    e.delete_document("d4")
    asked = spark.createDataFrame([(0, "harbour lantern"), (1, "old anchor"), (2, "barrel barrel")], "qid long, query string")
    for _ in range(2):
        want = lexical.search(e.collection.read("children"), asked, 9, "chunk_id", {"contextualized_content": 2.0, "content": 1.0}).orderBy("qid", "rank").collect()
        assert [tuple(r) for r in e.search_sparse(asked, 9).orderBy("qid", "rank").collect()] == [tuple(r) for r in want] and len(want) > 12
        e.collection.compact(all_=True)


def test_empty_collection(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}", "none")
    assert e.answer("anything").first().answer.startswith("No relevant documents")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"doc_id":"s","filename":"f","page":1,"text":"streamed words"}\n')
    e = Engine(spark, f"file://{tmp_path}", "stream")
    ingest_stream(e, f"{tmp_path}/in", f"{tmp_path}/cp").awaitTermination()
    assert e.collection.read("children").count() == 1


def test_pdf_pages(spark, tmp_path):
    """With a stand-in for the reader, which the workers find on their path."""
    (tmp_path / "pypdf.py").write_text("class PdfReader:\n    def __init__(self, f):\n        raw = f.read().decode()\n        if raw == 'bad':\n            raise ValueError('broken')\n        self.pages = [type('P', (), {'extract_text': lambda s, t=t: t})() for t in raw.split('|')]\n")
    (tmp_path / "a.pdf").write_text("the first page| |the third page")
    (tmp_path / "b.pdf").write_text("bad")
    spark.sparkContext.addPyFile(str(tmp_path / "pypdf.py"))
    pages = tables.pdf_pages(spark, [f"file://{tmp_path}/a.pdf", f"file://{tmp_path}/b.pdf"])
    got = sorted(map(tuple, pages.collect()))
    assert got == [("a", "a.pdf", 1, 3, "the first page", None), ("a", "a.pdf", 3, 3, "the third page", None), ("b", "b.pdf", 0, 0, "", "ValueError: broken")]
    entries, failed = contextual.multi_document_dataset(pages)
    assert [(r.doc_id, r.original_uuid, r.pdf_path) for r in entries.collect()] == [("a", "a", "a.pdf")] and [r.filename for r in failed.collect()] == ["b.pdf"]
    one = agent.Agent(spark, f"file://{tmp_path}", "files")
    got = one.insert_pdfs([f"file://{tmp_path}/b.pdf", f"file://{tmp_path}/a.pdf"], [{}, {"a": "b"}])
    assert got == [{"status": "error", "doc_id": "b", "error": "ValueError: broken"}, {"status": "success", "doc_id": "a", "chunks_processed": 1, "total_documents": 1}]
    assert one.insert_pdf(f"file://{tmp_path}/a.pdf", "own") == {"status": "success", "doc_id": "own", "chunks_processed": 1, "total_documents": 2}
    assert one.get_document_info("a")["document"]["custom_metadata"] == {"a": "b"} and one.get_document_info("own")["document"]["filename"] == "a.pdf"
    t = Tools(spark, f"file://{tmp_path}")
    assert json.loads(t.rag_ingest_pdf(f"file://{tmp_path}/a.pdf", "pdf", "own")) == {"status": "success", "doc_id": "own", "filename": "a.pdf", "parent_chunks_indexed": 2, "child_chunks_indexed": 2}
    assert [r["status"] for r in t.engine("pdf").ingest_pdfs([f"file://{tmp_path}/b.pdf", f"file://{tmp_path}/a.pdf"], [{}, {"a": "b"}])] == ["error", "success"]
    assert {r.doc_id: r.custom_metadata for r in t.engine("pdf").document_info().collect()} == {"own": None, "a": {"a": "b"}}


def test_contextual_store_and_evaluations(spark, tmp_path):
    pages = spark.createDataFrame([(f"d{n}", f"f{n}", 1 + n % 2, f"The {w} of the harbour was old and grey. Nobody counted {w} twice there.") for n, w in enumerate(["lantern", "anchor", "barrel", "rudder"])], PAGES)
    dataset, failed = contextual.multi_document_dataset(pages)
    assert failed.count() == 0
    tables.export_json(dataset, f"file://{tmp_path}/dataset")
    chunks = spark.read.schema(dataset.schema).json(f"file://{tmp_path}/dataset")
    assert sorted(chunks.select("doc_id", F.size("chunks").alias("n")).collect()) == sorted(dataset.select("doc_id", F.size("chunks").alias("n")).collect())
    store = contextual.create_rag_system(dataset, generator=providers.ExtractiveGenerator(), analyze=lexical.english_tokens)
    row = store.chunks.where("doc_id = 'd0' and original_index = 0").first()
    assert row.contextualized_content.startswith("Content Summary: The lantern") and row.contextualized_content.endswith("\nPage(s): Page: 1")
    lines = []
    for n, w in enumerate(["lantern", "anchor", "barrel", "rudder"]):
        content = store.chunks.where(f"doc_id = 'd{n}'").orderBy("original_index").first().content
        gold = [["u", "0"], ["u", "7"]] if n < 3 else []
        lines.append(json.dumps({"query": f"counted {w}", "golden_chunk_uuids": gold, "golden_documents": [{"uuid": "u", "chunks": [{"index": 0, "content": f" {content}\n"}]}]}))
    (tmp_path / "e.jsonl").write_text("\n".join([*lines, lines[0]]))
    items = tables.evaluation_items(spark, f"file://{tmp_path}/e.jsonl")
    assert items.select("qid").distinct().count() == 5
    for out in (evaluation.evaluate_dense(items, store, 20), evaluation.evaluate_hybrid(items, store, 20), evaluation.evaluate_reranked(items, store, 20)):
        r = out.first()
        assert (r.n_queries, r.n_found) == (5, 4) and abs(r.pass_at_k - 80) < 1e-9
    assert abs(r.pass_at_k - 80) < 1e-9 and evaluation.evaluate_hybrid(items, store, 2).first().n_results == 8
    one = items.where("query = 'counted anchor'")
    assert store.with_chunks(store.retrieve_rerank(one, 1).select("qid", "key", "rank")).first().doc_id == "d1"


def test_worker_model(spark):
    model = providers.WorkerModel(lambda: {"add": 2}, lambda m, x: x + m["add"], "long")
    assert [r[0] for r in spark.range(3).select(model(F.col("id"))).collect()] == [2, 3, 4]
    summary = providers.ExtractiveGenerator().document_summary(F.lit("One. Two. Three."))
    assert spark.range(1).select(summary).first()[0] == "One. Three"


def test_inspection(spark, tmp_path):
    rows = spark.createDataFrame([(n, "x" * (199 + n)) for n in range(9, -1, -1)], "id long, content string")
    n, shown = tables.inspect(rows, dump=f"file://{tmp_path}/all")
    got = shown.collect()
    assert n == 10 and [r.id for r in got] == [0, 1, 2, 3, 4] and [len(r.content) for r in got] == [199, 200, 203, 203, 203]
    assert spark.read.json(f"file://{tmp_path}/all").count() == 10


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["cluster_segmentation", "cluster_assembly", "end_to_end_search", "pass_at_k", "citation_links", "retrieve_rerank", "route_decision", "hash_embedding", "chat_prompts"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    shown = lambda x: round(x, 8) if isinstance(x, float) else x
    got = sorted(tuple(map(shown, r)) for r in df.select(*cols).collect())
    sql = catalog.ORACLES[name]
    want = sorted(tuple(map(shown, r)) for r in con.execute(f"select {', '.join(cols)} from ({sql})").fetchall())
    assert got == want


def test_large_tables_stay_where_they_are(spark, tmp_path, monkeypatch):
    """A small table becomes one file; the rows of a large one are not moved, and a table can be made of one written before."""
    rows = spark.range(30).selectExpr("cast(id as string) as parent_id", "cast(id as string) as doc_id", "'f' as filename", "'x' as content", "1 as page_start", "1 as page_end", "cast(null as map<string,string>) as metadata").repartition(3)
    registry = lambda done: done("parents").selectExpr("doc_id", "filename", "filename as pdf_path", "1L as chunks", "current_timestamp() as inserted_at", "metadata as custom_metadata")
    for small, files in ((32 << 20, 1), (-1, 3)):
        monkeypatch.setattr(collection, "SMALL", small)
        c = Collection(spark, "file://" + str(tmp_path), f"c{files}")
        c.replace(rows.select("doc_id"), parents=rows, registry=registry)
        assert len(c.read("parents").inputFiles()) == files and c.read("parents").count() == c.read("registry").count() == 30


def test_places_that_do_not_count_any_more(spark, tmp_path):
    """A store of which documents came in again: terms, statistics and hits are those of its chunks; postings are joined with the words first."""
    store = contextual.ContextualStore(spark, "file://" + str(tmp_path), "again")
    page = lambda n, w: (f"d{n}", f"{n}.pdf", 1, f"The harbour number {n} is {w}. Old {w} lanterns burn at harbour {n % 3}.")
    store.insert_pages(spark.createDataFrame([page(n, "red") for n in range(12)], PAGES))
    store.insert_pages(spark.createDataFrame([page(n, "green") for n in range(0, 12, 4)], PAGES))
    index, fresh = store.collection.index("cluster_postings", "key"), lexical.index(store.chunks, "key", list(contextual.FIELDS))
    for what in ("terms", "stats"):
        assert sorted(map(tuple, getattr(index, what).collect())) == sorted(map(tuple, getattr(fresh, what).collect()))
    asked = spark.createDataFrame([(0, "red lanterns"), (1, "green harbour 4")], "qid long, query string")
    got = store.search_bm25(asked, 9)
    want = lexical.search(store.chunks, asked, 9, "key", contextual.FIELDS).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert any(r.qid == 1 for r in got.collect())
