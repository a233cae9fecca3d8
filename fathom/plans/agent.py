"""The older surface over an engine: documents in, search with answers, and module-level helpers."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import prompting
from fathom.plans.contextual import ContextualStore, multi_document_dataset
from fathom.plans.engine import ANALYZERS, Engine
from fathom.sources import tables, workspace


#: Documents that ``get_document_info`` lists at a time.
LISTED = 1000


class Agent:
    """A contextual store with answers, and an engine over windows beside it, under one name."""

    def __init__(self, spark: SparkSession, root: str, collection: str = "default", **options):
        self.spark = spark
        self.engine = Engine(spark, root, collection, **options)
        self.store = ContextualStore(spark, root, collection, self.engine.embedder, self.engine.reranker, analyze=ANALYZERS[self.engine.config.analyzer])

    # --- documents ---

    def _there(self, path: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            raise FileNotFoundError(path)

    def _count(self) -> int:
        return self.store.collection.registry().count()

    def insert_pdf(self, path: str, doc_id: str | None = None, metadata: dict[str, str] | None = None) -> dict[str, Any]:
        """A missing file raises; one that cannot be read gives a result that says so."""
        self._there(path)
        own = doc_id or path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        try:
            return self._insert([path], [own], [metadata], doc_id)[0]
        except Exception as e:  # the caller gets the error as a result  # noqa: BLE001
            return {"status": "error", "doc_id": own, "error": str(e)}

    def insert_pdfs(self, paths: list[str], metadata: list[dict[str, str]] | None = None) -> list[dict[str, Any]]:
        """All files in one job, with a result for each in order; files that name one document twice go one after another."""
        if metadata and len(metadata) != len(paths):
            raise ValueError("metadata must have one entry for each path")
        for path in paths:
            self._there(path)
        own = [p.rsplit("/", 1)[-1].rsplit(".", 1)[0] for p in paths]
        about = metadata or [None] * len(paths)
        if len(set(own)) < len(own):
            return [self.insert_pdf(p, metadata=m) for p, m in zip(paths, about, strict=True)]
        return self._insert(paths, own, about) if paths else []

    def _insert(self, paths: list[str], ids: list[str], metadata: list[dict[str, str] | None], doc_id: str | None = None) -> list[dict[str, Any]]:
        pages = workspace.written(tables.pdf_pages(self.spark, paths, doc_id), "pdf")
        failed = {r.doc_id: r.error for r in pages.where("error is not null").select("doc_id", "error").collect()}  # a row a path
        rows = [(i, p.rsplit("/", 1)[-1], m or {}) for i, p, m in zip(ids, paths, metadata, strict=True)]
        about = self.spark.createDataFrame(rows, "doc_id string, filename string, custom_metadata map<string,string>")
        registry = self.store.collection.registry()
        n, had = registry.count(), {r.doc_id for r in registry.join(about, "doc_id", "left_semi").select("doc_id").collect()}
        made = {}
        if len(failed) < len(ids):
            dataset, _ = multi_document_dataset(pages, self.store.embedder)
            made = {r.doc_id: r.chunks for r in self.store.insert_dataset(dataset, about).collect()}  # a row a path
        out = []
        for i in ids:
            if i in failed:
                out.append({"status": "error", "doc_id": i, "error": failed[i]})
                continue
            n += i in made and i not in had
            out.append({"status": "success", "doc_id": i, "chunks_processed": made.get(i, 0), "total_documents": n})
        return out

    def insert_pages(self, pages: DataFrame, metadata: dict[str, str] | None = None) -> dict[str, Any]:
        """``pages``: doc_id, filename, page, text, of any number of documents, in one job."""
        made = self.store.insert_pages(pages, metadata).agg(F.count("*").alias("n"), F.sum("chunks").alias("c")).first()
        return {"status": "success", "documents": made.n, "chunks_processed": made.c or 0, "total_documents": self._count()}

    def get_document_info(self, doc_id: str | None = None, most: int = LISTED, after: str | None = None) -> dict[str, Any]:
        """One document, or how many there are with the first ``most`` of them by id (of those after ``after``)."""
        rows = self.store.collection.registry()
        if doc_id is not None:
            found = rows.where(F.col("doc_id") == doc_id).first()
            return {"status": "success", "document": found.asDict(recursive=True)} if found else {"status": "error", "error": f"no document {doc_id!r}"}
        shown = (rows if after is None else rows.where(F.col("doc_id") > after)).orderBy("doc_id").limit(most).collect()
        return {"status": "success", "total_documents": rows.count(), "documents": {r.doc_id: r.asDict(recursive=True) for r in shown}}

    def delete_document(self, doc_id: str) -> dict[str, Any]:
        if not self.store.collection.remove(doc_id):
            return {"status": "error", "error": f"no document {doc_id!r}"}
        return {"status": "success", "doc_id": doc_id, "message": f"document {doc_id!r} is gone"}

    def clear_collection(self) -> dict[str, Any]:
        self.store.collection.recreate()
        return self.engine.clear()

    # --- search and answers over chunks ---

    def retrieve(self, queries, k: int = 5, rerank: bool = True) -> DataFrame:
        """Dense hits, three times as many as asked for, reranked; or the weighted fusion. With qid, query, rank, score and the chunk."""
        asked, c = self.engine.asked(queries), self.engine.config
        if rerank:
            return self.store.retrieve_rerank(asked, k, c.agent_multiplier)
        return self.store.with_chunks(self.store.search_weighted(asked, k, c.semantic_weight, c.bm25_weight, c.recall)).join(asked, "qid")

    def answers(self, queries, hits: DataFrame) -> DataFrame:
        """qid, query, answer: the model's reply with its list of sources."""
        asked = self.engine.asked(queries).join(prompting.legacy_context(hits), "qid", "left")
        reply = self.engine.generator.answer(prompting.legacy_prompt(F.coalesce("context", F.lit("")), "query"), F.coalesce("context", F.lit("")))
        return asked.select("qid", "query", prompting.legacy_answer(reply, "citations").alias("answer"))

    def search(self, query: str, k: int = 5, rerank: bool = True, include_context: bool = True) -> dict[str, Any]:
        if self.store.collection.registry().isEmpty():
            raise ValueError("the collection is empty: insert documents before searching")
        try:
            hits = workspace.written(self.retrieve(query, k, rerank), "hits")  # searched once, for results and answer
            rows = prompting.result_rows(hits, include_context).drop("qid").orderBy("rank").collect()
            reply = self.answers(query, hits).first()
            return {"status": "success", "query": query, "answer": reply.answer, "results": [r.asDict() for r in rows], "total_results": len(rows)}
        except Exception as e:  # the caller gets the error as a result  # noqa: BLE001
            return {"status": "error", "query": query, "error": str(e)}

    # --- the engine's own surface ---

    def ingest_hierarchical_pdf(self, path: str, doc_id: str | None = None) -> dict[str, Any]:
        return self.engine.ingest_pdf(path, doc_id)

    def search_hierarchical(self, query: str, k: int = 5, rerank: bool = True) -> DataFrame:
        return self.engine.search(query, k, rerank)

    def answer_hierarchical(self, query: str, k: int = 5, rerank: bool = True) -> DataFrame:
        return self.engine.answer(query, k, rerank)


def create_rag_agent(spark: SparkSession, root: str, collection_name: str = "default") -> Agent:
    return Agent(spark, root, collection_name)


def insert_document(agent: Agent, pdf_path: str, doc_id: str | None = None, metadata: dict[str, str] | None = None) -> dict[str, Any]:
    return agent.insert_pdf(pdf_path, doc_id, metadata)


def search_documents(agent: Agent, query: str, k: int = 5, use_reranking: bool = True) -> dict[str, Any]:
    return agent.search(query, k, use_reranking)


def get_document_list(agent: Agent) -> dict[str, Any]:
    return agent.get_document_info()
