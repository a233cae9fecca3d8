"""The retrieval engine over a collection: ingest, route, search, answer, and the tools that return JSON.

Whole tables of queries are answered at once. Routing is a table too: the queries of each tier take
their own plan and the results are united. The only thing that comes to the driver before the
result is which tiers occur. A query is embedded once, and routed once.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.operators import chunking, dense, fusion, lexical, prompting, resolve, router
from fathom.operators.vector_index import VectorIndex
from fathom.plans.providers import CoverageReranker, Embedder, ExtractiveGenerator, Generator, HashEmbedder, Reranker
from fathom.sources import tables, workspace
from fathom.sources.collection import Collection
from fathom.sources.vector_store import VectorStore

ANALYZERS = {"standard": T.tokens, "english": lexical.english_tokens}
FIELDS = {"contextualized_content": 2.0, "content": 1.0}


@dataclass(frozen=True)
class EngineConfig:
    parent_size: int = 1000
    parent_overlap: int = 150
    child_size: int = 200
    child_overlap: int = 30
    k_rrf: int = 60
    probe: int = 5
    thresholds: router.Thresholds = field(default_factory=router.Thresholds)
    semantic_weight: float = 0.7
    bm25_weight: float = 0.3
    recall: int = 150
    rerank_multiplier: int = 10
    agent_multiplier: int = 3
    chat_multiplier: int = 2
    #: Without sparse search hybrid search is the dense one alone.
    sparse: bool = True
    analyzer: str = "standard"
    fallback_direct: bool = False
    #: Vectors of single queries that are kept.
    cached_queries: int = 1000
    #: Chunks also go into a kept index of vectors, which dense search asks; results are then approximate.
    kept_index: bool = False


@dataclass(frozen=True)
class Found:
    route_decision: DataFrame
    top_parents: DataFrame
    #: The best 2 k child hits of each query, with the chunks' columns.
    child_candidates: DataFrame
    #: qid, n_missing of the queries with hits that are not there any more.
    missing: DataFrame


class Engine:
    def __init__(self, spark: SparkSession, root: str, collection: str = "default", embedder: Embedder | None = None, reranker: Reranker | None = None, generator: Generator | None = None, config: EngineConfig | None = None):
        self.spark, self.root, self.config = spark, root, config or EngineConfig()
        self.collection = Collection(spark, root, collection)
        self.vectors = VectorIndex(spark, f"{self.collection.path}_index")
        self.embedder, self.reranker, self.generator = embedder or HashEmbedder(), reranker or CoverageReranker(), generator or ExtractiveGenerator()
        self._vectors: OrderedDict[str, list[float]] = OrderedDict()

    # --- ingest ---

    def ingest_pages(self, pages: DataFrame, metadata: dict[str, str] | None = None) -> dict:
        """``pages``: doc_id, filename, page, text. Documents that are there already are replaced, also by nothing."""
        c = self.config
        given = pages.select(F.col("doc_id").cast("string").alias("doc_id"), "filename", F.col("page").cast("int").alias("page"), "text").where("doc_id is not null")
        given = workspace.written(given, "pages")
        kept = given.where(T.normalise("text") != "")
        parents = workspace.written(chunking.parents(kept, c.parent_size, c.parent_overlap), "parents")
        children = chunking.contextualise(chunking.children(parents, c.child_size, c.child_overlap, head=True)).drop("head")
        children = children.withColumn("contextualized_content", F.coalesce(F.nullif("contextualized_content", F.lit("")), "content"))
        children = self._with_vectors(children, "contextualized_content", "embedding")
        if self.config.kept_index:  # which reads them more than once
            children = workspace.written(children, "children")
        # rows of a parent are where it is: few come to the second count
        registry = parents.select("doc_id", "filename", F.size(T.windows(T.words("content"), c.child_size, c.child_overlap)).alias("n"))
        registry = registry.groupBy("doc_id").agg(F.first("filename").alias("filename"), F.sum("n").alias("chunks"))
        meta = F.create_map(*[F.lit(x) for kv in (metadata or {}).items() for x in kv]) if metadata else F.lit(None).cast("map<string,string>")
        registry = registry.select("doc_id", "filename", F.col("filename").alias("pdf_path"), "chunks", F.current_timestamp().alias("inserted_at"), meta.alias("custom_metadata"))
        parents = parents.withColumn("metadata", F.lit(None).cast("map<string,string>"))
        if self.config.kept_index and not children.isEmpty():
            if not self.vectors.exists():
                self.vectors.fit(children, "chunk_id")
            self.vectors.add(children, "chunk_id")
        registry = workspace.written(registry, "registry")
        self.collection.replace(given, parents=parents, children=children, postings=lambda done: self._postings(done("children")), registry=registry)
        n_p, n_c = parents.count(), registry.agg(F.coalesce(F.sum("chunks"), F.lit(0))).first()[0]
        if not n_p:
            return {"status": "empty", "parents": 0, "children": 0}
        who = kept.select("doc_id", "filename").distinct().orderBy("doc_id", "filename").limit(2).collect()
        one = {"doc_id": who[0].doc_id, "filename": who[0].filename} if len({r.doc_id for r in who}) == 1 else {"documents": registry.count()}
        return {"status": "success", **one, "parent_chunks_indexed": n_p, "child_chunks_indexed": n_c}

    def _postings(self, children: DataFrame) -> DataFrame:
        made = lexical.index(children, "chunk_id", list(FIELDS), ANALYZERS[self.config.analyzer], owner="doc_id")
        return made.rows.withColumn("shard", lexical.shard())

    def ingest_pdf(self, path: str, doc_id: str | None = None, metadata: dict[str, str] | None = None) -> dict:
        pages = workspace.written(tables.pdf_pages(self.spark, path, doc_id), "pdf")
        bad = [r.error for r in pages.where("error is not null").select("error").limit(1).collect()]
        return {"status": "error", "message": bad[0]} if bad else self.ingest_pages(pages, metadata)

    def ingest_pdfs(self, paths: list[str], metadata: list[dict[str, str]] | None = None) -> list[dict]:
        """One result a file, in order; a file that fails does not keep the others out. With ``metadata`` one for each file."""
        if metadata and len(metadata) != len(paths):
            raise ValueError("metadata must have one entry for each path")
        out = []
        for n, path in enumerate(paths):
            try:
                out.append(self.ingest_pdf(path, metadata=metadata[n] if metadata else None))
            except Exception as e:  # one bad file must not end the job  # noqa: BLE001
                out.append({"status": "error", "message": str(e)})
        return out

    # --- search ---

    def _queries(self, queries: str | list[str] | DataFrame) -> DataFrame:
        """qid, query, vector."""
        if isinstance(queries, DataFrame):
            return self._embedded(queries.select("qid", "query"), "query")
        texts = [queries] if isinstance(queries, str) else list(queries)
        new = [q for q in dict.fromkeys(texts) if q not in self._vectors]
        fresh = {}
        if new:
            rows = self._embedded(self.spark.createDataFrame([(n, q) for n, q in enumerate(new)], "qid long, query string"), "query").collect()
            fresh = {r.query: list(r.vector) for r in rows}
        rows = [(n, q, fresh[q] if q in fresh else self._vectors[q]) for n, q in enumerate(texts)]
        for q in texts:
            self._vectors[q] = fresh.get(q) or self._vectors.get(q)
            self._vectors.move_to_end(q)
        while len(self._vectors) > self.config.cached_queries:
            self._vectors.popitem(last=False)
        return self.spark.createDataFrame(rows, "qid long, query string, vector array<double>")

    def asked(self, queries: str | list[str] | DataFrame) -> DataFrame:
        """qid, query."""
        if isinstance(queries, DataFrame):
            return queries.select("qid", "query")
        return self.spark.createDataFrame(list(enumerate([queries] if isinstance(queries, str) else queries)), "qid long, query string")

    def _embedded(self, asked: DataFrame, text: str) -> DataFrame:
        return workspace.written(self._with_vectors(asked, text, "vector"), "queries")

    def _with_vectors(self, rows: DataFrame, text: str, name: str) -> DataFrame:
        """Of an embedder that names its ``version``, vectors are kept by content, and only texts that are new are embedded."""
        version = getattr(self.embedder, "version", None)
        if version is None:
            return rows.withColumn(name, self.embedder.embed(F.col(text)))
        return VectorStore(self.spark, self.root, version).embedded(rows, text, self.embedder.embed, name)

    def search_dense(self, asked: DataFrame, k: int, text: str = "query") -> DataFrame:
        """``asked``: qid and vector, or qid and ``text``."""
        vectors = asked if "vector" in asked.columns else self._embedded(asked, text)
        children, vectors = self.collection.read("children"), vectors.select("qid", "vector")
        if not self.config.kept_index or not self.vectors.exists():
            return dense.nearest(children, vectors, k, key="chunk_id", knn=True)
        # as many chunks get the exact second look as the older store's candidates
        near = self.vectors.search(children, vectors, k, "chunk_id", shortlist=max(100, 2 * k))
        return near.withColumn("score", F.round((F.col("score") + 1) / 2, 7))

    def index(self) -> lexical.Index:
        """The kept index of all chunks."""
        return self.collection.index("postings", "chunk_id")

    def search_sparse(self, asked: DataFrame, k: int, fields: dict[str, float] | None = None) -> DataFrame:
        return lexical.search_index(self.index(), asked, k, fields or FIELDS, ANALYZERS[self.config.analyzer])

    def search_hybrid(self, asked: DataFrame, k: int) -> DataFrame:
        """``asked``: qid, query, vector."""
        near = self.search_dense(asked, 2 * k)
        found = self.search_sparse(asked, 2 * k) if self.config.sparse else near.limit(0)
        return fusion.rrf(near, found, "chunk_id", k, self.config.k_rrf)

    def search_weighted(self, queries, k: int) -> DataFrame:
        """The older fusion: weighted reciprocal ranks of 150 hits a side."""
        asked, c = self._queries(queries), self.config
        near = self.search_dense(asked, c.recall)
        found = self.search_sparse(asked, c.recall, {"contextualized_content": 1.0, "content": 1.0}) if c.sparse else near.limit(0)
        return fusion.weighted_reciprocal(near, found, ["chunk_id"], k, c.semantic_weight, c.bm25_weight)

    def _reranked(self, asked: DataFrame, hits: DataFrame, k: int) -> DataFrame:
        """Chunks of the hits, the best k by the reranker: qid, query, rank, score and the chunk's columns."""
        chunks = self.collection.read("children").drop("embedding")
        rows = hits.select("qid", "chunk_id", "rank").join(chunks, "chunk_id").join(asked.select("qid", "query"), "qid")
        return resolve.rerank_chunks(rows, k, self.reranker.score(F.col("query"), chunking.rerank_text("content")), "chunk_id")

    def retrieve_rerank(self, queries, k: int = 20, multiplier: int | None = None) -> DataFrame:
        """Dense hits, ``multiplier`` (10) times as many as asked for, then the best k by the reranker."""
        asked = self._queries(queries)
        return self._reranked(asked, self.search_dense(asked, k * (multiplier or self.config.rerank_multiplier)), k)

    def retrieve_chat(self, queries, k: int = 10, rerank: bool = True) -> DataFrame:
        """The chat's search: weighted fusion of 2 k hits, reranked or cut to k."""
        asked = self._queries(queries)
        hits = self.search_weighted(queries, k * self.config.chat_multiplier)
        if rerank:
            return self._reranked(asked, hits, k)
        return hits.where(F.col("rank") <= k).join(self.collection.read("children").drop("embedding"), "chunk_id").join(asked.select("qid", "query"), "qid")

    def route(self, queries) -> DataFrame:
        """All fields of the decision and the query's vector; a model is asked for the tiers other than direct."""
        asked = self._queries(queries)
        decided = router.route(asked, self.search_dense(asked, self.config.probe), self.config.thresholds)
        none = F.array().cast("array<string>")
        subs = F.when(F.col("tier") == "multi_query", router.sub_queries(self.generator.sub_queries(F.col("query")))).otherwise(none)
        decided = decided.withColumn("expanded_queries", subs).withColumn("hypothetical_doc", F.when(F.col("tier") == "hyde", T.strip(self.generator.passage(F.col("query")))))
        return decided.join(asked.select("qid", "vector"), "qid")

    def candidates(self, decided: DataFrame, k: int) -> DataFrame:
        """Child hits of each query by its tier: qid, chunk_id, rrf_score, rank. A tier without its text gives none.

        All texts that the tiers ask for are rows of one table, which is searched once by vectors and once by words.
        """
        c = self.config
        several = (F.col("tier") == "multi_query") & (F.size("expanded_queries") > 0)
        passage = (F.col("tier") == "hyde") & (F.coalesce("hypothetical_doc", F.lit("")) != "")
        direct = F.col("tier") == "direct"
        direct = direct | ~(several | passage) if c.fallback_direct else direct
        # the query itself, and up to three others; the vector of a passage goes with the query's own words
        texts = F.when(several, F.concat(F.array("query"), F.slice("expanded_queries", 1, 3))).when(direct | passage, F.array("query"))
        rows = decided.select("qid", "vector", several.alias("several"), F.when(passage, F.col("hypothetical_doc")).alias("passage"), F.posexplode(texts).alias("n", "query")).where("query is not null")
        new = F.coalesce("passage", F.when(F.col("n") > 0, F.col("query")))
        rows = rows.withColumn("new", new).withColumn("made", self.embedder.embed(F.coalesce("new", F.lit(""))))
        rows = rows.select("qid", "n", "several", "query", F.when(F.col("new").isNull(), F.col("vector")).otherwise(F.col("made")).alias("vector"))
        rows = workspace.written(rows.withColumn("sid", F.format_string("%s#%d", F.col("qid").cast("string"), "n")).withColumn("most", F.when(F.col("several"), 2 * k).otherwise(4 * k)), "asked")
        asked, limits = rows.select(F.col("sid").alias("qid"), "query", "vector"), rows.select("sid", F.col("qid").alias("own"), "n", "several", "most")
        near = self.search_dense(asked, 8 * k)
        found = self.search_sparse(asked.drop("vector"), 8 * k) if c.sparse else near.limit(0)
        cut = lambda hits: hits.join(limits, hits["qid"] == limits["sid"]).where(F.col("rank") <= 2 * F.col("most")).select(*hits.columns)
        fused = fusion.rrf(cut(near), cut(found), "chunk_id", 1 << 30, c.k_rrf)
        fused = fused.join(limits, fused["qid"] == limits["sid"]).where(F.col("rank") <= F.col("most")).drop("qid", "sid").withColumnRenamed("own", "qid")
        fused = workspace.written(fused, "fused")
        single = fused.where("not several").select("qid", "chunk_id", "rrf_score", "rank")
        return single.unionByName(fusion.fold_rows(fused.where("several"), "chunk_id", 4 * k, c.k_rrf))

    def _parents(self, decided: DataFrame, hits: DataFrame, k: int, rerank: bool) -> DataFrame:
        found = resolve.resolve_parents(hits, self.collection.read("children"), self.collection.read("parents")).join(decided.select("qid", "query", "tier", "reason"), "qid")
        if not rerank:
            return resolve.no_rerank(found, k)
        return resolve.rerank(found, k, self.reranker.score(F.col("query"), F.col("content")))

    def search_routed(self, decided: DataFrame, k: int = 5, rerank: bool = True) -> DataFrame:
        return self._parents(decided, self.candidates(decided, k), k, rerank)

    def search_found(self, queries, k: int = 5, rerank: bool = True) -> Found:
        """All that a search finds: the decisions, the parents, the children behind them, and how many hits name no chunk."""
        decided = workspace.written(self.route(queries), "decided")
        hits = workspace.written(self.candidates(decided, k), "hits")
        children = self.collection.read("children").drop("embedding")
        near = hits.where(F.col("rank") <= 2 * k).join(children, "chunk_id").join(decided.select("qid", "query"), "qid")
        return Found(decided.drop("vector"), self._parents(decided, hits, k, rerank), near, resolve.missing(hits, children))

    def search(self, queries, k: int = 5, rerank: bool = True) -> DataFrame:
        """Parents of each query: qid, query, tier, reason, rank, score and the parent's columns."""
        return self.search_routed(workspace.written(self.route(queries), "decided"), k, rerank)

    def answer_routed(self, decided: DataFrame, k: int = 5, rerank: bool = True) -> DataFrame:
        hits = workspace.written(self.search_routed(decided, k, rerank), "hits")
        context = prompting.context_blocks(hits)
        rows = F.array_sort(F.collect_list(F.struct("index", "filename", "page_start", "page_end", "score", "content_preview")))
        sources = prompting.source_rows(hits).groupBy("qid").agg(rows.alias("sources"))
        out = decided.select("qid", "query", "tier", "reason").join(context, "qid", "left").join(sources, "qid", "left")
        reply = self.generator.answer(prompting.answer_prompt("context", "query"), F.col("context"))
        return out.select("qid", "query", F.when(F.col("context").isNull(), F.lit(prompting.NO_SOURCES)).otherwise(T.strip(reply)).alias("answer"), "sources", F.col("context").alias("context_used"), "tier", "reason")

    def answer(self, queries, k: int = 5, rerank: bool = True) -> DataFrame:
        """qid, query, answer, sources, context_used (null where nothing was found), tier, reason."""
        return self.answer_routed(workspace.written(self.route(queries), "decided"), k, rerank)

    # --- documents ---

    def document_info(self, doc_id: str | None = None) -> DataFrame:
        rows = self.collection.registry()
        return rows if doc_id is None else rows.where(F.col("doc_id") == doc_id)

    def delete_document(self, doc_id: str) -> dict:
        done = self.collection.remove(doc_id)
        return {"status": "success", "doc_id": doc_id, "message": f"document {doc_id!r} is gone"} if done else {"status": "error", "error": f"no document {doc_id!r}"}

    def clear(self) -> dict:
        self.collection.recreate()
        self.vectors.remove()
        return {"status": "success", "message": f"collection {self.collection.path.rsplit('/', 1)[-1]!r} is empty"}


class Tools:
    """The tools that a client calls by name; each returns JSON, also of an error. One engine is kept for each collection."""

    def __init__(self, spark: SparkSession, root: str, **options):
        self.spark, self.root, self.options = spark, root, options
        self._engines: dict[str, Engine] = {}

    def engine(self, collection: str = "default") -> Engine:
        if collection not in self._engines:
            self._engines[collection] = Engine(self.spark, self.root, collection, **self.options)
        return self._engines[collection]

    def _reply(self, f) -> str:
        try:
            return json.dumps(f(), ensure_ascii=False, default=str)
        except Exception as e:  # tools report errors as JSON  # noqa: BLE001
            return json.dumps({"status": "error", "message": str(e)}, ensure_ascii=False)

    def rag_ingest_pdf(self, pdf_path: str, collection_name: str = "default", doc_id: str | None = None) -> str:
        def run():
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(pdf_path)
            if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
                return {"status": "error", "message": f"no file {pdf_path}"}
            return self.engine(collection_name).ingest_pdf(pdf_path, doc_id)

        return self._reply(run)

    def rag_ask(self, question: str, collection_name: str = "default", top_k: int = 5, use_reranking: bool = True) -> str:
        def run():
            r = self.engine(collection_name).answer(question, top_k, use_reranking).first()
            return {"answer": r.answer, "router_tier": r.tier, "router_reason": r.reason, "sources": [s.asDict() for s in r.sources or []]}

        return self._reply(run)

    def rag_search(self, query: str, collection_name: str = "default", top_k: int = 5, use_reranking: bool = True) -> str:
        def run():
            engine = self.engine(collection_name)
            decided = workspace.written(engine.route(query), "decided")
            rows, decision = engine.search_routed(decided, top_k, use_reranking).orderBy("rank").collect(), decided.first()
            shown = [{c: r[c] for c in ("parent_id", "doc_id", "filename", "score", "page_start", "page_end", "content")} for r in rows]
            return {"query": query, "router_tier": decision.tier, "router_reason": decision.reason, "results_count": len(shown), "results": shown}

        return self._reply(run)

    def rag_route_query(self, query: str, collection_name: str = "default") -> str:
        return self._reply(lambda: self.engine(collection_name).route(query).drop("qid", "vector").first().asDict())


_tools: dict[tuple[str, str], Tools] = {}


def tools_of(spark: SparkSession, root: str) -> Tools:
    """The tools of a folder of collections in this application."""
    return _tools.setdefault((spark.sparkContext.applicationId, root), Tools(spark, root))
