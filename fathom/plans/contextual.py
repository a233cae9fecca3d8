"""The older store: semantic clusters of sentences with a context each, searched by vectors and by words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.operators import chunking, dense, fusion, lexical, resolve, semantic
from fathom.plans.providers import CoverageReranker, Embedder, Generator, HashEmbedder, Reranker
from fathom.sources import tables, workspace
from fathom.sources.collection import Collection

#: Clusters hold at most so many pieces: the largest chunk over the smallest, in estimated tokens.
LARGEST, SMALLEST = 400, 50
FIELDS = {"content": 1.0, "contextualized_content": 1.0}


def cluster_chunks(pages: DataFrame, embedder: Embedder | None = None, longest: int = LARGEST // SMALLEST, least: float = SMALLEST, terms: bool = False) -> DataFrame:
    """``pages``: doc_id, page, text. Sentences, long ones cut, gathered to chunks: doc_id, original_index, chunk_id, content, pages, token_count.

    With ``terms`` and an embedder that takes them, the terms of the content besides.
    """
    embedder = embedder or HashEmbedder()
    pieces = chunking.split_by_size(tables.page_sentences(pages), least)
    # the one shuffle; vectors are made behind it, and go no further than the clusters
    pieces = pieces.repartition("doc_id").sortWithinPartitions("doc_id", "page", "at", "piece")
    if not hasattr(embedder, "of_terms"):
        return semantic.chunks(pieces.withColumn("embedding", embedder.embed(F.col("text"))), longest)
    found = semantic.chunks(pieces.withColumn("terms", T.tokens("text")), longest, embedder.of_terms)
    return found if terms else found.drop("terms")


def multi_document_dataset(pages: DataFrame, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """``pages`` as of ``tables.pdf_pages``: entries of the files that could be read, and the errors of the others (filename, error)."""
    failed = pages.where("error is not null").select("filename", "error") if "error" in pages.columns else pages.limit(0).select("filename", F.lit("").alias("error"))
    good = pages.where("error is null") if "error" in pages.columns else pages
    paths = good.groupBy("doc_id").agg(F.min("filename").alias("pdf_path"))
    return semantic.dataset(cluster_chunks(good, embedder), paths), failed


def contextual_chunks(dataset: DataFrame, generator: Generator | None = None) -> DataFrame:
    """One row a chunk of the entries, with its context."""
    return with_contexts(dataset.select("doc_id", "original_uuid", F.explode("chunks").alias("c")).select("doc_id", "original_uuid", "c.*"), generator)


def with_contexts(rows: DataFrame, generator: Generator | None = None) -> DataFrame:
    """Chunks with their contexts: by a model, or from their pages alone."""
    out = chunking.legacy_context(rows) if generator is None else chunking.summarised_context(rows, generator.chunk_summary(F.col("content")))
    return out.withColumn("key", F.format_string("%s#%010d", F.col("doc_id").cast("string"), F.col("original_index")))


class ContextualStore:
    """Chunks with contexts, vectors and an index of words, in a collection of its own that is opened by name.

    Documents come in and go by single writes, which cost what these documents have; nothing is rebuilt.
    """

    def __init__(self, spark: SparkSession, root: str, name: str = "default", embedder: Embedder | None = None, reranker: Reranker | None = None, generator: Generator | None = None, analyze=T.tokens):
        self.collection = Collection(spark, root, f"{name}_contextual")
        self.embedder, self.reranker, self.generator, self.analyze = embedder or HashEmbedder(), reranker or CoverageReranker(), generator, analyze

    @property
    def chunks(self) -> DataFrame:
        return self.collection.read("clusters")

    @property
    def index(self) -> lexical.Index:
        return self.collection.index("cluster_postings", "key")

    # --- documents ---

    def insert_dataset(self, dataset: DataFrame, about: DataFrame | None = None) -> DataFrame:
        """Entries of documents come in and replace those of the same doc_id. ``about``: doc_id, filename, custom_metadata. Returns doc_id, chunks."""
        dataset = workspace.written(dataset.withColumn("doc_id", F.col("doc_id").cast("string")).where("doc_id is not null"), "entries")
        entries = dataset.select("doc_id", "pdf_path", F.size("chunks").cast("long").alias("chunks"))
        return self._insert(self._embedded(contextual_chunks(dataset, self.generator)), lambda rows: entries, about)

    def _embedded(self, rows: DataFrame) -> DataFrame:
        if "terms" in rows.columns and self.generator is None:  # the text has the content twice, and the page
            return rows.withColumn("embedding", self.embedder.embed_terms((F.col("terms"), 2), (T.tokens("page_info"), 1))).drop("terms")
        return rows.withColumn("embedding", self.embedder.embed(F.col("text_to_embed"))).drop("terms")

    def _insert(self, rows: DataFrame, entries: Callable[[DataFrame], DataFrame], about: DataFrame | None, ordered: tuple[str, ...] = ()) -> DataFrame:
        """``entries`` makes doc_id, pdf_path and chunks of the rows once these are in the collection, where they are written once."""
        found: list[DataFrame] = []

        def postings(done: Callable[[str], DataFrame]) -> DataFrame:
            # without a summary the context is the content and the page, whose terms are known then
            made_of = {"contextualized_content": ["content", "page_info"]} if self.generator is None and self.analyze in lexical.BY_TERMS else None
            made = lexical.index(done("clusters"), "key", list(FIELDS), self.analyze, owner="doc_id", made_of=made_of)
            return made.rows.withColumn("shard", lexical.shard())

        def registry(done: Callable[[str], DataFrame]) -> DataFrame:
            own = workspace.written(entries(done("clusters")), "entries")
            found.append(own)
            named = about if about is not None else own.select("doc_id", F.element_at(F.split("pdf_path", "/"), -1).alias("filename"), F.lit(None).cast("map<string,string>").alias("custom_metadata"))
            return own.join(named, "doc_id", "left").withColumn("inserted_at", F.current_timestamp())

        self.collection.replace(lambda done: found[0], ordered, clusters=rows, cluster_postings=postings, registry=registry)
        return found[0].select("doc_id", "chunks")

    def insert_pages(self, pages: DataFrame, metadata: dict[str, str] | None = None) -> DataFrame:
        """``pages``: doc_id, filename, page, text. Returns doc_id, chunks of the documents that have any."""
        good = pages.where("error is null") if "error" in pages.columns else pages
        chunks = cluster_chunks(good, self.embedder, terms=True).where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("string"))
        rows = self._embedded(with_contexts(chunks.withColumn("original_uuid", F.col("doc_id")), self.generator))
        paths = good.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.min("filename").alias("pdf_path"))
        entries = lambda rows: rows.groupBy("doc_id").agg(F.count("*").alias("chunks")).join(paths, "doc_id", "left").select("doc_id", "pdf_path", "chunks")
        meta = F.create_map(*[F.lit(x) for kv in metadata.items() for x in kv]) if metadata else F.lit(None).cast("map<string,string>")
        about = pages.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.min("filename").alias("filename")).withColumn("custom_metadata", meta)
        return self._insert(rows, entries, about, ordered=("clusters",))

    # --- search ---

    def _vectors(self, asked: DataFrame) -> DataFrame:
        return asked.select("qid", self.embedder.embed(F.col("query")).alias("vector"))

    def search(self, asked: DataFrame, k: int = 20) -> DataFrame:
        """Dense hits: qid, key, score, rank; equal scores rank by falling place."""
        return dense.nearest(self.chunks, workspace.written(self._vectors(asked), "queries"), k, key="key")

    def search_bm25(self, asked: DataFrame, k: int = 20) -> DataFrame:
        return lexical.search_index(self.index, asked, k, FIELDS, self.analyze)

    def search_weighted(self, asked: DataFrame, k: int, semantic_weight: float = 0.7, bm25_weight: float = 0.3, recall: int = 150) -> DataFrame:
        return fusion.weighted_reciprocal(self.search(asked, recall), self.search_bm25(asked, recall), ["key"], k, semantic_weight, bm25_weight)

    def with_chunks(self, hits: DataFrame) -> DataFrame:
        return hits.join(self.chunks.drop("embedding"), "key")

    def retrieve_rerank(self, asked: DataFrame, k: int, multiplier: int = 10) -> DataFrame:
        rows = self.with_chunks(self.search(asked, k * multiplier).drop("score")).join(asked.select("qid", "query"), "qid")
        return resolve.rerank_chunks(rows, k, self.reranker.score(F.col("query"), chunking.rerank_text("content")), "key")


def create_rag_system(dataset: DataFrame, embedder: Embedder | None = None, reranker: Reranker | None = None, generator: Generator | None = None, analyze=T.tokens, root: str | None = None, name: str = "default") -> ContextualStore:
    """A store over the entries, under ``root``; without one it is new, in the folder of intermediate tables, and goes when Python ends."""
    spark = dataset.sparkSession
    store = ContextualStore(spark, root or workspace.new_folder(spark, "store"), name, embedder, reranker, generator, analyze)
    store.insert_dataset(dataset)
    return store
