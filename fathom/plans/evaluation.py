"""Evaluations of a contextual store: pass@k of dense, hybrid and reranked retrieval over golden chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fathom.operators import evaluate, fusion
from fathom.plans.contextual import ContextualStore

#: Queries that are run once before a hybrid evaluation.
WARM_UP = 10


def _passed(items: DataFrame, store: ContextualStore, hits: DataFrame) -> DataFrame:
    return evaluate.pass_at_k(items, evaluate.golden(items), store.with_chunks(hits).select("qid", "content"))


def evaluate_dense(items: DataFrame, store: ContextualStore, k: int = 20) -> DataFrame:
    """``items``: qid, query, golden_chunk_uuids, golden_documents. Returns pass_at_k (percent), n_queries, n_found."""
    return _passed(items, store, store.search(items, k))


def evaluate_hybrid(items: DataFrame, store: ContextualStore, k: int = 20, warm_up: int = WARM_UP) -> DataFrame:
    """Adds the percentages of hits from each side, over queries that have gold."""
    if warm_up:
        store.search_weighted(items.orderBy("qid").limit(warm_up), k).count()
    hits = store.search_weighted(items, k)
    golden = evaluate.golden(items).select("qid").distinct()
    return _passed(items, store, hits.select("qid", "key")).crossJoin(fusion.provenance(hits.join(golden, "qid", "left_semi")))  # one row each


def evaluate_reranked(items: DataFrame, store: ContextualStore, k: int = 20) -> DataFrame:
    hits = store.retrieve_rerank(items, k)
    return evaluate.pass_at_k(items, evaluate.golden(items), hits.select("qid", "content"))
