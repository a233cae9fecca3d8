"""Child hits to parents, and what reranks parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.sources.workspace import dealt, written

#: Hits that may be broadcast (about 100 bytes each).
BROADCAST_HITS = 200_000


def resolve_parents(hits: DataFrame, children: DataFrame, parents: DataFrame) -> DataFrame:
    """``hits``: qid, chunk_id, rank. Parents in the order of their first child; unknown ones are dropped (see ``missing``).

    A parent without pages is on page 1, one without metadata has none.
    """
    # few hits go to the chunks and parents, which stay where they are
    hits = written(hits.select("qid", "chunk_id", "rank"), "hits")
    near = F.broadcast if hits.count() <= BROADCAST_HITS else lambda x: x
    first = near(hits).join(children.select("chunk_id", "parent_id"), "chunk_id").groupBy("qid", "parent_id").agg(F.min("rank").alias("first_rank"))
    parents = parents.withColumns({c: F.coalesce(c, F.lit(1)) for c in ("page_start", "page_end") if c in parents.columns})
    if "metadata" in parents.columns:
        parents = parents.withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    out = near(first).join(parents, "parent_id")
    order = Window.partitionBy("qid").orderBy("first_rank", "parent_id")
    return out.withColumn("parent_rank", F.row_number().over(order)).drop("first_rank")


def missing(hits: DataFrame, children: DataFrame, key: str = "chunk_id") -> DataFrame:
    """How many hits of each query name a chunk that is not there: qid, n_missing."""
    return hits.join(children.select(key).distinct(), key, "left_anti").groupBy("qid").agg(F.count("*").alias("n_missing"))


def rerank_chunks(ranked: DataFrame, k: int, score, key: str) -> DataFrame:
    """``ranked``: qid, key, rank and the chunk's columns. Best k by ``score``, fewer where there are fewer; equal scores keep their order."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("first_rank"))
    out = dealt(ranked.withColumnRenamed("rank", "first_rank")).withColumn("score", score)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("first_rank")


def fallback_score(rank: str = "parent_rank"):
    """Where no reranker answers: 1, and 0.05 less for each place."""
    return F.round(F.lit(1.0) - F.lit(0.05) * (F.col(rank) - 1), 9)


def rerank(ranked: DataFrame, k: int, score) -> DataFrame:
    """Best k by ``score`` (a column); equal scores keep their order. A query of which a score is null (its model failed) keeps its order, with ``fallback_score``."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("parent_rank"))
    scored = dealt(ranked).withColumn("score", score)
    failed = F.max(F.col("score").isNull()).over(Window.partitionBy("qid"))
    scored = scored.withColumn("failed", failed).withColumn("score", F.when(F.col("failed"), fallback_score()).otherwise(F.col("score"))).drop("failed")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rerank_fallback(ranked: DataFrame, k: int) -> DataFrame:
    """The first k with ``fallback_score``."""
    return ranked.where(F.col("parent_rank") <= k).withColumn("score", fallback_score()).withColumn("rank", F.col("parent_rank"))


def no_rerank(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.where(F.col("parent_rank") <= k).withColumn("score", F.lit(1.0)).withColumn("rank", F.col("parent_rank"))
