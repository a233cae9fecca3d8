"""Fusion of ranked lists: full outer joins of ``qid, key, rank, score`` tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_ranks(ranked: DataFrame, key: str) -> DataFrame:
    """One row a key: a list that repeats it counts its first place."""
    return ranked.groupBy("qid", key).agg(F.min("rank").alias("rank"))


def rrf(dense: DataFrame, sparse: DataFrame, key: str, k: int, k_rrf: int = 60, w_dense: float = 1.0, w_sparse: float = 1.0) -> DataFrame:
    """Reciprocal rank fusion; ties keep the dense order, then the sparse one. Returns qid, key, rrf_score, rank."""
    d = first_ranks(dense, key).withColumnRenamed("rank", "dr")
    s = first_ranks(sparse, key).withColumnRenamed("rank", "sr")
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (F.lit(float(k_rrf)) + F.col(r)), F.lit(0.0))
    both = d.join(s, ["qid", key], "full").withColumn("rrf_score", part(w_dense, "dr") + part(w_sparse, "sr"))
    order = Window.partitionBy("qid").orderBy(F.desc("rrf_score"), F.asc_nulls_last("dr"), F.asc("sr"))
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", key, "rrf_score", "rank")


def fold(lists: list[DataFrame], key: str, k: int, k_rrf: int = 60) -> DataFrame:
    """Lists fused one after the other, each time against the merged list; later ones weigh more."""
    out = lists[0]
    for later in lists[1:]:
        out = rrf(out, later, key, 1 << 30, k_rrf)
    return out.where(F.col("rank") <= k)


def fold_rows(rows: DataFrame, key: str, k: int, k_rrf: int = 60) -> DataFrame:
    """``fold`` of lists that are rows of one table: qid, n (the list's place), key, rrf_score, rank. A query's lists are folded in one group, which they bound."""
    kind, qkind = (rows.schema[c].dataType.simpleString() for c in (key, "qid"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        merged = None
        for _, own in g.groupby("n", sort=True):
            own = own.sort_values("rank").drop_duplicates(key)[[key, "rank", "rrf_score"]]
            if merged is None:
                merged = own
                continue
            both = merged[[key, "rank"]].merge(own[[key, "rank"]], on=key, how="outer", suffixes=("_d", "_s"))
            both["rrf_score"] = (1.0 / (float(k_rrf) + both["rank_d"])).fillna(0.0) + (1.0 / (float(k_rrf) + both["rank_s"])).fillna(0.0)
            both = both.sort_values(["rrf_score", "rank_d", "rank_s"], ascending=[False, True, True], na_position="last")
            merged = both[[key, "rrf_score"]].assign(rank=np.arange(1, len(both) + 1))
        merged = merged[merged["rank"] <= k]
        return pd.DataFrame({"qid": [g["qid"].iloc[0]] * len(merged), key: merged[key].to_numpy(), "rrf_score": merged["rrf_score"].to_numpy(float), "rank": merged["rank"].to_numpy("int32")})

    return rows.select("qid", "n", key, "rrf_score", "rank").groupBy("qid").applyInPandas(run, f"qid {qkind}, {key} {kind}, rrf_score double, rank int")


def rrf_many(lists: list[DataFrame], key: str, k: int, k_rrf: int = 60) -> DataFrame:
    """All lists at once: the option without the fold's preference for later lists."""
    rows = None
    for x in lists:
        one = first_ranks(x, key).select("qid", key, (F.lit(1.0) / (F.lit(float(k_rrf)) + F.col("rank"))).alias("part"))
        rows = one if rows is None else rows.union(one)
    out = rows.groupBy("qid", key).agg(F.sum("part").alias("rrf_score"))
    order = Window.partitionBy("qid").orderBy(F.desc("rrf_score"), F.asc(key))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def weighted_reciprocal(dense: DataFrame, sparse: DataFrame, keys: list[str], k: int, w_dense: float = 0.7, w_sparse: float = 0.3) -> DataFrame:
    """Weighted reciprocal ranks; ties by falling keys; the final score is the reciprocal of the final rank.

    Adds from_semantic and from_bm25, and the share of each list in a hit (1, or 0.5 if in both).
    """
    one = lambda x, name: x.groupBy("qid", *keys).agg(F.min("rank").alias(name))
    both = one(dense, "dr").join(one(sparse, "sr"), ["qid", *keys], "full")
    weight = F.coalesce(F.lit(w_dense) / F.col("dr"), F.lit(0.0)) + F.coalesce(F.lit(w_sparse) / F.col("sr"), F.lit(0.0))
    both = both.withColumn("weight", F.round(weight, 12))
    order = Window.partitionBy("qid").orderBy(F.desc("weight"), *[F.desc(c) for c in keys])
    out = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    share = lambda own, other: F.when(F.col(own).isNull(), F.lit(0.0)).when(F.col(other).isNull(), F.lit(1.0)).otherwise(F.lit(0.5))
    return out.select(
        "qid", *keys, "rank", (F.lit(1.0) / F.col("rank")).alias("score"), F.col("dr").isNotNull().alias("from_semantic"), F.col("sr").isNotNull().alias("from_bm25"), share("dr", "sr").alias("semantic_share"), share("sr", "dr").alias("bm25_share")
    )


def provenance(hybrid: DataFrame) -> DataFrame:
    """Percentages of the hits that each list gave; 0 without hits."""
    n = F.count("*")
    percent = lambda c: F.coalesce(F.sum(c) * 100 / F.nullif(n, F.lit(0)), F.lit(0.0))
    return hybrid.agg(percent("semantic_share").alias("semantic_percent"), percent("bm25_share").alias("bm25_percent"), n.alias("n_results"))
