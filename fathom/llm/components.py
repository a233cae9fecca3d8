"""Connected components by alternating large and small stars (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import scratch


def _key(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is its smallest node.

    Each turn moves every node towards the smallest node it can see; the number of turns grows
    with the logarithm of the longest path. Per turn only edge lists are shuffled, minima are
    pre-aggregated, and they are written before they are joined, which leaves Spark free to split
    the partition of a node with very many edges. Edges with a null end and loops are ignored.
    """
    u, v = F.col(a), F.col(b)
    now = scratch.materialize(
        edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "cc"
    )
    before = _key(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc")
        large = scratch.materialize(
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc"
        )
        first = scratch.materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc")
        small = large.join(first, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then = scratch.materialize(small.union(first.select("u", F.col("m").alias("v"))).distinct(), "cc")
        for x in (now, least, large, first):
            scratch.drop(x)
        now, after = then, _key(then)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
