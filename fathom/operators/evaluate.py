"""pass@k over golden chunks, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import text as T


def golden(items: DataFrame) -> DataFrame:
    """qid, content of each golden pair that is there; the first document and chunk count if they repeat."""
    pairs = items.select("qid", F.posexplode("golden_chunk_uuids").alias("n", "pair"))
    pairs = pairs.select("qid", "n", F.get("pair", F.lit(0)).alias("uuid"), F.get("pair", F.lit(1)).cast("bigint").alias("index"))
    docs = items.select("qid", F.posexplode("golden_documents").alias("d", "doc")).select("qid", "d", F.col("doc.uuid").alias("uuid"), F.posexplode("doc.chunks").alias("c", "chunk"))
    first = docs.groupBy("qid", "uuid", F.col("chunk.index").alias("index")).agg(F.min(F.struct("d", "c", F.col("chunk.content").alias("content"))).alias("m"))
    return pairs.join(first, ["qid", "uuid", "index"]).select("qid", "n", F.col("m.content").alias("content"))


#: Words of a query by which its documents are looked up; the first and the last word may stand inside longer ones.
INNER = 5
#: Up to so many short queries are held against every document; more are looked up by their first letters.
FEW, LETTERS = 1_000, 8


def containing(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """``docs`` (content and other columns) with the ``qid`` of each query whose text (``query``) they contain.

    A document that contains a text has its inner words in a row, so documents and queries meet by a hash
    of ``INNER`` of them. Texts with too few words are held against all documents if they are few, and else meet those that
    have their first ``LETTERS`` letters (all, if fewer) somewhere.
    """
    w = T.words("query")
    cut = queries.select("qid", "query", F.slice(w, 2, INNER).alias("inner"), F.size(w).alias("n"))
    long, short = cut.where(F.col("n") >= INNER + 2), cut.where(F.col("n") < INNER + 2)
    keyed = long.select("qid", "query", F.xxhash64(F.array_join("inner", " ")).alias("h"))
    own = lambda x: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(x) - INNER + 1), lambda i: F.xxhash64(F.array_join(F.slice(x, i, INNER), " "))))
    rows = docs.withColumn("h", T.let(T.words("content"), lambda x: F.when(F.size(x) >= INNER, own(x)).otherwise(F.array().cast("array<bigint>"))))
    met = rows.withColumn("h", F.explode("h")).join(keyed, "h").where(F.contains("content", "query")).drop("h", "query")
    n = short.count()
    if n == 0:
        return met
    if n > FEW:
        return met.unionByName(_by_letters(docs, short.select("qid", "query")))
    return met.unionByName(docs.join(F.broadcast(short.select("qid", "query")), F.contains("content", "query")).drop("query"))


def _by_letters(docs: DataFrame, short: DataFrame) -> DataFrame:
    size = F.least(F.length("query"), F.lit(LETTERS))
    keyed = short.withColumn("size", size).withColumn("h", F.xxhash64("size", F.substring("query", F.lit(1), size)))
    sizes = [r.size for r in keyed.where("size is not null").select("size").distinct().collect()]  # LETTERS + 1 at most
    text = F.coalesce("content", F.lit(""))

    def grams(n: int):
        if n == 0:
            return F.array(F.xxhash64(F.lit(0), F.lit("")))
        places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(F.lit(n), F.substring(text, i, F.lit(n))))

    rows = docs.withColumn("h", F.explode(F.array_distinct(F.concat(*[grams(n) for n in sizes]) if sizes else F.array().cast("array<bigint>"))))
    return rows.join(keyed.select("qid", "query", "h"), "h").where(F.contains("content", "query")).drop("h", "query")


def pass_at_k(queries: DataFrame, gold: DataFrame, retrieved: DataFrame) -> DataFrame:
    """``queries``: qid; ``gold``: qid, content; ``retrieved``: qid, content.

    A golden chunk is found if a hit has the same text but for white space at its ends. Queries without
    gold count as 0. Returns pass_at_k in percent (null without queries), n_queries, n_found.
    """
    have = retrieved.select("qid", T.strip("content").alias("c")).distinct().withColumn("hit", F.lit(1))
    marked = gold.select("qid", T.strip("content").alias("c")).join(have, ["qid", "c"], "left")
    each = marked.groupBy("qid").agg((F.count("hit") / F.count("*")).alias("share"), F.count("hit").alias("found"))
    out = queries.select("qid").join(each, "qid", "left")
    return out.agg((F.sum(F.coalesce("share", F.lit(0.0))) / F.count("*") * 100).alias("pass_at_k"), F.count("*").alias("n_queries"), F.coalesce(F.sum("found"), F.lit(0)).alias("n_found"))
