"""Benchmark decontamination by size-partitioned MinHash containment search (DataFrame operations only).

Texts are reduced to words of letters and digits in lower case, and to the distinct shingles of
five of these words (a text of fewer words is one shingle, its whole sequence). A document is
contaminated by an item if it has at least 75 % of the item's shingles, wherever they stand.

Items are partitioned by the size of their sets, in powers of two. A partition of sizes up to U
keeps of each item a bottom-k MinHash sketch with k = U/4 + 1: the k shingles of the smallest hash.
An item of n <= U shingles of which a document lacks at most n/4 cannot lack more than n/4 of the k
sketched ones, so a document, long or short, that has k - n/4 hashes of the sketch makes a candidate
pair, and none is lost: one hash for the largest items of a partition, the more the smaller an item
is. Candidates are verified by exact containment of the shingles themselves.

Null texts count as empty. Empty items contaminate nothing. Rows that share a doc_id are judged
one by one, and the id gets the highest containment; rows without doc_id take part, with a null id
in the result. The same holds for items. Empty tables of either kind give an empty result. Texts are of
any length. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm import scratch

WIDTH, PERCENT = 5, 75
#: Sketched hashes that may be broadcast (16 bytes each); beyond it the join is shuffled.
BROADCAST_HASHES = 1_000_000


def words(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.array_remove(F.split(plain, " "), "")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def shingles(text: Column) -> Column:
    """Distinct shingles as text."""
    whole = lambda w: F.array(F.array_join(w, " "))
    each = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - WIDTH + 1), lambda i: F.array_join(F.slice(w, i, WIDTH), " "))
    none = F.array().cast("array<string>")
    return F.array_distinct(_let(words(text), lambda w: F.when(F.size(w) >= WIDTH, each(w)).when(F.size(w) > 0, whole(w)).otherwise(none)))


def shingle_hashes(text: Column) -> Column:
    """``xxhash64`` of the shingles as text, repeated ones too."""
    whole = lambda w: F.array(F.xxhash64(F.array_join(w, " ")))
    each = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - WIDTH + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, WIDTH), " ")))
    none = F.array().cast("array<bigint>")
    return _let(words(text), lambda w: F.when(F.size(w) >= WIDTH, each(w)).when(F.size(w) > 0, whole(w)).otherwise(none))


def sketch(items: DataFrame) -> DataFrame:
    """``items``: item_id, item_shingles. Returns item_id, hash, need: each item's bottom-k sketch, and how many of its hashes a document must have."""
    n = F.size("item_shingles")
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(n))).cast("int")
    k = F.least(n, F.floor(upper * (100 - PERCENT) / 100).cast("int") + 1)
    hashes = F.array_sort(F.transform("item_shingles", lambda x: F.xxhash64(x)))
    need = k - F.floor(n * (100 - PERCENT) / 100).cast("int")
    return items.where(n > 0).select("item_id", need.alias("need"), F.explode(F.slice(hashes, 1, k)).alias("hash"))


def contaminations(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per contaminating pair: doc_id, item_id, n_item_shingles, n_shared."""
    items = scratch.materialize(items.select(F.col("item_id").alias("item_id"), shingles(F.col("text")).alias("item_shingles")), "items")
    sketched = scratch.materialize(sketch(items), "sketch")
    if sketched.count() <= BROADCAST_HASHES:
        sketched = F.broadcast(sketched)
    probes = docs.select(F.col("doc_id").alias("doc_id"), F.explode(shingle_hashes(F.col("text"))).alias("hash"))
    # rows that share an id, or have none, count together, which can only add candidates
    hits = probes.join(sketched, "hash").groupBy("doc_id", "item_id").agg(F.count("*").alias("hits"), F.min("need").alias("need"))
    found = scratch.materialize(hits.where("hits >= need").select("doc_id", "item_id"), "candidates")
    ids = scratch.materialize(found.select("doc_id").distinct(), "candidates")
    # null ids match each other, as rows without an id take part
    held = ids.select(F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("d_null"))
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("d_null"))
    if ids.count() <= scratch.BROADCAST_KEYS:
        held = F.broadcast(held)
    rows = rows.join(held, ["d", "d_null"], "left_semi").select("doc_id", shingles(F.col("text")).alias("own"))
    rows = scratch.materialize(rows, "suspects")
    pairs = found.alias("p").join(rows.alias("r"), F.expr("p.doc_id <=> r.doc_id")).select("p.doc_id", "p.item_id", "r.own")
    pairs = pairs.alias("p").join(items.alias("i"), F.expr("p.item_id <=> i.item_id"))
    pairs = pairs.select("p.doc_id", "p.item_id", F.size("item_shingles").alias("n"), F.size(F.array_intersect("item_shingles", "own")).alias("shared"))
    pairs = pairs.where((F.col("n") > 0) & (F.col("shared") * 100 >= F.col("n") * PERCENT))
    best = pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct("shared", "n")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.n").cast("long").alias("n_item_shingles"), F.col("best.shared").cast("long").alias("n_shared"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that no item contaminates, with all their columns; rows without doc_id stay."""
    bad = scratch.materialize(contaminations(docs, items).select("doc_id").where("doc_id is not null").distinct(), "contaminated")
    return scratch.keyed_join(docs, bad, "doc_id", "left_anti")


# The same in DuckDB, over all pairs that share a shingle.
CONTAMINATIONS_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM dw),
bs AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM bw),
bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1)
SELECT doc_id, item_id, n AS n_item_shingles, count(*) AS n_shared
FROM ds JOIN bs USING (s) JOIN bn USING (item_id)
GROUP BY doc_id, item_id, n HAVING count(*) * 100 >= n * 75
"""
