"""Near duplicates by HyperMinHash, with exact verification and components.

A document's set holds its distinct shingles of five words (with fewer words: the whole sequence as
one; without words: nothing). Two documents are linked where the Jaccard similarity of their sets
is 0.75 or more.

1. Documents with equal sets form a class; only one of each goes on.
2. Each of ``REGISTERS`` buckets has a hash function of its own and sees all shingles, so that short
   texts leave no bucket empty. Of the least hash a bucket keeps the count of leading zeros and
   ``MANTISSA`` bits after the first one: 16 bits in place of 64.
3. ``BANDS`` bands of compressed registers are hashed. A pair at similarity s shares a band with
   probability 1 - (1 - s^6)^64: all but 4 in a million at 0.75, and 0.4 % at 0.2.
4. In each band's groups all members are paired with the smallest one only. Pairs whose estimated
   similarity, corrected for registers that agree by chance, is clearly too low are dropped (five
   and a half standard errors below), the others are verified on their full sets.
5. Components of the links are found. Then, where a group still has members of different components,
   pairs across components are tried too, but for those whose sizes rule out the similarity; pairs
   within a component cannot change the result. So no link between components is lost.
6. Groups of more than ``LARGE`` members would make too many such pairs, so the shingles of their members
   are counted among these members. A pair of them that shares a shingle which at most ``RARE`` of them have
   is tried through that shingle. Any other pair of them shares at most the lesser number of its two texts'
   commoner shingles; where that is too few for the similarity, the pair is ruled out without being made.
   Smaller groups keep all members, and a pair with an end outside the large groups is never ruled out so.

Null texts count as empty: linked with nothing, kept. Rows without doc_id are linked with nothing:
component_id is null and kept is true. Rows that repeat a doc_id are one node: it is reached through
any of its texts; each of its rows gets the component of its text's class. An empty table gives an
empty one; texts of any length are read whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import scratch
from fathom.llm.components import connected_components

WIDTH, BANDS, ROWS, MANTISSA = 5, 64, 6, 10
REGISTERS = BANDS * ROWS
PERCENT = 75
#: Up to so many members of a group, or holders of a shingle, are paired; so pairs stay in proportion to members.
LARGE, RARE = 64, 64
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = {c: c + 32 for c in range(65, 91)}
#: Words whose hashes a worker keeps.
KEPT = 300_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_A = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
_B = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) + _ODD)


class Shingler:
    def __init__(self, width: int = WIDTH):
        self.width, self.known = width, {}

    def _hash(self, word: str) -> int:
        import xxhash

        found = self.known.get(word)
        if found is None:
            if len(self.known) > KEPT:
                self.known.clear()
            found = self.known[word] = xxhash.xxh64_intdigest(word.encode())
        return found

    def __call__(self, text: str) -> np.ndarray:
        """Distinct 64-bit hashes of the shingles, sorted."""
        words = _WORD.findall(text.translate(_UPPER))
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        h = np.fromiter((known.get(w) or self._hash(w) for w in words), np.uint64, len(words))
        width = min(self.width, len(h))
        n = len(h) - width + 1
        acc = np.full(n, np.uint64(width))
        for k in range(width):
            acc = mix(acc * _ODD + h[k : k + n])
        return np.unique(acc)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least hash in each bucket."""
    out = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 256):
        np.minimum(out, (hashes[at : at + 256, None] * _A + _B).min(axis=0), out=out)
    return out


def compress(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa bits of each least hash, in 16 bits."""
    part, exponent = np.frexp(np.maximum(least, np.uint64(1)).astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 63).astype(np.uint16)
    mantissa = ((part - 0.5) * 2 * (1 << MANTISSA)).astype(np.uint16)
    return (zeros << np.uint16(MANTISSA)) | mantissa


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One hash for each band; the band's number is part of it."""
    rows = registers.reshape(BANDS, ROWS).astype(np.uint64)
    acc = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        acc = mix(acc * _ODD + rows[:, k])
    return acc.view(np.int64)


def chance(n: int, m: int) -> float:
    """How often registers of disjoint sets of ``n`` and ``m`` shingles agree."""
    edges = 0.5 ** np.arange(65)
    of = lambda size: np.diff((1 - edges) ** size)
    return float((of(n) * of(m)).sum() / (1 << MANTISSA))


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> float:
    """Jaccard similarity from the registers, corrected for those that agree by chance."""
    c = chance(n, m)
    return (float(np.mean(a == b)) - c) / (1 - c)


LEAST_ESTIMATE = PERCENT / 100 - 5.5 * (0.75 * 0.25 / REGISTERS) ** 0.5


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact: 100 times the intersection is at least ``PERCENT`` times the union."""
    if min(len(a), len(b)) * 100 < PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= PERCENT * (len(a) + len(b) - both)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_key (of the set), bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for whole in batches:
            for at in range(0, len(whole), 1000):
                x = whole.iloc[at : at + 1000]
                sets = [shingler(t) for t in x["body"]]
                yield pd.DataFrame(
                    {
                        "doc_id": x["doc_id"].to_numpy(),
                        "no_id": x["no_id"].to_numpy(),
                        "n_shingles": [len(s) for s in sets],
                        "class_key": [class_key(s) for s in sets],
                        "bands": [band_keys(compress(minima(s))) if len(s) else np.zeros(0, np.int64) for s in sets],
                    }
                )

    out = _rows(docs).mapInPandas(run, "doc_id long, no_id boolean, n_shingles long, class_key binary, bands array<long>")
    return out.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("text"), F.lit("")).alias("body"))


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, size, registers, shingles`` of the rows whose ids are in ``nodes`` (a written table), written."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for whole in batches:
            for at in range(0, len(whole), 1000):
                x = whole.iloc[at : at + 1000]
                own = [shingler(t) for t in x["body"]]
                registers = [compress(minima(s)).tobytes() for s in own]
                yield pd.DataFrame({"node": x["doc_id"].to_numpy(), "size": [len(s) for s in own], "registers": registers, "shingles": [s.tobytes() for s in own]})

    rows = _rows(docs).where("not no_id").select("doc_id", "body")
    known = scratch.keyed_join(rows, nodes, "doc_id", "left_semi").mapInPandas(sets, "node long, size long, registers binary, shingles binary")
    with scratch.small_batches(docs.sparkSession, 1000):
        return scratch.materialize(known, "sets")


def verified(known: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of nodes whose sets are similar, written; ``known`` is of ``sets_of``, ``pairs`` a written table.

    The registers are compared first, so that sets travel only for pairs that may be similar.
    """

    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            near = [estimate(np.frombuffer(ra, np.uint16), np.frombuffer(rb, np.uint16), n, m) >= LEAST_ESTIMATE for ra, rb, n, m in zip(x["ra"], x["rb"], x["na"], x["nb"], strict=True)]
            yield x.loc[near, ["a", "b"]]

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x.loc[[similar(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)) for s, t in zip(x["sa"], x["sb"], strict=True)], ["a", "b"]]

    def joined(rows: DataFrame, **columns: str) -> DataFrame:
        for end in ("a", "b"):
            side = known.select(F.col("node").alias(end), *[F.col(c).alias(short + end) for short, c in columns.items()])
            rows = rows.join(side, end)
        return rows

    spark = pairs.sparkSession
    with scratch.small_batches(spark, 2000):
        sized = joined(pairs, n="size", r="registers").where("na > 0 and nb > 0").where(_sizes("na", "nb"))
        near = scratch.materialize(sized.select("a", "b", "na", "nb", "ra", "rb").mapInPandas(guess, "a long, b long").distinct(), "near")
    with scratch.small_batches(spark, 256):
        links = scratch.materialize(joined(near, s="shingles").select("a", "b", "sa", "sb").mapInPandas(check, "a long, b long").distinct(), "links")
    scratch.drop(near)
    return links


def _sizes(n: str, m: str) -> str:
    """Sets of these sizes can be similar."""
    return f"least({n}, {m}) * 100 >= {PERCENT} * greatest({n}, {m})"


def joined_by(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components of ``found`` and further links together, written."""
    edges = found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links.select("a", "b"))
    return scratch.materialize(connected_components(edges), "components")


def still_mixed(member: DataFrame, found: DataFrame) -> DataFrame:
    """``key, node, size, label`` of the groups that have members of different components, written."""
    out = scratch.materialize(member.join(found, "node", "left").select("key", "node", "size", F.coalesce("component", "node").alias("label")), "members")
    mixed = scratch.materialize(out.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key"), "mixed")
    kept = scratch.materialize(out.join(mixed, "key"), "members")
    scratch.drop(out)
    return kept


def counted(member: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ``key`` of large groups, and for their members: ``node, common`` and the pairs ``a, b`` that share a rare shingle, all written.

    ``common`` is the number of a node's shingles (of all its texts, where it has several) that more than ``RARE`` of these members have.
    """

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x.assign(shingle=[np.frombuffer(s, np.int64) for s in x["shingles"]]).drop(columns="shingles")

    large = scratch.materialize(member.groupBy("key").count().where(F.col("count") > LARGE).select("key"), "large")
    nodes = scratch.materialize(member.join(large, "key").select("node", "label").distinct(), "crowd")
    with scratch.small_batches(member.sparkSession, 256):
        rows = known.join(nodes, "node").select("node", "label", "size", "shingles").mapInPandas(spread, "node long, label long, size long, shingle array<long>")
        rows = scratch.materialize(rows.withColumn("shingle", F.explode("shingle")), "shingles")
    held = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("one")).where(F.col("n") <= RARE)
    held = scratch.materialize(held, "held")
    shared = scratch.materialize(rows.join(held.where("n > 1").select("shingle"), "shingle"), "shared")
    rare = held.where("n = 1").select(F.col("one").alias("node")).union(shared.select("node")).groupBy("node").agg(F.count("*").alias("rare"))
    sizes = rows.groupBy("node").agg(F.count("*").alias("size"))
    common = scratch.materialize(sizes.join(rare, "node", "left").select("node", (F.col("size") - F.coalesce("rare", F.lit(0))).alias("common")), "common")
    x, y = shared.alias("x"), shared.alias("y")
    pairs = x.join(y, F.expr("x.shingle = y.shingle and x.label < y.label and " + _sizes("x.size", "y.size")))
    pairs = scratch.materialize(_ordered(pairs), "pairs")
    for table in (rows, held, shared):
        scratch.drop(table)
    return large, common, pairs


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.expr("least(x.node, y.node)").alias("a"), F.expr("greatest(x.node, y.node)").alias("b")).distinct()


def class_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def without_classes(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and class are not in ``dropped`` (``doc_id, class_key``, a written table)."""

    @F.pandas_udf("binary")
    def key(bodies: pd.Series) -> pd.Series:
        shingler = Shingler()
        return pd.Series([class_key(shingler(t)) for t in bodies])

    own = scratch.unused(docs, "class_key")
    return docs.withColumn(own, key(F.coalesce("text", F.lit("")))).join(dropped.select(F.col("doc_id"), F.col("class_key").alias(own)), ["doc_id", own], "left_anti").select(*docs.columns)


def near_duplicates(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable), kept, n_links; ``keyed`` adds class_key.

    ``n_links`` counts verified links of the row's class; links within a component that are not
    needed to find it are not tried.
    """
    with scratch.small_batches(docs.sparkSession, 1000):
        all_rows = scratch.materialize(sketches(docs), "sketches")
    linked = all_rows.where("n_shingles > 0 and doc_id is not null")
    classes = linked.groupBy("class_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"))
    classes = scratch.materialize(classes, "classes")
    bands = classes.select("node", "size", F.explode("bands").alias("key"))
    groups = bands.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last")
    groups = scratch.materialize(groups.select("key", "hub"), "groups")
    member = scratch.materialize(bands.join(groups, "key"), "members")
    tried = scratch.materialize(member.where("node > hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    known = sets_of(docs, scratch.materialize(member.select(F.col("node").alias("doc_id")).distinct(), "nodes"))
    links = verified(known, tried)
    found = scratch.materialize(connected_components(links), "components")
    member = still_mixed(member.drop("hub"), found)
    large, common, by_rare = counted(member, known)
    # common is null outside the large groups; a member with few common shingles leaves the large groups only
    member = member.join(common, "node", "left").join(large.withColumn("large", F.lit(True)), "key", "left")
    member = scratch.materialize(member.where(f"large is null or common * 100 >= {PERCENT} * size").drop("large"), "members")
    x, y = member.alias("x"), member.alias("y")
    enough = f"(x.common is null or y.common is null or least(x.common, y.common) * {100 + PERCENT} >= {PERCENT} * (x.size + y.size))"
    rest = _ordered(x.join(y, F.expr(f"x.key = y.key and x.label < y.label and {_sizes('x.size', 'y.size')} and {enough}")))
    rest = scratch.materialize(rest.union(by_rare).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        new = verified(known, rest)
        links = links.union(new)
        found = joined_by(found, new)
    count = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    of_class = classes.select("class_key", "node").join(found, "node", "left").join(count, "node", "left")
    of_class = scratch.materialize(of_class.select("class_key", F.coalesce("component", "node").alias("component"), "n_links"), "classes")
    out = all_rows.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("class_key")).alias("class_key"))
    out = out.join(of_class, "class_key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), *["class_key"] * keyed)


# The components in DuckDB, over all pairs that share a shingle; copies of a set are one node.
COMPONENTS_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{''.join(map(chr, _UPPER))}', '{''.join(map(chr, _UPPER.values()))}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {WIDTH} THEN list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
k AS (SELECT doc_id, len(s) AS n, sha256(array_to_string(s, chr(10))) AS k, s FROM s),
c AS (SELECT k, min(doc_id) AS node, any_value(n) AS n, any_value(s) AS s FROM k WHERE n > 0 GROUP BY k),
x AS (SELECT node, n, unnest(s) AS sh FROM c),
pair AS (SELECT a.node AS a, b.node AS b FROM x a JOIN x b ON a.sh = b.sh AND a.node < b.node AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
edge AS (SELECT a, b FROM pair UNION SELECT b, a FROM pair),
reach AS (SELECT node AS a, node AS b FROM c UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY 1)
SELECT doc_id, k.n AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM k LEFT JOIN c ON c.k = k.k AND k.n > 0 LEFT JOIN comp USING (node)
"""
