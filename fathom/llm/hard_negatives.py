"""Hard negatives by dual-tree search: trees over anchors and over candidates, whole groups against each other.

For each anchor its first positives (rows of its label with the highest inner products) are found, and for each
of these the first rows of other labels whose score lies in a band below that of the positive. Both are the same search: the
k best candidates of each of an anchor's bands [low, high].

Candidates and anchors are ordered along a tree of halvings and packed into blocks; every node has a box and a ball
around its vectors. For two nodes these give an interval that no inner product of theirs leaves. If the interval's upper end is below
what each anchor of the node still needs, or its lower end above all its bands, all anchors of the node are done with all
candidates of the other at once; only pairs of leaves are scored, exactly, in integers. The first test is a join of the blocks'
balls, so that blocks that nobody needs are not moved; the rest happens in tasks. Each task
has some blocks of anchors, and the blocks of candidates come to it one after another, those of the highest intervals first; what an anchor
needs rises with what it has found. A task hands on the best k of each band alone.

The upper part of the tree, which names the blocks, is learned from at most ``SAMPLE`` rows, those of the smallest hash; the
result does not depend on it. Groups of rows that fall together (copies of one vector, a common label) are
dealt out by a hash into blocks of bounded size.

Components become floor(scale * x), and are held within +-2^20, so that products are exact in double precision; shorter vectors
end in zeros. Rows with a null key, label or vector, or a null or non-finite component, take no part; an empty vector has score 0 with
all others. Rows are told apart by themselves: an anchor that is there twice gets its results twice, and its copy is an
"other row". Higher scores come first, ties by the smaller key; copies of one key that tie are alike in the result. An empty
table, or one without anchors, gives an empty one. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm import scratch

#: Rows that the upper part of the tree is learned from.
SAMPLE = 8_192
#: Rows in a block of candidates: a sixty-fourth of all, within these bounds; and in a block of anchors, at most.
LEAST, MOST, ANCHORS = 1_024, 16_384, 4_096
#: Rows in a leaf of anchors, and of candidates.
LEAF_A, LEAF_C = 32, 128
#: Components and scores are beyond these nowhere.
BOUND, NONE, ALL = 1 << 20, -(1 << 62), 1 << 62
#: Cells that the balls of anchor blocks are dealt into for the first test, blocks a cell.
CELL = 256

# --- trees ---


def _halves(x: np.ndarray) -> tuple[np.ndarray, float]:
    """A direction between two far points, and the median along it."""
    a = x[np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1))]
    b = x[np.argmax(((x - a) ** 2).sum(axis=1))]
    direction = b - a
    return direction, float(np.median(x @ direction))


def learn_paths(x: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level the directions and cuts of its nodes, from a sample."""
    levels, parts = [], [x]
    for _ in range(depth):
        cuts = [_halves(p) if len(p) > 1 else (np.zeros(x.shape[1]), 0.0) for p in parts]
        levels.append((np.array([d for d, _ in cuts]), np.array([t for _, t in cuts])))
        parts = [q for p, (d, t) in zip(parts, cuts, strict=True) for right in (False, True) for q in (p[(p @ d > t) == right],)]
    return levels


def paths(x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    for directions, cuts in levels:
        node = 2 * node + ((x * directions[node]).sum(axis=1) > cuts[node])
    return node


def tree_order(x: np.ndarray, leaf: int) -> np.ndarray:
    """Rows in the order of a tree of exact halvings: node t of a level has the t-th part of the rows."""
    x, parts = x.astype(float), [np.arange(len(x))]
    while max(map(len, parts)) > leaf:
        cut = []
        for p in parts:
            if len(p) > 1:
                direction, _ = _halves(x[p])
                p = p[np.argsort(x[p] @ direction, kind="stable")]
            cut += [p[: len(p) // 2], p[len(p) // 2 :]]
        parts = cut
    return np.concatenate(parts)


class Tree:
    """Levels from the root to the leaves over rows in the order of ``tree_order``: the rows, box and ball of each node."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.x, edges = x, np.array([0, len(x)])
        self.levels = []
        while True:
            begin, size = edges[:-1], np.diff(edges)
            centre = np.add.reduceat(x, begin, axis=0) / size[:, None]
            far = np.sqrt(((x - np.repeat(centre, size, axis=0)) ** 2).sum(axis=1))
            self.levels.append((edges, np.minimum.reduceat(x, begin, axis=0), np.maximum.reduceat(x, begin, axis=0), centre, np.maximum.reduceat(far, begin), np.sqrt((centre**2).sum(axis=1))))
            if size.max() <= leaf or size.min() < 2:
                return
            edges = np.append(np.stack([begin, begin + size // 2], 1).ravel(), len(x))

    def leaves(self) -> np.ndarray:
        return self.levels[-1][0]


def intervals(a: Tree, c: Tree, la: int, lc: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of nodes of two levels: bounds of all inner products, the tighter ones of boxes and balls."""
    _, alo, ahi, acentre, aradius, anorm = (v[i] if n else v for n, v in enumerate(a.levels[la]))
    _, clo, chi, ccentre, cradius, cnorm = (v[j] if n else v for n, v in enumerate(c.levels[lc]))
    corners = np.stack([alo * clo, alo * chi, ahi * clo, ahi * chi])
    mid, slack = (acentre * ccentre).sum(axis=1), aradius * cnorm + cradius * anorm + aradius * cradius
    slack = slack * (1 + 1e-9) + 1
    return np.maximum(corners.min(axis=0).sum(axis=1), mid - slack), np.minimum(corners.max(axis=0).sum(axis=1), mid + slack)


# --- the search in a task ---


@dataclass
class Anchors:
    """A block of anchors with their bands, and the best that was found for each."""

    row: np.ndarray
    label: np.ndarray
    tree: Tree
    low: np.ndarray
    high: np.ndarray
    score: np.ndarray
    key: np.ndarray
    pairs: int = 0

    @staticmethod
    def of(row, label, x, low, high, k: int) -> Anchors:
        shape = (*low.shape, k)
        return Anchors(row, label, Tree(x, LEAF_A), low, high, np.full(shape, NONE), np.full(shape, ALL))

    def need(self) -> np.ndarray:
        """The lowest score that can still enter each band; bands that are not there need what nobody has."""
        return np.maximum(self.low, self.score[:, :, -1])

    def meet(self, row: np.ndarray, key: np.ndarray, label: int, tree: Tree, same: bool) -> None:
        """All candidates of a block, which have one label; ``same``: anchors of this label search it, or all others."""
        need, high = self.need().min(axis=1), self.high.max(axis=1)
        off = (self.label == label) != same
        need, high = np.where(off, ALL, need), np.where(off, NONE, high)
        i, j, la, lc = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
        last_a, last_c = len(self.tree.levels) - 1, len(tree.levels) - 1
        while len(i):
            begin = self.tree.levels[la][0][:-1]
            lo, hi = intervals(self.tree, tree, la, lc, i, j)
            ok = (hi >= np.minimum.reduceat(need, begin)[i]) & (lo <= np.maximum.reduceat(high, begin)[i])
            i, j = i[ok], j[ok]
            if la == last_a and lc == last_c:
                break
            # the deeper trees' levels first, so that both end together
            down_a, down_c = la < last_a and last_a - la >= last_c - lc, lc < last_c and last_c - lc >= last_a - la
            if down_a:
                i, j, la = np.concatenate([2 * i, 2 * i + 1]), np.concatenate([j, j]), la + 1
            if down_c:
                i, j, lc = np.concatenate([i, i]), np.concatenate([2 * j, 2 * j + 1]), lc + 1
        edges_a, edges_c = self.tree.leaves(), tree.leaves()
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        for leaf in np.unique(i):
            mine = slice(edges_a[leaf], edges_a[leaf + 1])
            near = j[np.searchsorted(i, leaf) : np.searchsorted(i, leaf, "right")]
            at = np.concatenate([np.arange(edges_c[n], edges_c[n + 1]) for n in near])
            self._score(mine, row[at], key[at], tree.x[at], off[mine])

    def _score(self, mine: slice, row: np.ndarray, key: np.ndarray, x: np.ndarray, off: np.ndarray) -> None:
        found = (self.tree.x[mine] @ x.T).astype(np.int64)
        self.pairs += found.size
        need, high = self.need()[mine], self.high[mine]
        ok = (found >= need.min(axis=1)[:, None]) & (found <= high.max(axis=1)[:, None]) & ~off[:, None]
        a, c = np.nonzero(ok)
        other = row[c] != self.row[mine][a]
        a, c = a[other], c[other]
        s, name = found[a, c], key[c]
        order = np.lexsort((name, -s, a))
        a, s, name = a[order], s[order], name[order]
        k = self.score.shape[2]
        for band in range(need.shape[1]):
            fits = (s >= need[a, band]) & (s <= high[a, band])
            if not fits.any():
                continue
            who, own, names = a[fits], s[fits], name[fits]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            first = place < k
            fresh, fresh_key = np.full((len(need), k), NONE), np.full((len(need), k), ALL)
            fresh[who[first], place[first]], fresh_key[who[first], place[first]] = own[first], names[first]
            score, names = np.concatenate([self.score[mine, band], fresh], 1), np.concatenate([self.key[mine, band], fresh_key], 1)
            best = np.lexsort((names, -score), axis=1)[:, :k]
            self.score[mine, band], self.key[mine, band] = np.take_along_axis(score, best, 1), np.take_along_axis(names, best, 1)

    def rows(self) -> pd.DataFrame:
        a, band, n = np.nonzero(self.score > NONE)
        return pd.DataFrame({"anchor": self.row[a], "band": band.astype(np.int32), "key": self.key[a, band, n], "score": self.score[a, band, n]})


# --- blocks ---

PACKED = "block string, label long, n int, wide boolean, rows binary, keys binary, labels binary, x binary, low binary, high binary, bands int, centre array<double>, radius double, norm double, need long, most long"


def _pack(name: str, g: pd.DataFrame, leaf: int, label: int | None) -> pd.DataFrame:
    x = np.stack(g["q"].to_numpy()).astype(np.int64)
    order = tree_order(x, leaf)
    g, x = g.iloc[order], x[order]
    wide = bool(np.abs(x).max(initial=0) > 32767)
    flat = lambda c: g[c].to_numpy(np.int64).tobytes()
    centre = x.mean(axis=0)
    radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
    out = {"block": name, "label": label, "n": len(g), "wide": wide, "rows": flat("row"), "keys": flat("key"), "labels": flat("label"), "x": x.astype(np.int32 if wide else np.int16).tobytes(), "low": b"", "high": b"", "bands": 0, "centre": centre, "radius": radius, "norm": float(np.sqrt(centre @ centre)), "need": NONE, "most": ALL}
    if "low" in g:
        low, high = np.stack(g["low"].to_numpy()).astype(np.int64), np.stack(g["high"].to_numpy()).astype(np.int64)
        out |= {"low": low.tobytes(), "high": high.tobytes(), "bands": low.shape[1], "need": int(low.min()), "most": int(high.max())}
    return pd.DataFrame([out])


def _unpack(r) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at = lambda b: np.frombuffer(b, np.int64)
    return at(r.rows), at(r.keys), at(r.labels), np.frombuffer(r.x, np.int32 if r.wide else np.int16).reshape(r.n, -1).astype(float)


def pack(rows: DataFrame, depth: int, size: int, leaf: int, by_label: bool) -> DataFrame:
    """Blocks of about ``size`` rows, of one label each or of any; ``rows`` is a written table with ``path``, of ``depth`` levels.

    A part of the data takes as many levels of the path as it has halves of this size; what still falls
    together beyond it is dealt out by a hash of the row.
    """
    part = ["label"] if by_label else []
    rows = rows.join(rows.groupBy("label").agg(F.count("*").alias("n")), "label") if by_label else rows.withColumn("n", F.lit(rows.count()))
    levels = F.least(F.lit(depth), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("n"), F.lit(1)) / F.lit(float(size))))))
    rows = rows.withColumn("node", F.floor(F.col("path") / F.pow(F.lit(2.0), F.lit(depth) - levels)).cast("long")).drop("n", "path")
    keys = [*part, "node"]
    pieces = rows.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("pieces"))
    rows = rows.join(pieces, keys).withColumn("piece", F.pmod(F.xxhash64("row"), F.col("pieces"))).drop("pieces")

    def packed(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return _pack("-".join(map(str, key)), g, leaf, int(key[0]) if by_label else None)

    return rows.groupBy(*keys, "piece").applyInPandas(packed, PACKED)


def search(anchors: DataFrame, blocks: DataFrame, k: int, same: bool) -> DataFrame:
    """anchor (row), band, key, score: the best ``k`` of each band; written tables of ``pack``.

    ``same``: anchors meet blocks of their own label, and lie in blocks of one label; else blocks of all other labels.
    """
    spark = blocks.sparkSession
    ball = lambda df, p, *more: df.select(F.col("block").alias(f"{p}block"), F.col("label").alias(f"{p}label"), F.col("centre").alias(f"{p}centre"), F.col("radius").alias(f"{p}radius"), F.col("norm").alias(f"{p}norm"), *more)
    a, c = ball(anchors, "a_", "need", "most"), ball(blocks, "c_")
    n_anchors = anchors.count()
    if same:
        pairs = a.join(c, F.col("a_label") == F.col("c_label"))
    else:
        cells = max(1, -(-n_anchors // CELL))
        pairs = a.withColumn("cell", F.pmod(F.xxhash64("a_block"), F.lit(cells))).join(c.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))), "cell")
    mid = F.aggregate(F.zip_with("a_centre", "c_centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    slack = (F.col("a_radius") * F.col("c_norm") + F.col("c_radius") * F.col("a_norm") + F.col("a_radius") * F.col("c_radius")) * (1 + 1e-9) + 1
    pairs = pairs.withColumns({"mid": mid, "slack": slack}).where((F.col("mid") + F.col("slack") >= F.col("need")) & (F.col("mid") - F.col("slack") <= F.col("most")))
    slices = max(1, min(256, -(-4 * spark.sparkContext.defaultParallelism // max(1, n_anchors))))
    pairs = pairs.select("a_block", F.col("c_block").alias("block"), F.pmod(F.xxhash64("c_block"), F.lit(slices)).cast("int").alias("slice"), (-F.col("mid") - F.col("slack")).alias("place"))
    body = ["label", "n", "wide", "rows", "keys", "labels", "x", "low", "high", "bands"]
    come = pairs.join(blocks.select("block", *body), "block").select("a_block", "slice", "place", *body)
    first = anchors.select(F.col("block").alias("a_block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(float("-inf")).alias("place"), *body)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                row, key, label, x = _unpack(r)
                if (r.a_block, r.slice) != now:  # its anchors come before all others
                    if held is not None:
                        yield held.rows()
                    band = lambda b, r=r: np.frombuffer(b, np.int64).reshape(r.n, r.bands)
                    now, held = (r.a_block, r.slice), Anchors.of(row, label, x, band(r.low), band(r.high), k)
                else:
                    held.meet(row, key, int(r.label), Tree(x, LEAF_C), same)
        if held is not None:
            yield held.rows()

    tasks = max(1, min(20_000, n_anchors * slices))
    come = first.unionByName(come).repartition(tasks, "a_block", "slice").sortWithinPartitions("a_block", "slice", "place")
    found = come.mapInPandas(run, "anchor long, band int, key long, score long")
    order = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# --- the operator ---


def quantised(vectors: DataFrame, key: str, label: Column, vector: str, scale: float) -> DataFrame:
    """row, key, label, q of the rows that take part; written, so that row numbers stay."""
    x = F.col(vector).cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    held = F.transform(x, lambda v: F.floor(F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), F.lit(scale) * v))).cast("int"))
    rows = vectors.select(F.col(key).cast("long").alias("key"), label.cast("long").alias("label"), F.when(whole, held).alias("q"))
    return scratch.materialize(rows.where("key is not null and label is not null and q is not null").withColumn("row", F.monotonically_increasing_id()), "vectors")


def mine(vectors: DataFrame, anchor: Column, key: str = "vec_id", label: Column | str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor``: which rows are anchors, by the column ``key``. Negatives have ``low`` to ``high`` hundredths of the score of the positive.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, key, F.col(label) if isinstance(label, str) else label, vector, scale)
    n, wide = rows.agg(F.count("*"), F.max(F.size("q"))).first()
    size = max(LEAST, min(MOST, (n or 0) // 64))
    wide = max(1, wide or 0)
    depth = max(0, min(10, int(np.ceil(np.log2(max(1, n / size))))))
    padded = F.concat("q", F.array_repeat(F.lit(0), F.lit(wide) - F.size("q")))
    rows = rows.withColumn("q", padded)
    sample = scratch.least_by_hash(rows, "row", SAMPLE).select("q").collect() if depth else []  # bounded by SAMPLE
    levels = learn_paths(np.array([r.q for r in sample], float), depth) if sample else []
    depth = len(levels)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            step = max(1, 2_000_000 // wide)
            q = x["q"].to_numpy()
            yield x.assign(path=np.concatenate([paths(np.stack(q[i : i + step]).astype(float), levels) for i in range(0, len(q), step)]) if len(q) else np.zeros(0, np.int64))

    kept = scratch.materialize(rows.select("row", "key", "label", "q").mapInPandas(placed, "row long, key long, label long, q array<int>, path long"), "placed")
    blocks = scratch.materialize(pack(kept, depth, size, LEAF_C, True), "blocks")
    asked = scratch.materialize(kept.where(anchor), "anchors")
    any_score = lambda v: F.array(F.lit(v).cast("long"))
    own = scratch.materialize(pack(asked.withColumns({"low": any_score(NONE), "high": any_score(ALL)}), depth, ANCHORS, LEAF_A, True), "own")
    best = scratch.materialize(search(own, blocks, positives, True), "positives")
    # a band for each positive; bands that an anchor lacks take nothing
    up, down = F.ceil(F.col("score") * F.lit(low) / 100).cast("long"), F.floor(F.col("score") * F.lit(high) / 100).cast("long")
    bands = best.groupBy(F.col("anchor").alias("row")).agg(F.array_sort(F.collect_list(F.struct("rank", up.alias("low"), down.alias("high")))).alias("b"))
    fill = lambda c, v: F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.get(F.col(f"b.{c}"), i - 1), F.lit(v)))
    banded = scratch.materialize(asked.join(bands, "row").select("row", "key", "label", "q", "path", fill("low", ALL).alias("low"), fill("high", NONE).alias("high")), "banded")
    others = scratch.materialize(pack(banded, depth, ANCHORS, LEAF_A, False), "others")
    found = search(others, blocks, negatives, False).select("anchor", (F.col("band") + 1).alias("place"), "rank", F.col("key").alias("negative_id"), F.col("score").alias("negative_score"))
    first = best.select("anchor", F.col("rank").alias("place"), F.col("key").alias("positive_id"), F.col("score").alias("positive_score"))
    named = asked.select(F.col("row").alias("anchor"), F.col("key").alias("anchor_id"))
    return found.join(first, ["anchor", "place"]).join(named, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """The mined rows of ``embeddings``: labels of each seventh id are one off, each fiftieth id is an anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(embeddings, F.col("key") % 50 == 0, label=label)


#: ``hard_negatives`` in DuckDB's SQL, all anchors against all rows.
MINED_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
