"""Exact nearest neighbours by inner product, for tables of queries, and an embedder by feature hashing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import text as T

#: Numbers of queries that are broadcast, or that meet in a cell of the grid (8 bytes each).
BLOCK = 4_000_000
#: Rows of a block of the corpus, and of the queries; numbers of queries and hits that a task holds.
CORPUS_ROWS, QUERY_ROWS, HELD = 4096, 1024, 32_000_000
#: Numbers of a product of a piece of a batch and the query matrix, and rows of a piece that single precision looks at first.
PRODUCT, PIECE = 4_000_000, 512


def _best_each(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of each column with their keys, falling; equal scores by falling key."""
    if len(scores) > 4 * k:
        # whatever ties with the k-th score stays, at the price of columns of unequal length
        least = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
        most = int((scores >= least).sum(axis=0).max())
        if most < len(scores):
            at = np.argpartition(scores, len(scores) - most, axis=0)[len(scores) - most :]
            scores, keys = np.take_along_axis(scores, at, 0), np.take_along_axis(keys, at, 0)
    order = np.lexsort((keys, scores), axis=0)[::-1][:k]
    return np.take_along_axis(scores, order, 0), np.take_along_axis(keys, order, 0)


class _Best:
    """The ``k`` best of the corpus for a block of queries, by double precision to 6 digits.

    Once there are k, products in single precision are made first; those that may reach the k-th score, with all that single precision can be
    off by, are made again. Where many may (copies), all are.
    """

    def __init__(self, ids: list, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.single, self.norm = queries.astype(np.float32), np.sqrt(np.einsum("ij,ij->i", queries, queries))
        self.scores, self.keys, self.made = np.zeros((0, len(ids))), None, 0

    @property
    def held(self) -> int:
        return len(self.ids) * max(self.k, self.queries.shape[1])

    def add(self, vectors: np.ndarray, keys: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):  # of numbers that only double precision holds all is made again
            single, norm, at = vectors.astype(np.float32), np.sqrt(np.einsum("ij,ij->i", vectors, vectors)), 0
            while at < len(vectors):
                n = max(self.k, PIECE)
                part = slice(at, at + n)
                if len(self.scores) < self.k or not self._better(vectors[part], single[part], keys[part], norm[part].max()):
                    step = max(self.k, PRODUCT // len(self.ids), 1)
                    for k in range(at, min(at + n, len(vectors)), step):
                        self._all(vectors[k : min(k + step, at + n)], keys[k : min(k + step, at + n)])
                at += n

    def _all(self, vectors: np.ndarray, keys: np.ndarray) -> None:
        near = np.round(vectors @ self.queries.T, 6)
        names = np.broadcast_to(keys[:, None], near.shape)
        self.made += near.size
        if self.keys is not None:
            near, names = np.concatenate([self.scores, near]), np.concatenate([self.keys, names])
        self.scores, self.keys = _best_each(near, names, self.k)

    def _better(self, vectors: np.ndarray, single: np.ndarray, keys: np.ndarray, norm: float) -> bool:
        """Whether few products could matter; these are in then."""
        least, last = self.scores[-1], self.keys[-1]
        # the error of a sum of products in single precision, and of rounding
        off = 2.0**-23 * (vectors.shape[1] + 8) * norm * self.norm + 2e-6
        hit = np.flatnonzero(~(single @ self.single.T < (least - off).astype(np.float32)))
        if len(hit) > 8 * self.k * len(self.ids):
            return False
        self.made += len(hit)
        row, q = np.divmod(hit, len(self.ids))
        score, name = np.round(np.einsum("ij,ij->i", vectors[row], self.queries[q]), 6), keys[row]
        new = ~((score < least[q]) | ((score == least[q]) & (name < last[q])))
        q, score, name = q[new], score[new], name[new]
        if len(q):
            which, place = np.unique(q, return_inverse=True)
            place = np.concatenate([np.tile(np.arange(len(which)), self.k), place])
            score, name = np.concatenate([self.scores[:, which].ravel(), score]), np.concatenate([self.keys[:, which].ravel(), name])
            order = np.lexsort((name, score, place))
            ends = np.cumsum(np.bincount(place))
            order = order[ends - 1 - np.arange(self.k)[:, None]]
            self.keys = self.keys.astype(np.result_type(self.keys, name), copy=False)
            self.scores[:, which], self.keys[:, which] = score[order], name[order]
        return True


def _packed(rows: DataFrame, key: str, kind: str, size: int, name: str) -> DataFrame:
    """Rows of ``key`` and ``v`` as blocks of at most ``size``, where they are: their keys, and the matrix of their vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        for x in batches:
            for at in range(0, len(x), size):
                some, n = x.iloc[at : at + size], n + 1
                yield pd.DataFrame({f"{name}block": [f"{task}-{n}"], f"{name}keys": [some[key].tolist()], f"{name}x": [np.stack(some["v"].to_numpy()).astype(float).tobytes()]})

    return rows.mapInPandas(run, f"{name}block string, {name}keys array<{kind}>, {name}x binary")


def grid(corpus: DataFrame, asked: DataFrame, n: int, dim: int) -> DataFrame:
    """Pairs of a block of the corpus and a block of the queries; both scanned once.

    Up to ``BLOCK`` numbers the queries' blocks are broadcast, and the corpus stays where it is. Beyond, queries are dealt into
    cells of so many numbers, and each block of the corpus goes to each cell; a cell has as many slices as keep all cores busy.
    """
    cells = -(-n * dim // BLOCK)
    if cells <= 1:
        return corpus.withColumn("cell", F.lit(0)).join(F.broadcast(asked.withColumn("cell", F.lit(0))), "cell")
    slices = max(1, -(-4 * corpus.sparkSession.sparkContext.defaultParallelism // cells))
    count = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    own = asked.withColumn("cell", F.pmod(F.xxhash64("qblock"), F.lit(cells)).cast("int")).withColumn("slice", count(slices))
    rows = corpus.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int")).withColumn("cell", count(cells))
    return rows.join(own, ["cell", "slice"])


def nearest(corpus: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", knn: bool = False) -> DataFrame:
    """qid, key, score, rank; ``queries``: qid, vector. With ``knn`` the score is (1 + cosine) / 2.

    Vectors are packed into matrices where they are, and blocks of the corpus meet blocks of the queries in a join (see ``grid``). A task
    keeps the best k of each query and hands on these alone, so that what is shuffled after it grows with the number of tasks, not with that of
    pairs. Equal scores (to 6 digits) rank by falling key. Null vectors are near to nothing.
    """
    spark = corpus.sparkSession
    asked = queries.select("qid", F.col("vector").alias("v")).where("v is not null")
    n, dim = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    kind = corpus.schema[key].dataType.simpleString()
    qkind = queries.schema["qid"].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], f"qid {qkind}, {key} {kind}, score double, rank int")
    rows = corpus.select(key, F.col(vector).alias("v")).where("v is not null")
    if n * (dim or 1) > BLOCK:  # blocks are shuffled then, and must come out the same where a lost partition is made again
        rows, asked = rows.sortWithinPartitions(key), asked.sortWithinPartitions("qid")
    pairs = grid(_packed(rows, key, kind, CORPUS_ROWS, ""), _packed(asked, "qid", qkind, QUERY_ROWS, "q"), n, max(1, dim or 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, _Best] = {}

        def out(h: _Best) -> pd.DataFrame:
            return pd.DataFrame({"qid": np.repeat(np.array(h.ids), len(h.scores)), key: h.keys.T.ravel(), "score": h.scores.T.ravel()})

        for x in batches:
            for r in x.itertuples(index=False):
                own = np.asarray(r.keys)
                own = own.astype(str) if own.dtype == object else own
                if r.qblock not in held:
                    if sum(h.held for h in held.values()) > HELD:
                        yield out(held.pop(next(iter(held))))
                    held[r.qblock] = _Best(list(r.qkeys), np.frombuffer(r.qx).reshape(len(r.qkeys), -1), k)
                held[r.qblock].add(np.frombuffer(r.x).reshape(len(own), -1), own)
        for h in held.values():
            yield out(h)

    found = pairs.select("keys", "x", "qblock", "qkeys", "qx").mapInPandas(run, f"qid {qkind}, {key} {kind}, score double")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc(key))
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.withColumn("score", F.round((F.col("score") + 1) / 2, 7)) if knn else found


@lru_cache(maxsize=200_000)
def _hash(word: str) -> int:
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big")


def _hashed_counts(rows: pa.Array, dim: int) -> np.ndarray:
    words = rows.flatten().dictionary_encode()  # each term is hashed once a batch
    h = np.array([_hash(w) for w in words.dictionary.to_pylist()], np.int64)
    flat = (h // 2 % dim * 2 + h % 2)[words.indices.to_numpy()]  # twice the dimension, and one more for a negative sign
    row = np.repeat(np.arange(len(rows)), rows.value_lengths().to_numpy(zero_copy_only=False))
    n = np.bincount(row * (2 * dim) + flat, minlength=len(rows) * 2 * dim).reshape(len(rows), 2 * dim)
    return n[:, ::2] - n[:, 1::2]


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(float)
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    v /= np.where(norm > 0, norm, 1)[:, None]
    return v


def hashed_vectors(rows: pa.Array, dim: int = 64) -> np.ndarray:
    """``hashed_embedding`` of texts whose terms are given, as a matrix."""
    return _unit(_hashed_counts(rows, dim))


def hashed_terms(*parts: tuple[Column, int], dim: int = 64) -> Column:
    """``hashed_embedding`` of texts whose terms are those of the parts, each so many times."""
    times = [n for _, n in parts]

    def summed(*columns: pa.Array) -> pa.Array:
        v = _unit(sum(n * _hashed_counts(rows, dim) for rows, n in zip(columns, times, strict=True)))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * dim, pa.int32()), pa.array(v.ravel()))

    @F.arrow_udf("array<double>")
    def vectors(rows: pa.Array) -> pa.Array:
        return summed(rows)

    @F.arrow_udf("array<double>")
    def vectors_of_two(rows: pa.Array, more: pa.Array) -> pa.Array:
        return summed(rows, more)

    return (vectors if len(parts) == 1 else vectors_of_two)(*[c for c, _ in parts])


def hashed_embedding(c, dim: int = 64) -> Column:
    """Signed feature hashing of the terms, of unit length; the zero vector without terms."""
    return hashed_terms((T.tokens(c), 1), dim=dim)


def lsh_candidates(corpus: DataFrame, queries: DataFrame, k: int, candidates: int | None = None, bucket: float = 1.0, tables: int = 12) -> DataFrame:
    """Approximate neighbours by bucketed random projections: qid, vec_id, score, rank, as ``nearest`` with ``knn``.

    Of the vectors that meet a query in a bucket the nearest ``candidates`` (by default the larger of 100
    and 2 k) are looked at. Recall depends on the parameters; unit vectors are expected.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    have = corpus.select(F.col("vec_id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("v")).where("v is not null")
    want = queries.select("qid", array_to_vector(F.col("vector").cast("array<double>")).alias("v")).where("v is not null")
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=7).fit(have)
    # no two unit vectors are farther apart than 2; beyond the square root of 2 they have nothing in common
    pairs = model.approxSimilarityJoin(have, want, 2**0.5, "distance").select(F.col("datasetB.qid").alias("qid"), F.col("datasetA.vec_id").alias("vec_id"), F.round(F.lit(1.0) - F.col("distance") ** 2 / 4, 7).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("vec_id"))
    best = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= (candidates or max(100, 2 * k)))
    return best.where(F.col("rank") <= k)
