"""A kept index of vectors: lists by coarse centroids, residual product codes, and an exact second look.

``fit`` learns centroids and codebooks from at most ``SAMPLE`` vectors, those of the smallest hash of their key, and from the
same rows how many lists a query has to look into. All vectors are encoded; an index is a folder with the model and with the lists, each in a folder of
its own, packed. A search reads the lists of its queries' nearest centroids alone, ranks their vectors by
their codes, and takes the inner products of the ``shortlist`` with the vectors themselves.

Vectors are expected to have one dimension; null ones are left out. Rows that are added later are encoded with the kept model.
Rows that are gone from the vectors' table are found no more, though their codes stay in the lists.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that the model is learned from, steps of its learning, and words of a codebook.
SAMPLE, STEPS, WORDS = 20_000, 12, 256
#: Numbers that a part of a code stands for, and rows of a packed block.
PART, ROWS = 4, 4096
#: Queries that meet a block at a time.
QUERIES = 1024
#: The share of the sample's true neighbours that the lists of a query are to hold.
RECALL, NEAR = 0.97, 10


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm from k rows; empty clusters keep their centre."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(float)
    for _ in range(STEPS):
        at = _closest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        total = np.stack([np.bincount(at, x[:, d], len(centres)) for d in range(x.shape[1])], 1)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def _closest(x: np.ndarray, centres: np.ndarray, most: int = 4_000_000) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    step = max(1, most // len(centres))
    return np.concatenate([np.argmax(x[i : i + step] @ centres.T - half, axis=1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, int)


@dataclass
class Model:
    """``centroids`` (lists, dim), ``books`` (parts, words, PART), and the number of lists that a query looks into."""

    centroids: np.ndarray
    books: np.ndarray
    probes: int

    @staticmethod
    def learn(x: np.ndarray, lists: int) -> Model:
        rng = np.random.default_rng(1)
        x = np.asarray(x, float)
        x = np.pad(x, ((0, 0), (0, -x.shape[1] % PART)))
        centroids = _means(x, lists, rng)
        rest = x - centroids[_closest(x, centroids)]
        books = np.stack([_pad(_means(rest[:, d : d + PART], WORDS, rng)) for d in range(0, x.shape[1], PART)])
        # in which of its lists, nearest first, a row has its neighbours
        own = _closest(x, centroids)
        asked = x[rng.choice(len(x), min(len(x), 500), replace=False)]
        near = np.argsort(-(asked @ x.T), axis=1)[:, : NEAR + 1]
        place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)
        needed = np.sort(np.take_along_axis(place, own[near], 1).ravel())
        return Model(centroids, books, int(needed[min(len(needed) - 1, int(RECALL * len(needed)))]) + 1)

    def dim(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.centroids.shape[1] - x.shape[1])))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.dim(x)
        at = _closest(x, self.centroids)
        rest = x - self.centroids[at]
        return at, np.stack([_closest(rest[:, p * PART : (p + 1) * PART], self.books[p]) for p in range(len(self.books))], 1).astype(np.uint8)

    def scores(self, queries: np.ndarray, centroid: int, codes: np.ndarray) -> np.ndarray:
        """Of all pairs of a query and a code of a list, from tables of products."""
        q = self.dim(queries)
        out = np.repeat((q @ self.centroids[centroid])[:, None], len(codes), axis=1)
        for p, book in enumerate(self.books):
            out += (q[:, p * PART : (p + 1) * PART] @ book.T)[:, codes[:, p]]
        return out


def _pad(book: np.ndarray) -> np.ndarray:
    return np.concatenate([book, np.full((WORDS - len(book), book.shape[1]), 1e9)]) if len(book) < WORDS else book


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def exists(self) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/lists")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def remove(self) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    # --- the model ---

    def fit(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", lists: int | None = None) -> Model:
        """Learn and keep a model; by default as many lists as the square root of the rows, 4,096 at most."""
        rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where("key is not null and v is not null")
        n = rows.count()
        if not n:
            raise ValueError("no vectors to learn from")
        sample = rows.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").collect()  # bounded by SAMPLE
        model = Model.learn(np.array([r.v for r in sample]), lists or max(1, min(4_096, int(n**0.5))))
        row = (json.dumps({"probes": model.probes, "parts": len(model.books)}), bytearray(model.centroids.tobytes()), bytearray(model.books.tobytes()))
        self.spark.createDataFrame([row], "about string, centroids binary, books binary").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/model")
        return model

    def model(self) -> Model:
        r = self.spark.read.parquet(f"{self.path}/model").first()
        about = json.loads(r.about)
        books = np.frombuffer(r.books).reshape(about["parts"], WORDS, PART)
        return Model(np.frombuffer(r.centroids).reshape(-1, about["parts"] * PART), books, about["probes"])

    # --- lists ---

    def add(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> None:
        """Encode all rows with the kept model and append them to the lists."""
        sent = self.spark.sparkContext.broadcast(self.model())  # 4,096 centroids at most
        kind = vectors.schema[key].dataType.simpleString()

        def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                if len(x):
                    at, codes = sent.value.encode(np.stack(x["v"].to_numpy()).astype(float))
                    yield pd.DataFrame({"centroid": at.astype(np.int32), "key": x["key"].to_numpy(), "code": [c.tobytes() for c in codes]})

        rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where("key is not null and v is not null")
        rows = rows.mapInPandas(encode, f"centroid int, key {kind}, code binary")

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                for centroid, own in x.groupby("centroid", sort=False):
                    parts = [own.iloc[i : i + ROWS] for i in range(0, len(own), ROWS)]
                    yield pd.DataFrame({"centroid": np.int32(centroid), "keys": [p["key"].tolist() for p in parts], "codes": [b"".join(p["code"]) for p in parts]})

        # a list that holds much of the data lies in several files
        rows = rows.hint("rebalance", F.col("centroid")).sortWithinPartitions("centroid").mapInPandas(pack, f"centroid int, keys array<{kind}>, codes binary")
        rows.write.mode("append").partitionBy("centroid").parquet(f"{self.path}/lists")

    def lists(self, only: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/lists")
        return rows if only is None else rows.where(F.col("centroid").isin(only))

    # --- search ---

    def probed(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """centroid, qid, vector: the lists that each query looks into; ``queries``: qid, vector."""
        model = self.model()
        sent, most = self.spark.sparkContext.broadcast(model), min(len(model.centroids), probes or model.probes)
        qkind = queries.schema["qid"].dataType.simpleString()

        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                if len(x):
                    v = np.stack(x["vector"].to_numpy()).astype(float)
                    at = np.argsort(-(sent.value.dim(v) @ sent.value.centroids.T), axis=1)[:, :most]
                    yield pd.DataFrame({"centroid": at.ravel().astype(np.int32), "qid": np.repeat(x["qid"].to_numpy(), most), "vector": [row for row in v for _ in range(most)]})

        asked = queries.select("qid", F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
        return asked.mapInPandas(nearest, f"centroid int, qid {qkind}, vector array<double>")

    def search(self, vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", probes: int | None = None, shortlist: int | None = None) -> DataFrame:
        """qid, key, score, rank. ``vectors`` are the rows that were added; equal scores (to 6 digits) rank by falling key."""
        shortlist = shortlist or max(100, 10 * k)
        sent = self.spark.sparkContext.broadcast(self.model())
        probed = self.probed(queries, probes)
        named = [r.centroid for r in probed.select("centroid").distinct().collect()]  # 4,096 at most
        lists = self.lists(named)
        kind, qkind = lists.schema["keys"].dataType.elementType.simpleString(), queries.schema["qid"].dataType.simpleString()
        # the queries of a list, some at a time
        groups = probed.groupBy("centroid", F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-queries.count() // QUERIES)))).alias("part"))
        asked = groups.agg(F.collect_list(F.struct("qid", "vector")).alias("asked")).select("centroid", F.col("asked.qid").alias("qids"), F.flatten("asked.vector").alias("vectors"))

        def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                for r in x.itertuples(index=False):
                    codes, names = np.frombuffer(r.codes, np.uint8).reshape(len(r.keys), -1), np.asarray(r.qids)
                    score = sent.value.scores(np.asarray(r.vectors, float).reshape(len(names), -1), r.centroid, codes)
                    top = np.argsort(-score, axis=1, kind="stable")[:, :shortlist]
                    yield pd.DataFrame({"qid": np.repeat(names, top.shape[1]), "key": np.asarray(r.keys)[top].ravel(), "near": np.take_along_axis(score, top, 1).ravel()})

        found = lists.join(asked, "centroid").select("centroid", "keys", "codes", "qids", "vectors").mapInPandas(rank, f"qid {qkind}, key {kind}, near double")
        # a row that was added again lies in two lists
        found = found.groupBy("qid", "key").agg(F.max("near").alias("near"))
        order = Window.partitionBy("qid").orderBy(F.desc("near"), F.desc("key"))
        found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= shortlist).select("qid", "key")
        rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
        asked = queries.select("qid", F.col("vector").cast("array<double>").alias("q"))
        exact = F.round(F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), 6)
        out = found.join(rows, "key").join(asked, "qid").select("qid", F.col("key").alias(key), exact.alias("score"))
        best = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc(key))
        return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
