"""Text quality by a convolutional network over bytes, in numpy.

A text is its UTF-8 bytes, in blocks of ``BLOCK`` bytes; a chunk is two neighbouring blocks, so that chunks
overlap by half and cover the whole text. Bytes have learned embeddings; learned filters over ``3 * PAIR``
bytes move by ``PAIR`` bytes, and the largest value of each filter in a chunk is kept. A hidden layer turns
these into features of the chunk, the largest of each feature over all chunks of the text are kept, and a
logistic unit makes one probability of them. A filter fires on what it has learned, such as runs of
signs; a hidden unit with falling weights fires where nothing of what prose has occurs, as in a chunk of
one word repeated.

The network is fitted on the driver, on a bounded sample: at most ``ROWS`` labelled rows, those of the smallest hash of their
id, and of these, in that order, as many as have ``BYTES`` bytes in all (texts that do not fit any more are passed over). Training is
deterministic. Scoring is one pass over the whole texts, without a shuffle; blocks are worked on a tile at a time,
so that a text of any length needs little memory besides itself.

Null texts count as empty; an empty text is one block of padding. Without labelled rows to learn from of both kinds all scores are the share of good ones among
those there are (0.5 without any). An empty table gives an empty one. Rows without doc_id are never trained on, and are scored
like others (not held out). Repeated rows are scored alike. A document with several labels counts as of low quality if one says
so. Ties of the hash go by the id. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import scratch

#: Bounds of the training sample.
ROWS, BYTES = 4_000, 10_000_000
THRESHOLD = 0.3
BLOCK, PAIR, WIDE = 128, 2, 3
EMBED, FILTERS, HIDDEN = 8, 24, 12
#: Blocks that go through the filters at a time, and bytes of texts that are scored together.
TILE, TOGETHER = 512, 2_000_000
PAD = 256


def held_out(doc_id):
    """Whether a row belongs to the fold that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Batch:
    """Texts one after another, each led by padding and filled up to whole blocks; ``first`` has the number of each text's first block.

    The padding before a text is as long as a filter reaches beyond its place, so that no filter sees two texts.
    """

    codes: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(texts: list[bytes]) -> Batch:
        lead = PAIR * (WIDE - 1)
        blocks = np.array([-(-(lead + len(t)) // BLOCK) for t in texts], np.int64)
        first = np.append(0, np.cumsum(blocks))
        codes = np.full(int(first[-1]) * BLOCK + lead, PAD, np.int16)
        for at, t in zip(first[:-1] * BLOCK + lead, texts, strict=True):
            codes[at : at + len(t)] = np.frombuffer(t, np.uint8)
        return Batch(codes, first)

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The two blocks of each chunk (the same twice in a text of one block), and each text's first chunk."""
        n = np.diff(self.first)
        count = np.maximum(n - 1, 1)
        begin = np.append(0, np.cumsum(count))[:-1]
        a = np.repeat(self.first[:-1] - begin, count) + np.arange(count.sum())
        return a, a + np.repeat(n > 1, count), begin


class Network:
    """The parameters, and what they make of texts."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        put = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "e": put(257, EMBED, scale=0.5),
            "w": put(WIDE, PAIR * EMBED, FILTERS, scale=(2 / (WIDE * PAIR * EMBED)) ** 0.5),
            "b": np.zeros(FILTERS, np.float32),
            "v": put(FILTERS, HIDDEN, scale=(2 / FILTERS) ** 0.5),
            "c": np.full(HIDDEN, 0.1, np.float32),
            "u": put(HIDDEN, scale=HIDDEN**-0.5),
            "d": np.zeros(1, np.float32),
        }
        self.p["e"][PAD] = 0

    def filters(self, batch: Batch, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The largest value of each filter in each block, a tile at a time, and at which place it is."""
        e, w, b = self.p["e"], self.p["w"], self.p["b"]
        n, per = int(batch.first[-1]), BLOCK // PAIR
        best = np.empty((n, FILTERS), w.dtype)
        at = np.empty((n, FILTERS), np.int64) if where else None
        for i in range(0, n, TILE):
            j = min(n, i + TILE)
            x = e[batch.codes[i * BLOCK : j * BLOCK + PAIR * (WIDE - 1)]].reshape(-1, PAIR * EMBED)
            m = (j - i) * per
            z = x[:m] @ w[0]
            for k in range(1, WIDE):
                z += x[k : k + m] @ w[k]
            z = z.reshape(j - i, per, FILTERS)
            if at is None:
                best[i:j] = z.max(axis=1)
            else:
                at[i:j] = z.argmax(axis=1)
                best[i:j] = np.take_along_axis(z, at[i:j, None, :], 1)[:, 0]
                at[i:j] += (np.arange(i, j) * per)[:, None]
        return best + b, at

    def forward(self, batch: Batch, where: bool = False):
        best, at = self.filters(batch, where)
        h = np.maximum(best, 0)
        a, b, begin = batch.chunks()
        hc = np.maximum(h[a], h[b])
        u = np.maximum(hc @ self.p["v"] + self.p["c"], 0)
        top = np.maximum.reduceat(u, begin, axis=0)
        z = top @ self.p["u"] + self.p["d"][0]
        return z, (at, h, a, b, begin, hc, u, top)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        z = self.forward(Batch.of(texts))[0].astype(float)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def gradient(self, batch: Batch, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss; through each maximum only its winner gets a share."""
        p = self.p
        z, (at, h, a, b, begin, hc, u, top) = self.forward(batch, True)
        dz = ((1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / len(y)).astype(np.float32)
        g = {"u": top.T @ dz, "d": np.array([dz.sum()], np.float32)}
        # the first chunk of each text that has the largest value of each hidden unit
        count = np.diff(np.append(begin, len(u)))
        hit = u == np.repeat(top, count, axis=0)
        order = np.where(hit, np.arange(len(u))[:, None], len(u))
        won = np.minimum.reduceat(order, begin, axis=0)
        du = np.zeros_like(u)
        np.put_along_axis(du, won, dz[:, None] * p["u"], 0)
        du *= u > 0
        g["v"], g["c"] = hc.T @ du, du.sum(axis=0)
        dh = du @ p["v"].T
        c, f = np.nonzero((dh != 0) & (hc > 0))
        value = dh[c, f]
        block = np.where(h[a[c], f] >= h[b[c], f], a[c], b[c])
        place = at[block, f]
        g["b"] = np.bincount(f, value, FILTERS).astype(np.float32)
        g["w"], g["e"] = np.zeros_like(p["w"]), np.zeros_like(p["e"])
        for k in range(WIDE):
            codes = batch.codes[PAIR * (place + k)[:, None] + np.arange(PAIR)]
            x = p["e"][codes].reshape(len(place), PAIR * EMBED)
            own = np.zeros((FILTERS, PAIR * EMBED), np.float32)
            np.add.at(own, f, x * value[:, None])
            g["w"][k] = own.T
            np.add.at(g["e"], codes.ravel(), (p["w"][k][:, f].T * value[:, None]).reshape(-1, EMBED))
        g["e"][PAD] = 0
        return g


def train(texts: list[bytes], y: np.ndarray, epochs: int = 12, rate: float = 0.01, together: int = 24, seed: int = 1) -> Network:
    """Adam over batches of ``together`` texts in a shuffled order."""
    net, rng = Network(seed), np.random.default_rng(seed)
    y = np.asarray(y, np.float32)
    net.p["d"][0] = np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3))
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    t, steps = 0, epochs * -(-len(texts) // together)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), together):
            own = order[i : i + together]
            g = net.gradient(Batch.of([texts[j] for j in own]), y[own])
            t += 1
            now = rate * min(1, t / 50) * (1 - 0.95 * t / steps)
            for k, v in net.p.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                v -= now * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-7)
    return net


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The whole texts of the training sample with their labels, within both bounds."""
    known = labels.where(~held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).cast("int").alias("y"))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    have = scratch.materialize(texts.select("doc_id", F.octet_length("t").cast("long").alias("n")).where(F.col("n") <= BYTES).groupBy("doc_id").agg(F.max("n").alias("n")).join(known, "doc_id"), "labelled")
    chosen, left = [], BYTES
    for r in scratch.least_by_hash(have, "doc_id", ROWS).collect():  # ROWS numbers at most
        if r.n <= left:
            chosen.append((r.doc_id, r.y))
            left -= r.n
    if not chosen:
        return [], np.zeros(0)
    ids = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long, y int"))
    rows = texts.join(ids, "doc_id").groupBy("doc_id", "y").agg(F.min("t").alias("t")).orderBy("doc_id").collect()  # BYTES bytes at most
    return [bytes(r.t) for r in rows], np.array([r.y for r in rows])


@dataclass
class Constant:
    """What is known without labels of both kinds."""

    value: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.value)


def fit(docs: DataFrame, labels: DataFrame) -> Network | Constant:
    texts, y = sample(docs, labels)
    if len(set(y.tolist())) < 2:
        return Constant(float(y.mean()) if len(y) else 0.5)
    return train(texts, y)


def score(docs: DataFrame, model: Network | Constant, text: str = "text", name: str = "quality_score") -> DataFrame:
    """``docs`` with the probability of good quality in a column ``name`` (see ``scratch.unused``)."""
    scratch.limit_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(bodies: pd.Series) -> pd.Series:
        def parts() -> Iterator[np.ndarray]:
            held, n = [], 0
            for t in bodies:
                held.append(t.encode("utf-8", "replace"))
                n += len(held[-1]) + BLOCK
                if n >= TOGETHER:
                    yield model.score(held)
                    held, n = [], 0
            yield model.score(held)

        return pd.Series(np.concatenate(list(parts())), dtype="float64")

    return docs.withColumn(name, scored(F.coalesce(F.col(text), F.lit(""))))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs.select("doc_id", "text"), fit(docs, labels), name="score")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
