"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; every other text of the training folds is unlabelled.
With the class prior p the risk of a scorer z under the logistic loss l is::

    p E_P[l(z)] + max(0, E_U[l(-z)] - p E_P[l(-z)])

The second term estimates the risk on negatives; where it falls below zero the step goes against
it, so that a flexible model cannot drive it down. The scorer is linear over the presence of words
and their stems, fitted with numpy on the driver; an L1 penalty leaves it a few words. Scoring is one pass over the
whole texts with no shuffle.

The classifier is fitted on a bounded sample: at most ``POSITIVES`` and ``UNLABELLED`` documents,
those with the smallest hash of their id, and on at most ``WORDS`` words of that sample, those that
tell most. Whole texts of any length are read and scored, one at a time. Null texts count as empty;
an empty text gets the score of the intercept. Without any positive in the training folds all
scores are 0; an empty table gives an empty one. Rows without doc_id are never trained on, and are
scored like others (not held out). Repeated rows are scored alike. Repeated labels of a document
count once, as toxic if one of them is. Other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import scratch

#: Bounds of the training sample, in documents, and of its vocabulary, in words.
POSITIVES, UNLABELLED, WORDS = 4_000, 12_000, 5_000
#: Words are features if this share of the positives, and five documents at least, have them, and if their
#: share among positives is so many standard errors above that among unlabelled texts, or below. (A floor of
#: ten documents finds no more on held-out rows, and takes four times as many words.)
SHARE, ERRORS = 0.02, 6.0
#: Lengths of stems; toxic words may be inflected.
STEMS = (4, 5, 6)
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id):
    """Whether a row belongs to the fold that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words_of(text: str) -> set[str]:
    """The words in lower case, and the stems of longer ones: their first letters, with a star."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for n in STEMS for w in words if len(w) > n}


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: str) -> float:
        get = self.weights.get
        z = self.bias + sum(w for w in map(get, words_of(text)) if w is not None)
        return float(1 / (1 + np.exp(-z))) if z > -700 else 0.0


def nn_pu(positive: list[np.ndarray], unlabelled: list[np.ndarray], size: int, prior: float, steps: int = 500, rate: float = 0.2, l1: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights of ``size`` features and an intercept; each example is the indexes of its features."""

    def flat(rows):
        n = np.array([len(r) for r in rows])
        return (np.concatenate(rows) if n.sum() else np.zeros(0, np.int64)), np.repeat(np.arange(len(rows)), n), len(rows)

    p, u = flat(positive), flat(unlabelled)
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    z_of = lambda x: np.bincount(x[1], w[x[0]], x[2]) + b
    back = lambda x, g: np.append(np.bincount(x[0], g[x[1]], size), g.sum())
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    soft = lambda z: np.logaddexp(0, z)
    for t in range(1, steps + 1):
        zp, zu = z_of(p), z_of(u)
        negative = soft(zu).mean() - prior * soft(zp).mean()
        on_negatives = back(u, sigmoid(zu) / u[2]) - back(p, prior * sigmoid(zp) / p[2])
        g = back(p, -prior * sigmoid(-zp) / p[2]) + on_negatives if negative >= 0 else -on_negatives
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        now = rate * (1 - 0.9 * t / steps)
        scale = now / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
        step = scale * m / (1 - 0.9**t)
        w, b = w - step[:-1], b - step[-1]
        w = np.sign(w) * np.maximum(0, np.abs(w) - l1 * scale[:-1])
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> Model:
    """``prior``: the share of toxic texts; if None, their share among labelled training rows."""
    scratch.limit_batches(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & ~held_out("doc_id")).distinct()
    known = labels.where(~held_out("doc_id") & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    ids = scratch.materialize(ids.join(known, "doc_id", "left").select("doc_id", "toxic"), "folds")
    n, n_toxic = ids.agg(F.count("toxic"), F.sum((F.col("toxic") == 1).cast("int"))).first()
    if not n_toxic:
        return Model({}, float("-inf"))
    prior = float(np.clip(prior if prior is not None else n_toxic / n, 0.005, 0.5))
    some = lambda x, k: scratch.least_by_hash(x, "doc_id", k)
    sample = some(ids.where("toxic = 1"), POSITIVES).select("doc_id", F.lit(1).alias("p")).union(some(ids, UNLABELLED).select("doc_id", F.lit(0).alias("p")))
    sample = scratch.materialize(sample, "sample")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"p": x["p"], "words": [sorted(words_of(t)) for t in x["body"]]})

    body = F.coalesce(F.col("text"), F.lit(""))
    # the sample is at most POSITIVES + UNLABELLED ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body")).join(F.broadcast(sample), "doc_id").select("p", "body")
    rows = scratch.materialize(rows.mapInPandas(cut, "p int, words array<string>"), "sample")
    rows = rows.dropDuplicates(["p", "words"])  # copies of a text would make all its words look toxic
    n_p, n_u = rows.agg(F.sum("p"), F.sum(1 - F.col("p"))).first()
    least = max(min(5, n_p), int(SHARE * n_p))
    count = rows.select("p", F.explode("words").alias("word")).groupBy("word").agg(F.sum("p").alias("n"), F.sum(1 - F.col("p")).alias("u"))
    rate = (F.col("u") + 1) / (n_u + 1)
    errors = F.abs(F.col("n") / n_p - rate) / F.sqrt(rate * (1 - rate) / n_p + 1e-12)
    chosen = count.where((F.col("n") >= least) & (errors >= ERRORS)).orderBy(F.desc(errors), "word").limit(WORDS)
    vocabulary = [r.word for r in chosen.collect()]
    at = {w: k for k, w in enumerate(vocabulary)}

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"p": x["p"], "at": [[at[w] for w in words if w in at] for words in x["words"]]})

    examples = rows.mapInPandas(number, "p int, at array<int>").toPandas()
    take = lambda k: [np.asarray(a, np.int64) for a in examples["at"][examples["p"] == k]]
    w, b = nn_pu(take(1), take(0), len(vocabulary), prior)
    return Model({vocabulary[k]: float(w[k]) for k in np.flatnonzero(w)}, b)


def score(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("toxic_score", "toxic_predicted")) -> DataFrame:
    """``docs`` with the score and the prediction in columns of these ``names`` (see ``scratch.unused``)."""
    scratch.limit_batches(docs.sparkSession)
    weights, bias = model.weights, model.bias

    @F.pandas_udf("double")
    def scored(bodies: pd.Series) -> pd.Series:
        own = Model(weights, bias)
        return pd.Series([own.score(t) for t in bodies], dtype="float64")

    out = docs.withColumn(names[0], scored(F.coalesce(F.col(text), F.lit(""))))
    return out.withColumn(names[1], (F.col(names[0]) >= THRESHOLD).cast("int"))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))
