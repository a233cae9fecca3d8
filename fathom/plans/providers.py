"""Seams for models, with offline stand-ins that give the same result every time.

A provider with a real model keeps the same methods. ``WorkerModel`` makes one of a function that loads
a model: it is loaded by the worker that first needs it, once, and then answers batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.operators.dense import hashed_embedding, hashed_terms, hashed_vectors

#: Words of query and text together that a reranker is given; models cut at as many tokens.
RERANK_WORDS = 512


class Embedder(Protocol):
    """One with an attribute ``version`` (a name for files) has its vectors kept by content, for all collections under one root.

    One that depends on the terms of a text alone may have ``of_terms`` and ``embed_terms`` besides, as ``HashEmbedder``; texts that were cut
    into terms are not cut again for it.
    """

    def embed(self, text: Column) -> Column: ...


class Reranker(Protocol):
    def score(self, query: Column, content: Column) -> Column: ...


class Generator(Protocol):
    def answer(self, prompt: Column, context: Column) -> Column: ...

    def sub_queries(self, query: Column) -> Column: ...

    def passage(self, query: Column) -> Column: ...

    def chunk_summary(self, content: Column) -> Column: ...

    def document_summary(self, text: Column) -> Column: ...


class WorkerModel:
    """A column function from ``load`` (returns the model) and ``apply`` (model and columns to results of type ``kind``).

    A failure fails the job; if ``contained``, a row is a struct of ``value`` and ``error``: the rows of a batch that fails (or all, if the model
    does not load) have no value, and the others stay.
    """

    def __init__(self, load: Callable[[], Any], apply: Callable[..., Any], kind: str, contained: bool = False):
        def run(batches):
            model = None
            for columns in batches:
                if not contained:
                    model = load() if model is None else model
                    yield pd.Series(apply(model, *columns))
                    continue
                try:
                    model = load() if model is None else model
                    yield pd.DataFrame({"value": list(apply(model, *columns)), "error": None})
                except Exception as e:  # the caller decides what a missing value means  # noqa: BLE001
                    yield pd.DataFrame({"value": None, "error": f"{type(e).__name__}: {e}"}, index=range(len(columns[0])))

        # the signature tells Spark how to call it: several columns, batch by batch
        run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame] if contained else Iterator[pd.Series]}
        self._run = F.pandas_udf(run, f"value {kind}, error string" if contained else kind)

    def __call__(self, *columns: Column) -> Column:
        return self._run(*columns)


class ModelReranker:
    """A reranker from ``load`` and ``apply(model, queries, contents)``; scores are null where it fails, and the search goes on without it."""

    def __init__(self, load: Callable[[], Any], apply: Callable[..., Any]):
        self._model = WorkerModel(load, apply, "double", contained=True)

    def score(self, query: Column, content: Column) -> Column:
        return self.judged(query, content)["value"]

    def judged(self, query: Column, content: Column) -> Column:
        """``value`` and ``error``."""
        return self._model(query, content)


class HashEmbedder:
    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, text: Column) -> Column:
        return hashed_embedding(text, self.dim)

    def of_terms(self, terms: pa.Array) -> np.ndarray:
        """Within a task: the vectors of texts with these terms."""
        return hashed_vectors(terms, self.dim)

    def embed_terms(self, *parts: tuple[Column, int]) -> Column:
        """The vector of a text of one or two parts, from the terms of each and how often it has the part."""
        return hashed_terms(*parts, dim=self.dim)


class CoverageReranker:
    """The share of the query's distinct terms that the content has, among the first words that fit."""

    def __init__(self, words: int = RERANK_WORDS):
        self.words = words

    def score(self, query: Column, content: Column) -> Column:
        def covered(q: Column) -> Column:
            own = F.slice(T.tokens(content), F.lit(1), F.greatest(F.lit(self.words) - F.size(q), F.lit(0)))
            distinct = F.array_distinct(q)
            return F.coalesce(F.size(F.array_intersect(distinct, own)) / F.nullif(F.size(distinct), F.lit(0)), F.lit(0.0))

        return T.let(T.tokens(query), covered)


class ExtractiveGenerator:
    """Answers with the first sentence of the first source; rephrases by leaving words out."""

    def answer(self, prompt: Column, context: Column) -> Column:
        body = F.element_at(F.split(F.element_at(F.split(context, "\n\n---\n\n"), 1), "\n", 2), -1)
        return F.concat(F.coalesce(F.try_element_at(T.sentences(body), F.lit(1)), F.lit("")), F.lit(". [Source 1]"))

    def sub_queries(self, query: Column) -> Column:
        w = T.words(query)
        half = F.greatest(F.ceil(F.size(w) / 2), F.lit(1)).cast("int")
        reply = F.concat_ws("\n", F.concat(F.lit("1. "), F.array_join(F.slice(w, 1, half), " ")), F.concat(F.lit("2) "), F.array_join(F.reverse(F.slice(F.reverse(w), 1, half)), " ")), F.array_join(F.array_sort(w), " "))
        return F.when(F.size(w) > 0, reply).otherwise(F.lit(""))

    def passage(self, query: Column) -> Column:
        return T.strip(query)

    def chunk_summary(self, content: Column) -> Column:
        return F.coalesce(F.try_element_at(T.sentences(content), F.lit(1)), F.lit(""))

    def document_summary(self, text: Column) -> Column:
        """The first sentence of the text and its last one."""
        s = T.sentences(text)
        ends = F.array_distinct(F.filter(F.array(F.try_element_at(s, F.lit(1)), F.try_element_at(s, F.lit(-1))), lambda x: x.isNotNull()))
        return F.array_join(ends, ". ")
