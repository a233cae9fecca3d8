"""Segments to clusters of similar neighbours: dynamic programming within each document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _gains(vectors: np.ndarray, sizes: np.ndarray, longest: int) -> np.ndarray:
    """What a cluster gathers that ends at a row and has 1, 2, ... ``longest`` members, for documents of ``sizes`` rows, one after another.

    Numbers of clusters that would begin in an earlier document say nothing.
    """
    first = np.cumsum(sizes) - sizes
    total, own = np.add.reduceat(vectors, first, axis=0), np.add.reduceat(np.einsum("ij,ij->i", vectors, vectors), first)
    mean = (np.einsum("ij,ij->i", total, total) - own) / np.maximum(sizes * (sizes - 1), 1)
    mean = np.repeat([round(x, 9) for x in mean.tolist()], sizes)
    out, n = np.zeros((len(vectors), longest)), len(vectors)
    band = np.zeros(n)  # of a first member, with all that follow
    for size in range(2, min(longest, n) + 1):
        d = size - 1
        band[:-d] += np.round(np.einsum("ij,ij->i", vectors[:-d], vectors[d:]), 9) - mean[:-d]
        out[:, d] = out[:, d - 1]
        out[d:, d] += 2 * band[:-d]
    return out


def _starts(gains: list[list[float]], strict: bool, rounded: Callable[[float], float]) -> list[int]:
    """The first members of one document's clusters, rising."""
    best, start = [0.0], []
    for end, gain in enumerate(gains):
        top, at = (best[end], end) if strict else (0.0, 0)
        for d in range(min(len(gain), end + 1)):
            value = rounded(gain[d] + best[end - d])
            if value > top:
                top, at = value, end - d
        best.append(top)
        start.append(at)
    out, end = [], len(gains)
    while end > 0:
        end = start[end - 1]
        out.append(end)
    return out[::-1]


def segmentations(vectors: np.ndarray, sizes: np.ndarray, longest: int = 8, strict: bool = False) -> Iterator[list[int]]:
    """For each document of ``sizes`` rows the first members of the clusters that gather most similarity above the mean.

    Only pairs less than ``longest`` apart are compared; the mean over all pairs follows from sums.
    Unless ``strict``, a beginning without any gain is one cluster, however long.
    """
    gains = _gains(vectors, sizes, longest)
    most = np.abs(gains).max(initial=0)
    # the same result; the quick one is for numbers that an integer can take
    rounded = (lambda x: round(x * 1e6) / 1e6) if most * len(vectors) < 1e9 else lambda x: float(np.round(x, 6))
    at = 0
    for n in sizes.tolist():
        yield _starts(gains[at : at + n].tolist(), strict, rounded)
        at += n


def segmentation(vectors: np.ndarray, longest: int = 8, strict: bool = False) -> list[tuple[int, int]]:
    """Inclusive (first, last) of the clusters of one document, see ``segmentations``."""
    if len(vectors) == 0:
        return []
    (starts,) = segmentations(np.asarray(vectors, float), np.array([len(vectors)]), longest, strict)
    return list(zip(starts, [x - 1 for x in starts[1:]] + [len(vectors) - 1], strict=True))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of whole documents, which lie together while batches end anywhere, and how many each has."""

    def sized(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
        code = rows.column("doc_id").chunk(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
        return rows, np.diff(np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]])))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        if held[0].column("doc_id")[0].as_py() == batch.column("doc_id")[-1].as_py():
            continue  # perhaps more of the same one
        rows, sizes = sized(pa.Table.from_batches(held).combine_chunks())
        done = rows.num_rows - int(sizes[-1])
        yield rows.slice(0, done), sizes[:-1]
        held = rows.slice(done).to_batches()
    if held:
        yield sized(pa.Table.from_batches(held).combine_chunks())


def _vectors(rows: pa.Table) -> np.ndarray:
    return rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows.num_rows, -1)


def clusters(segments: DataFrame, longest: int = 8) -> DataFrame:
    """``segments``: doc_id, seg_idx, embedding. Returns doc_id, seg_idx, cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sizes in _whole(batches):
            found = segmentations(_vectors(rows), sizes, longest)
            number = np.concatenate([np.searchsorted(starts, np.arange(n), "right") - 1 for starts, n in zip(found, sizes, strict=True)])
            yield from rows.select(["doc_id", "seg_idx"]).append_column("cluster", pa.array(number, pa.int64())).to_batches()

    kind = segments.schema["doc_id"].dataType.simpleString()
    rows = segments.select("doc_id", F.col("seg_idx").cast("long").alias("seg_idx"), "embedding")
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "seg_idx").mapInArrow(run, f"doc_id {kind}, seg_idx long, cluster long")


def chunks(segments: DataFrame, longest: int = 8, of_terms: Callable[[pa.Array], np.ndarray] | None = None) -> DataFrame:
    """``assemble`` of ``clusters``, of segments (doc_id, page, text, embedding) that lie in order, a document's together.

    With ``of_terms`` segments have ``terms`` instead of vectors, which it makes of them within the task; chunks have the terms of their segments.
    """
    from fathom.functions.text import token_estimate

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sizes in _whole(batches):
            if of_terms is None:
                vectors = _vectors(rows)
            else:
                terms = rows.column("terms").combine_chunks()
                vectors = of_terms(terms)
            found = list(segmentations(vectors, sizes, longest))
            first = np.cumsum(sizes) - sizes
            begin = np.concatenate([np.array(starts) + at for starts, at in zip(found, first, strict=True)])
            index = np.concatenate([np.arange(len(starts)) for starts in found])
            spans = list(zip(begin.tolist(), [*begin[1:].tolist(), rows.num_rows], strict=True))
            texts, pages = rows.column("text").to_pylist(), rows.column("page").to_pylist()
            own = [[p for p in pages[a:b] if p is not None] for a, b in spans]
            made = pa.table({
                "doc_id": rows.column("doc_id").take(pa.array(begin)), "cluster": pa.array(index, pa.int64()), "content": [" ".join(texts[a:b]) for a, b in spans],
                "page_start": pa.array([min(p, default=None) for p in own], pa.int32()), "page_end": pa.array([max(p, default=None) for p in own], pa.int32()),
            })
            if of_terms is not None:
                start = terms.offsets.to_numpy()[[*begin.tolist(), rows.num_rows]]
                made = made.append_column("terms", pa.ListArray.from_arrays(pa.array(start - start[0], pa.int32()), terms.flatten()))
            yield from made.to_batches()

    kind = segments.schema["doc_id"].dataType.simpleString()
    terms = [] if of_terms is None else ["terms"]
    rows = segments.select("doc_id", F.col("page").cast("int").alias("page"), "text", *(terms or ["embedding"]))
    made = rows.mapInArrow(run, f"doc_id {kind}, cluster long, content string, page_start int, page_end int" + ", terms array<string>" * len(terms))
    return made.select(F.concat(F.lit("chunk_"), "cluster").alias("chunk_id"), "doc_id", F.col("cluster").alias("original_index"), "content", "page_start", "page_end", token_estimate("content").alias("token_count"), *terms)


def assemble(segments: DataFrame, members: DataFrame) -> DataFrame:
    """Chunks: texts of a cluster in order, its pages and its estimate of tokens."""
    from fathom.functions.text import token_estimate

    rows = segments.join(members, ["doc_id", "seg_idx"]).groupBy("doc_id", "cluster")
    parts = F.array_sort(F.collect_list(F.struct("seg_idx", "text")))
    out = rows.agg(F.array_join(F.transform(parts, lambda p: p.text), " ").alias("content"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    return out.select(F.concat(F.lit("chunk_"), "cluster").alias("chunk_id"), "doc_id", F.col("cluster").alias("original_index"), "content", "page_start", "page_end", token_estimate("content").alias("token_count"))


def dataset(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """One entry a document: doc_id, original_uuid, pdf_path (of ``paths``: doc_id, pdf_path) and its chunks in order."""
    fields = ["original_index", "chunk_id", "content", "page_start", "page_end", "token_count"]
    rows = F.array_sort(F.collect_list(F.struct(*fields)))
    return chunks.groupBy("doc_id").agg(rows.alias("chunks")).join(paths, "doc_id", "left").select("doc_id", F.col("doc_id").alias("original_uuid"), "pdf_path", "chunks")
