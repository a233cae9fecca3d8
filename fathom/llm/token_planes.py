"""Token ids in files of compressed bit or byte planes.

A file holds documents in order. Their ids are cut into blocks of a fixed size; a block is
transposed so that equal bits (or bytes) of all its ids lie together, each plane is compressed with
zstandard, and the chunk index at the end of the file says where each plane is::

    magic | planes of block 0 | planes of block 1 | ... | document index | footer (JSON) | u32 length of the footer | magic

The document index holds the document's key, whether it is null, and its number of ids. A block
can be read alone; a reader holds one block at a time.

Null texts count as empty (they keep only the end id). Documents are ordered by id, nulls first;
rows that share an id are ordered by a hash of their text. Texts are of any length; an empty table gives
no file and an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm import scratch
from fathom.llm.tokens import encoder

MAGIC = b"FPLN0001"
#: Ids of a block; all blocks but a file's last have as many.
BLOCK = 65_536


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """Planes from the lowest up; planes above the highest set one are left out."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    bits = int(ids.max()).bit_length() if len(ids) else 0
    if mode == "byte":
        return [raw[:, k].tobytes() for k in range(-(-bits // 8))]
    each = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(each[:, k], bitorder="little").tobytes() for k in range(bits)]


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    if mode == "byte":
        raw = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            raw[:, k] = np.frombuffer(p, np.uint8)
    else:
        each = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            each[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        raw = np.packbits(each, axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4")


class Writer:
    """Writes one file; ``add`` takes a document, ``close`` returns the number of ids."""

    def __init__(self, sink, mode: str = "byte", block: int = BLOCK, level: int = 3):
        import zstandard

        if mode not in ("bit", "byte"):
            raise ValueError(f"unknown kind of planes: {mode}")
        self.sink, self.mode, self.block = sink, mode, block
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.at, self.held, self.buffer = len(MAGIC), 0, []
        self.index: list[tuple[int, list[int], int]] = []
        self.keys: list[int | None] = []
        self.counts: list[int] = []
        sink.write(MAGIC)

    def add(self, key: int | None, ids: bytes) -> None:
        self.keys.append(key)
        self.counts.append(len(ids) // 4)
        self.buffer.append(ids)
        self.held += len(ids)
        if self.held >= 4 * self.block:
            whole = b"".join(self.buffer)
            full = len(whole) - len(whole) % (4 * self.block)
            for at in range(0, full, 4 * self.block):
                self._flush(whole[at : at + 4 * self.block])
            self.buffer, self.held = [whole[full:]], len(whole) - full

    def _flush(self, raw: bytes) -> None:
        planes = [self.pack(p) for p in to_planes(np.frombuffer(raw, "<u4"), self.mode)]
        self.index.append((self.at, [len(p) for p in planes], len(raw) // 4))
        for p in planes:
            self.sink.write(p)
            self.at += len(p)

    def close(self) -> int:
        if self.held:
            self._flush(b"".join(self.buffer))
        nulls = np.array([k is None for k in self.keys], np.uint8)
        docs = self.pack(
            np.array([k or 0 for k in self.keys], "<i8").tobytes() + np.array(self.counts, "<i8").tobytes() + nulls.tobytes()
        )
        foot = json.dumps({"mode": self.mode, "block": self.block, "chunks": self.index, "docs": [self.at, len(docs), len(self.keys)]}).encode()
        for x in (docs, foot, struct.pack("<I", len(foot)), MAGIC):
            self.sink.write(x)
        return sum(self.counts)


class Reader:
    def __init__(self, source):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor().decompress
        end = source.seek(0, io.SEEK_END)
        tail = self._at(end - 12, 12)
        if self._at(0, 8) != MAGIC or tail[4:] != MAGIC:
            raise ValueError("not a whole file of token planes")
        (n,) = struct.unpack("<I", tail[:4])
        self.foot = json.loads(self._at(end - 12 - n, n))
        at, size, m = self.foot["docs"]
        raw = self.unpack(self._at(at, size))
        self.keys, self.counts = np.frombuffer(raw, "<i8", m), np.frombuffer(raw, "<i8", m, 8 * m)
        self.nulls = np.frombuffer(raw, np.uint8, m, 16 * m).astype(bool)

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, k: int) -> np.ndarray:
        at, sizes, n = self.foot["chunks"][k]
        raw, planes = self._at(at, sum(sizes)), []
        for size in sizes:
            planes.append(self.unpack(raw[:size]))
            raw = raw[size:]
        return from_planes(planes, n, self.foot["mode"])

    def documents(self) -> Iterator[tuple[int | None, Iterable[bytes]]]:
        """Each document's key and its ids in parts; take the parts before the next document."""
        state = {"block": np.zeros(0, "<u4"), "at": 0, "next": 0}

        def parts(n: int) -> Iterator[bytes]:
            while n:
                if state["at"] == len(state["block"]):
                    state.update(block=self.block(state["next"]), at=0, next=state["next"] + 1)
                got = state["block"][state["at"] : state["at"] + n]
                state["at"] += len(got)
                n -= len(got)
                yield got.tobytes()

        for key, null, n in zip(self.keys.tolist(), self.nulls.tolist(), self.counts.tolist(), strict=True):
            yield None if null else key, parts(n)


MANIFEST = "shard int, path string, n_docs bigint, n_tokens bigint"


def write_ids(docs: DataFrame, folder: str, vocabulary: str, kind: str = "word", end_id: int = 2, mode: str = "byte", special_as_text: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of all documents under ``folder`` in order of ``key``; returns the written manifest.

    Each attempt of a task writes a file of its own and names it in the manifest, so a retried task
    leaves nothing half written that is read.
    """
    spark = docs.sparkSession
    scratch.limit_batches(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        encode, end = encoder(vocabulary, kind, special_as_text).encode, struct.pack("<I", end_id)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        path, shard, writer = f"{root}/{uuid.uuid4().hex}.planes", TaskContext.get().partitionId(), None
        with store.open_output_stream(path) as sink:
            writer = Writer(sink, mode)
            for x in batches:
                for k, null, ids in zip(x["key"], x["no_key"], encode(x["body"].tolist()), strict=True):
                    writer.add(None if null else int(k), ids + end)
            n = writer.close()
        yield pd.DataFrame({"shard": [shard], "path": [path], "n_docs": [len(writer.keys)], "n_tokens": [n]})

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.coalesce(F.col(key), F.lit(0)).cast("long").alias("key"), F.col(key).isNull().alias("no_key"), body.alias("body"))
    order = [F.col("no_key").desc(), F.col("key"), F.xxhash64("body")]
    files = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(run, MANIFEST)
    files.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for x in batches:
            for path, start in zip(x["path"], x["start"], strict=True):
                with store.open_input_file(path) as source:
                    rows, at = [], int(start)
                    for key, parts in Reader(source).documents():
                        n, crc = 0, 0
                        for part in parts:
                            n, crc = n + len(part) // 4, zlib.crc32(part, crc)
                        rows.append((key, at, n, crc))
                        at += n
                        if len(rows) == 20_000:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    # one row a file: few, however many documents there are
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.where("n_docs > 0").select("path", before.cast("long").alias("start"))
    return files.repartition(max(1, min(files.count(), 10_000))).mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pd.DataFrame:
    x = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    return x.astype({"doc_id": "Int64"})


def token_planes(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Write the files, then read them back."""
    folder = scratch.new_path(docs.sparkSession, "planes")
    return read_ids(write_ids(docs, folder, vocabulary, **options), folder)
