"""Packing documents into sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows and pieces of at most ``PIECE`` ids. Full windows are
sequences of their own. The other pieces are packed in blocks of ``AT_ONCE`` as they stream
through a task: the differencing keeps a heap of partial partitions, each a sorted list of window
sums, and merges the two with the largest spread so that the largest sum of one meets the smallest of the
other. The windows come out nearly equal; if one exceeds the capacity, the number of windows
rises and the block is packed anew. No shuffle is needed, a task holds one block, and a block's
slack is less than about one window in two hundred.

Null texts count as empty (one end id). Rows are packed as they are: repeated rows are packed each
time, null ids stay null. Texts are of any length; an empty table gives an empty one. Other columns are
ignored, whatever their names. Sequence ids are unique, but not dense: the task's number and a
counter of its sequences.
"""

from __future__ import annotations

import bisect
import heapq
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import scratch
from fathom.llm.tokens import encoder

CAPACITY, PIECE, AT_ONCE = 2048, 512, 2048


Part = list[tuple[int, int, object]]  # (sum, tie break, members as nested pairs) of windows that are not empty, rising


def _merge(a: Part, b: Part, k: int, tie: int) -> tuple[Part, int]:
    """Join two partial partitions of ``k`` windows: the largest of one meets the smallest of the other."""
    over = len(a) + len(b) - k
    if len(b) == 1:
        x = b[0]
        if over > 0:
            least = a.pop(0)
            x, tie = (x[0] + least[0], tie, (x[2], least[2])), tie + 1
        bisect.insort(a, x)
        return a, tie
    if over <= 0:
        return sorted(a + b), tie
    out = a[over:] + b[: len(b) - over]  # these meet an empty window
    for x, y in zip(a[:over], reversed(b[len(b) - over :]), strict=True):
        out.append((x[0] + y[0], tie, (x[2], y[2])))
        tie += 1
    return sorted(out), tie


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Partition ``sizes`` into ``k`` nearly equal windows; returns the indexes of each that is not empty."""
    if k < 1:
        raise ValueError("at least one window is needed")
    parts: dict[int, Part] = {n: [(size, n, n)] for n, size in enumerate(sizes)}
    spread = lambda x: x[-1][0] - (x[0][0] if len(x) == k else 0)
    heap = [(-spread(x), n) for n, x in parts.items()]
    heapq.heapify(heap)
    fresh = tie = len(sizes)
    while len(heap) > 1:
        a, b = parts.pop(heapq.heappop(heap)[1]), parts.pop(heapq.heappop(heap)[1])
        if len(a) < len(b):
            a, b = b, a
        parts[fresh], tie = _merge(a, b, k, tie)
        heapq.heappush(heap, (-spread(parts[fresh]), fresh))
        fresh += 1
    out: list[list[int]] = []
    for part in parts.values():
        for _, _, who in part:
            stack, own = [who], []
            while stack:
                x = stack.pop()
                if isinstance(x, tuple):
                    stack.extend(x)
                else:
                    own.append(x)
            out.append(own)
    return out


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Fewest windows within ``capacity`` that differencing finds, counting up from the bound."""
    if not sizes:
        return []
    if max(sizes) > capacity:
        raise ValueError("a piece is larger than a window")
    k = -(-sum(sizes) // capacity)
    while True:
        found = difference(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return [sorted(w) for w in found if w]
        k += 1


def cut(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    full = n // capacity
    out = [(k * capacity, capacity) for k in range(full)]
    out += [(at, min(piece, n - at)) for at in range(full * capacity, n, piece)]
    return out


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, piece: int = PIECE, at_once: int = AT_ONCE, with_ids: bool = False, special_as_text: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece, with the ids themselves (little-endian unsigned 32-bit) if ``with_ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = encoder(vocabulary, "byte", special_as_text).one, struct.pack("<I", end_id)
        sequence = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        done: list[tuple] = []

        def close() -> None:
            nonlocal sequence, held
            for w in windows([p[2] for p in held], capacity):
                offset = 0
                for i in w:
                    p = held[i]
                    done.append((*p[:5], sequence, offset, p[5]))
                    offset += p[2]
                sequence += 1
            held = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[]] * (len(COLUMNS) + 1)
            done.clear()
            arrays = [pa.array(c, pa.int64()) for c in columns[:-1]]
            return pa.record_batch([*arrays, pa.array(columns[-1], pa.binary())] if with_ids else arrays, [*COLUMNS, "ids"] if with_ids else COLUMNS)

        for x in batches:
            for k, t in zip(x.column(0).to_pylist(), x.column(1), strict=True):
                ids = encode(t.as_py()) + end
                n = len(ids) // 4
                for start, length in cut(n, capacity, piece):
                    raw = ids[4 * start : 4 * (start + length)]
                    row = (k, start, length, zlib.crc32(raw), n)
                    if length == capacity:
                        done.append((*row, sequence, 0, raw if with_ids else None))
                        sequence += 1
                    else:
                        held.append((*row, raw if with_ids else None))
                        if len(held) == at_once:
                            close()
                if len(done) >= 20_000:
                    yield out()
        close()
        yield out()

    scratch.limit_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    schema = ", ".join(f"{c} long" for c in COLUMNS) + (", ids binary" if with_ids else "")
    return rows.mapInArrow(run, schema)
