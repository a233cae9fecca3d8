"""Periodic runs of words: repeated k-grams mask the text, and Main-Lorentz searches what is left.

A run is a stretch of words with smallest period q, at least ``max(least, exponent * q)`` words long,
that no neighbouring word extends. Shifted by q it covers itself in ``max(least, exponent * q) - q``
words or more; ``overlap`` gives the least of these over all q, and that is k. So each word of a run
is in a k-gram that the document has twice. Words outside such k-grams cannot be in any run: they are
masked, and only the segments between them are searched.

The segments of many documents are searched together by numpy. Main and Lorentz halve a segment again
and again: a run that lies over a cut has two periods or more on one side of it (as ``exponent`` is at
least 4), so for each length p up to half a side it is asked how far the words after the cut agree
with those p later, and likewise before it. How far two places agree comes from names of all
stretches of 1, 2, 4, ... words, which are exact. Time is O(n log^2 n) for n words, whatever they are.

Null and empty texts have no words, no runs, and an empty rest. Texts of any length are read whole. Repeated rows
are judged alike, rows without doc_id by the text as it stands. Equal runs (same start and end) found under several
multiples of their period count once, with the smallest. An empty table gives an empty one. Other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import scratch

LEAST, EXPONENT = 6, 4
#: Words of segments that are searched together; a longer document is searched alone.
TOGETHER = 200_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def overlap(least: int = LEAST, exponent: int = EXPONENT) -> int:
    """The fewest words in which a run covers itself, shifted by its period; beyond ``least`` the second term only grows."""
    return min(max(least, exponent * q) - q for q in range(1, least + 1))


def _names(*columns: np.ndarray) -> np.ndarray:
    """A number for each place, equal where all columns are."""
    code = columns[0].astype(np.int64)
    for c in columns[1:]:
        code = np.unique(code * (int(c.max(initial=0)) + 1) + c, return_inverse=True)[1]
    return code


def repeated(ids: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Which places are in a k-gram that their document has at least twice; ``ids``: words numbered within documents."""
    n = len(ids) - k + 1
    covered = np.zeros(len(ids), bool)
    if n < 1:
        return covered
    whole = doc[:n] == doc[k - 1 :]
    # names of k-grams by doubling: stretches of 1, 2, 4, ... words, then two that overlap
    width, name = 1, _names(doc, ids)
    while 2 * width <= k:
        name, width = _names(name[: len(ids) - 2 * width + 1], name[width : len(ids) - width + 1]), 2 * width
    name = _names(name[:n], name[k - width : k - width + n])
    name = np.where(whole, name, -1)
    _, at, count = np.unique(name, return_inverse=True, return_counts=True)
    twice = (count[at] > 1) & whole
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += twice
    edge[k : k + n] -= twice
    return np.cumsum(edge[:-1]) > 0


class _Agreement:
    """How far places of a text agree, by exact names of stretches of 1, 2, 4, ... words.

    Words of different segments differ: each segment ends in a place of its own that equals no other.
    """

    def __init__(self, ids: np.ndarray, longest: int):
        self.names, width = [ids], 1
        while 2 * width <= longest:
            last = self.names[-1]
            self.names.append(_names(last[:-width], last[width:]))
            width *= 2

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` on equal those from ``b`` on."""
        n = np.zeros(len(a), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            name = self.names[j]
            x, y = a + n, b + n
            ok = (x < len(name)) & (y < len(name))
            ok[ok] = name[x[ok]] == name[y[ok]]
            n += ok.astype(np.int64) << j
        return n

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words up to ``a`` (exclusive) equal those up to ``b``."""
        n = np.zeros(len(a), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            name = self.names[j]
            x, y = a - n - (1 << j), b - n - (1 << j)
            ok = (x >= 0) & (y >= 0)
            ok[ok] = name[x[ok]] == name[y[ok]]
            n += ok.astype(np.int64) << j
        return n


def _each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that stand ``counts`` times each: the row's number, and 1, 2, ... within the row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + 1


def main_lorentz(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Rows of start, end, period of all runs within the segments, by start and period.

    After each segment, at its end, ``ids`` has a place of its own that equals no other.
    """
    if exponent < 4:
        raise ValueError("a run over a cut needs two periods on one side of it: exponent must be at least 4")
    found = []
    longest = int((ends - starts).max(initial=0))
    if longest < least:
        return np.zeros((0, 3), np.int64)
    agree = _Agreement(ids, longest)
    lo, hi = starts, ends
    while len(lo):
        mid = (lo + hi) // 2
        # two periods or more after the cut
        row, p = _each((hi - mid) // 2)
        m = mid[row]
        near = ids[m] == ids[m + p]
        row, p, m = row[near], p[near], m[near]
        right = agree.after(m, m + p)
        ok = right >= p
        p, m, right = p[ok], m[ok], right[ok]
        found.append(np.stack([m - agree.before(m, m + p), m + p + right, p], 1))
        # two periods or more before it
        row, p = _each((mid - lo) // 2)
        m = mid[row]
        near = ids[m - 1] == ids[m - 1 - p]
        row, p, m = row[near], p[near], m[near]
        left = agree.before(m, m - p)
        ok = left >= p
        p, m, left = p[ok], m[ok], left[ok]
        found.append(np.stack([m - p - left, m + agree.after(m, m - p), p], 1))
        # a half shorter than a run has none of its own
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        ok = hi - lo >= least
        lo, hi = lo[ok], hi[ok]
    rows = np.concatenate(found)
    rows = rows[rows[:, 1] - rows[:, 0] >= np.maximum(least, exponent * rows[:, 2])]
    # multiples of a period give the same stretch: the smallest stays
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of(documents: list[list[str]], least: int = LEAST, exponent: int = EXPONENT) -> list[np.ndarray]:
    """Start, end, period of the runs of each document, given as words."""
    k = overlap(least, exponent)
    empty = np.zeros((0, 3), np.int64)
    out, ids, lengths = [empty] * len(documents), [], [len(w) for w in documents]
    for words in documents:
        known: dict[str, int] = {}
        ids += [known.setdefault(w, len(known)) for w in words]
    ids, lengths = np.asarray(ids, np.int64), np.asarray(lengths, np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    kept = repeated(ids, doc, k)
    if not kept.any():
        return out
    # segments: stretches of kept places of one document
    at = np.flatnonzero(kept)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (np.diff(doc[at]) > 0)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    long = size >= least
    if not long.any():
        return out
    keep = np.repeat(long, size)
    at, first, size = at[keep], np.append(0, np.cumsum(size[long])[:-1]), size[long]
    # a place of its own behind each segment
    segment = np.repeat(np.arange(len(size)), size)
    text = np.empty(len(at) + len(size), np.int64)
    text[np.arange(len(at)) + segment] = ids[at]
    starts = first + np.arange(len(size))
    text[starts + size] = int(ids.max()) + 1 + np.arange(len(size))
    rows = main_lorentz(text, starts, starts + size, least, exponent)
    if not len(rows):
        return out
    own = np.searchsorted(starts, rows[:, 0], "right") - 1
    shift = at[first[own]] - starts[own]  # from places of the text to places of all words
    begin = np.append(0, np.cumsum(lengths)[:-1])
    which = doc[at[first[own]]]
    shift = shift - begin[which]
    rows = np.stack([rows[:, 0] + shift, rows[:, 1] + shift, rows[:, 2]], 1)
    # a document may have several segments; they follow each other
    edges = np.searchsorted(which, np.arange(len(lengths) + 1))
    for d in np.unique(which):
        out[d] = rows[edges[d] : edges[d + 1]]
    return out


def collapsed(words: list[str], runs: np.ndarray) -> list[str]:
    """The words without those that a run has after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(words, gone, strict=True) if not g]


def planted(words: list[str], doc_id: str | None) -> list[str]:
    """The words with a period of their own from some word on, in one of ten documents by the checksum of their decimal id."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(doc_id.encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _batches(words: Iterator[tuple[int, list[str]]], most: int) -> Iterator[list[tuple[int, list[str]]]]:
    held, n = [], 0
    for x in words:
        if held and n + len(x[1]) > most:
            yield held
            held, n = [], 0
        held.append(x)
        n += len(x[1])
    if held:
        yield held


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", plant: bool = False, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """``key``, runs (by start, then period) and the collapsed text of each row, in one pass without a shuffle."""
    scratch.limit_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            cut = ((n, planted(w, i) if plant else w) for n, (i, w) in enumerate((i, _WORD.findall(t or "")) for i, t in zip(x["k"], x["t"], strict=True)))
            for part in _batches(cut, TOGETHER):
                runs = runs_of([w for _, w in part], least, exponent)
                yield pd.DataFrame({
                    "k": x["k"].iloc[[n for n, _ in part]].to_numpy(),
                    "runs": [[{"start": int(s), "length": int(e - s), "period": int(p)} for s, e, p in r] for r in runs],
                    "collapsed": [" ".join(collapsed(w, r)) for (_, w), r in zip(part, runs, strict=True)],
                })

    rows = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    return rows.mapInPandas(run, f"k string, runs {RUNS}, collapsed string").select(F.col("k").cast(kind).alias(key), "runs", "collapsed")


def run_report(docs: DataFrame) -> DataFrame:
    """The digest of ``find_runs`` with planted periods: counts, the longest run, and checksums."""
    found = find_runs(docs, plant=True)
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r.length).alias("m"), r.start.alias("start"), r.period.alias("period"), r.length.alias("length")))), 1)
    best = F.when(F.size("runs") > 0, best)
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r.start, r.length, r.period)), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    milli = F.floor(F.lit(1000) * F.col("b.length") / F.col("b.period")).cast("long")
    return out.select("doc_id", "n_runs", "b.start", "b.length", "b.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def report_sql(least: int = LEAST, exponent: int = EXPONENT) -> str:
    """``run_report`` in DuckDB's SQL: pairs of equal k-grams at a distance that can be a period, and their stretches."""
    k = overlap(least, exponent)
    crc = "list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::UBIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1))))"
    return rf"""
WITH d0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o, xor({crc}, 4294967295::UBIGINT)::BIGINT AS h FROM documents),
d1 AS (SELECT *, len(o) AS n, h // 10 AS g FROM d0),
d2 AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM d1),
d3 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM d2),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN o[i + 1] ELSE o[a + (i - a) % p + 1] END) ELSE o END AS w FROM d3),
gram AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + {k}], ' ') AS t FROM (SELECT *, unnest(range(0, n - {k - 1})) AS i FROM d)),
pair AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM gram x JOIN gram y ON x.doc_id = y.doc_id AND x.t = y.t AND x.i < y.i AND {exponent} * (y.i - x.i) <= x.n),
isle AS (SELECT doc_id, q, min(i) AS s, max(i) + {k} + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM pair) GROUP BY doc_id, q, isle),
run AS (SELECT doc_id, s, e - s AS l, min(q) AS q FROM isle WHERE e - s >= greatest({least}, {exponent} * q) GROUP BY doc_id, s, e),
best AS (SELECT doc_id, s, l, q FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l DESC, s, q) = 1),
text AS (SELECT doc_id, count(*) AS n, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM run),
word AS (SELECT doc_id, unnest(range(0, n)) AS i, unnest(w) AS w FROM d),
rest AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(text.n, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli,
  sha256(coalesce(text.t, '')) AS runs_sha256, sha256(coalesce(rest.t, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN text USING (doc_id) LEFT JOIN rest USING (doc_id)
"""
