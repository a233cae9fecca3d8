"""BM25 over one or several fields, for tables of queries, with dynamic pruning.

An index is packed. Each task that reads texts numbers its documents in parts of at most ``PART`` (fewer, if texts are long); a row of the index
is a term of a part with the numbers of its documents and how often each has it, or, without a term, the part's documents with their lengths.
Nothing is shuffled for that. Terms are analysed once for each distinct term of a part.

A search sends the rows of its terms, each with the queries that have the term, to the tasks that score whole parts. There a
document's place gives blocks of ``BLOCK`` documents, and the largest impact of each term in each block bounds what any document
of the block can score. The blocks that promise most are scored first; a block that cannot beat a query's k-th best score so far,
in this part or in those that the task had before, is left out. The result is that of scoring all.
A collection keeps the index sorted by a hash of the term, so that a search reads only the row groups its terms are in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from fathom.functions import stemming
from fathom.functions import text as T
from fathom.sources import workspace

K1, B = 1.2, 0.75
#: Rows of terms that may be broadcast (about 50 bytes each).
BROADCAST_TERMS = 1_000_000
#: Parts that a kept index is sorted into, and the one of the rows that stand for documents.
SHARDS, DOCUMENTS = 1024, -1
#: Up to so many parts a search names those that it needs.
NAMED = 256
#: Documents of a part and of a block, and queries that are scored together: a part has a row for each of its terms, most of which few documents have.
PART, BLOCK, QUERIES = 16_384, 64, 128
#: A part that has so many terms, repeated ones too, ends there.
FULL = 2_000_000
#: So many times ``QUERIES`` go with one copy of the postings, and parts that a task scores, about.
TOGETHER, PARTS = 32, 8
#: Queries whose numbers with a term take about as much as a row of it.
LISTED = 512
#: Products of a query's term and a document that are made at a time.
PRODUCTS = 1_000_000
#: Parts whose places that still count may be broadcast (at most ``PART`` bytes each).
BROADCAST_PARTS = 1024
#: Digits that scores are rounded to, and what a bound may be off by.
DIGITS, SLACK = 9, 1e-8

# The stop words of the usual English analyzer.
ENGLISH_STOPS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def english_term(term: str) -> str | None:
    """A term without its possessive, stemmed after Porter; nothing of stop words."""
    if term.endswith(("'s", "’s")):
        term = term[:-2]
    return stemming.stem(term) if term and term not in ENGLISH_STOPS else None


def english_tokens(c) -> Column:
    """The same for a text; for small tables such as queries."""
    bare = F.transform(T.tokens(c), lambda x: F.regexp_replace(x, r"['’]s$", ""))
    return stemming.porter(F.filter(bare, lambda x: ~x.isin(ENGLISH_STOPS) & (x != "")))


def doc_lengths(docs: DataFrame, key: str, field: str, analyze=T.tokens) -> DataFrame:
    return workspace.spread(docs.select(key, field)).select(F.col(key).alias(key), F.size(analyze(field)).cast("long").alias("dl"))


def field_stats(docs: DataFrame, field: str, analyze=T.tokens) -> DataFrame:
    dl = F.size(analyze(field))
    return workspace.spread(docs.select(field)).select(dl.alias("dl")).where("dl > 0").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def term_stats(docs: DataFrame, key: str, field: str, analyze=T.tokens) -> DataFrame:
    rows = workspace.spread(docs.select(field)).select(F.explode(F.array_distinct(analyze(field))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame, qid: str = "qid", query: str = "query", analyze=T.tokens) -> DataFrame:
    """A term counts as often as the query has it."""
    rows = queries.select(F.col(qid).alias("qid"), F.explode(analyze(query)).alias("term"))
    return rows.groupBy("qid", "term").agg(F.count("*").alias("qtf"))


@dataclass
class Index:
    """Packed ``rows``: part, field, term, docs, tf; and without a term: keys, dl. ``key`` names the documents in results."""

    rows: DataFrame
    key: str
    #: The queries whose terms alone it has; None if it has all.
    wanted: Asked | None = None
    #: part, live: of the parts that lost documents, whether each place still counts. None if none lost any.
    live: DataFrame | None = None

    @property
    def postings(self) -> DataFrame:
        return self.rows.where("term is not null")

    @property
    def documents(self) -> DataFrame:
        """With ``live``; lengths of documents that do not count any more are 0."""
        found = self.rows.where("term is null")
        found = self.with_live(found.where(F.col("shard") == DOCUMENTS) if "shard" in self.rows.columns else found)
        return found.withColumn("dl", F.when(F.col("live").isNull(), F.col("dl")).otherwise(F.zip_with("dl", "live", lambda n, on: F.when(on, n).otherwise(F.lit(0)))))

    def with_live(self, rows: DataFrame) -> DataFrame:
        """``rows`` with a column ``live``, null where all places of the part count."""
        return rows.withColumn("live", F.lit(None).cast("array<boolean>")) if self.live is None else rows.join(self.live, "part", "left")

    def frequencies(self, postings: DataFrame) -> DataFrame:
        """field, term, df of some of the postings."""
        left = F.when(F.col("live").isNull(), F.size("docs")).otherwise(F.size(F.filter("docs", lambda x: F.get(F.col("live"), x))))
        return self.with_live(postings).groupBy("field", "term").agg(F.sum(left).alias("df")).where("df > 0")

    @property
    def terms(self) -> DataFrame:
        """field, term, df."""
        return self.frequencies(self.postings)

    @property
    def stats(self) -> DataFrame:
        """field, n, avgdl of the documents that have a term; one row a field."""
        some = F.filter("dl", lambda x: x > 0)
        total = F.aggregate(some, F.lit(0).cast("long"), lambda s, x: s + x)
        found = self.documents.groupBy("field").agg(F.sum(F.size(some)).alias("n"), F.sum(total).alias("total"))
        return found.select("field", "n", (F.col("total") / F.col("n")).alias("avgdl"))


def shard(term: str = "term") -> Column:
    return F.when(F.col(term).isNull(), F.lit(DOCUMENTS)).otherwise(F.pmod(F.xxhash64(term), F.lit(SHARDS))).cast("int")


#: Analyses that go term by term: what cuts the text, and what becomes of a term.
TERMWISE: dict[Callable, tuple[Callable, Callable[[str], str | None]]] = {english_tokens: (T.tokens, english_term)}


#: Analyses by which texts with white space between them have the terms of each, one after the other.
BY_TERMS = {T.tokens, english_tokens}


@dataclass
class _Terms:
    """The terms of texts: ``words``, and for each place in a text the number of its word and that of the text."""

    words: pa.Array
    at: np.ndarray
    doc: np.ndarray


def _terms(lists: pa.Array, term: Callable[[str], str | None] | None) -> _Terms:
    """``lists``: the terms of each document."""
    lists = lists.fill_null([]) if lists.null_count else lists
    codes = lists.flatten().dictionary_encode()
    words, at = codes.dictionary, codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(lists.offsets.to_numpy())
    doc = np.repeat(np.arange(len(lists), dtype=np.int64), size)
    if term is not None:
        became = [term(w) for w in words.to_pylist()]
        known = {w: n for n, w in enumerate(dict.fromkeys(w for w in became if w is not None))}
        place = np.array([-1 if w is None else known[w] for w in became], np.int64)
        at = place[at]
        at, doc, words = at[at >= 0], doc[at >= 0], pa.array(list(known), pa.string())
    return _Terms(words.cast(pa.string()), at, doc)


def _together(parts: list[_Terms]) -> _Terms:
    """The terms of texts that are in several parts."""
    if len(parts) == 1:
        return parts[0]
    words = pa.concat_arrays([p.words for p in parts]).dictionary_encode()
    number, first = words.indices.to_numpy().astype(np.int64), np.cumsum([0] + [len(p.words) for p in parts])
    return _Terms(words.dictionary, np.concatenate([number[n:][p.at] for n, p in zip(first, parts, strict=False)]), np.concatenate([p.doc for p in parts]))


def _packed(terms: _Terms, n: int, name: str, field_: str) -> tuple[pa.Table, np.ndarray]:
    """The rows of the terms of a part of ``n`` documents, and the documents' lengths."""
    words, at, doc = terms.words, terms.at, terms.doc
    pair, tf = np.unique(at * n + doc, return_counts=True)
    code, docs = np.divmod(pair, n) if n else (pair, pair)
    first = np.searchsorted(code, np.arange(len(words) + 1))
    ints = lambda x: pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x, pa.int32()))
    same = lambda v: pa.array(np.full(len(words), v, object), pa.string())
    return pa.table({"part": same(name), "field": same(field_), "term": words, "docs": ints(docs), "tf": ints(tf)}), np.bincount(doc, minlength=n)


def _parts(batches: Iterator[pa.RecordBatch], lists: list[str], size: int, full: int) -> Iterator[pa.Table]:
    """Rows in tables of ``size``, wherever batches end; those whose ``lists`` have ``full`` terms before end there, and the last one."""
    held, n, terms = [], 0, 0
    for batch in batches:
        at, each = 0, np.zeros(batch.num_rows, np.int64)
        for c in lists:
            each += pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(each)
        while at < batch.num_rows:
            before = int(upto[at - 1]) if at else 0
            end = min(at + size - n, int(np.searchsorted(upto, before + full - terms)) + 1, batch.num_rows)
            held.append(batch.slice(at, end - at))
            n, terms, at = n + end - at, terms + int(upto[end - 1]) - before, end
            if n == size or terms >= full:
                yield pa.Table.from_batches(held)
                held, n, terms = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def index(
    docs: DataFrame, key: str, fields: list[str], analyze=T.tokens, owner: str | None = None, wanted: Asked | None = None, made_of: dict[str, list[str]] | None = None
) -> Index:
    """The index of ``fields``, of all terms or of those of ``wanted``, kept by the executors.

    ``owner``: a column (string) that deletions name documents by, carried in ``owners``. Such an index is written once, and not kept besides.
    ``made_of``: the columns that a field is put together from with white space between, for analyses ``BY_TERMS``; their texts are analysed once
    for all fields. A row without the first of them has none.
    """
    cut, term = TERMWISE.get(analyze, (analyze, None))
    fields = list(dict.fromkeys(fields))
    kind, own = docs.schema[key].dataType.simpleString(), ([owner] if owner else [])
    parts = {f: (made_of or {}).get(f, [f]) for f in fields}
    texts: dict[tuple[str, str], str] = {}
    for first, *more in parts.values():
        for c in (first, *more):
            texts.setdefault((c, first), f"w{len(texts)}")
    analysed = [(cut(c) if c == first else F.when(F.col(first).isNotNull(), cut(c))).alias(w) for (c, first), w in texts.items()]
    names = {f: [texts[c, of[0]] for c in of] for f, of in parts.items()}
    columns = list(dict.fromkeys([key, *own, *[c for c, _ in texts]]))
    rows = workspace.spread(docs.select(*columns), key)
    # numbers of documents must come out the same where a lost partition is made again
    rows = rows.sortWithinPartitions(key)
    rows = rows.select(F.col(key).alias("key"), F.col(owner or key).cast("string").alias("owner"), *analysed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        each = lru_cache(maxsize=200_000)(term) if term is not None else None
        for some in _parts(batches, list(texts.values()), PART, FULL):
            name, n = f"{task}-{n}", n + 1
            # arrays of one chunk without an offset
            whole = lambda c, some=some: pa.concat_arrays(some.column(c).chunks)
            keys, owners = whole("key"), whole("owner")
            terms = {w: _terms(whole(w), each) for w in texts.values()}
            for f in fields:
                made, dl = _packed(_together([terms[w] for w in names[f]]), some.num_rows, name, f)
                none = lambda kind, made=made: pa.nulls(made.num_rows, kind)
                one = lambda x, kind: pa.array([x], pa.list_(kind))
                yield from pa.table({**{c: made[c] for c in ("part", "field", "term", "docs", "tf")}, "keys": none(pa.list_(keys.type)), "owners": none(pa.list_(pa.string())), "dl": none(pa.list_(pa.int32()))}).to_batches()
                as_list = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.record_batch({"part": pa.array([name]), "field": pa.array([f]), "term": pa.nulls(1, pa.string()), "docs": pa.nulls(1, pa.list_(pa.int32())), "tf": pa.nulls(1, pa.list_(pa.int32())), "keys": as_list(keys), "owners": as_list(owners), "dl": one(dl.tolist(), pa.int32())})

    made = rows.mapInArrow(run, f"part string, field string, term string, docs array<int>, tf array<int>, keys array<{kind}>, owners array<string>, dl array<int>")
    if wanted is not None:  # rows of documents pass as well
        terms = wanted.words().union(docs.sparkSession.range(1).select(F.lit(None).cast("string"))).withColumnRenamed("term", "t")
        made = made.join(wanted.near(terms), F.expr("term <=> t"), "left_semi")
    return Index(made if owner else workspace.cached(made.drop("owners")), key, wanted)


# --- scoring ---


@dataclass
class _Best:
    """The best ``k`` of each query among the parts that a task has seen, as flat rows by query and falling score."""

    n: int
    k: int
    q: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    score: np.ndarray = field(default_factory=lambda: np.zeros(0))
    key: np.ndarray | None = None
    pairs: int = 0

    def least(self) -> np.ndarray:
        """The k-th best score of each query so far; none where it has fewer."""
        out = np.full(self.n, -np.inf)
        place = np.arange(len(self.q)) - np.searchsorted(self.q, self.q)
        out[self.q[place == self.k - 1]] = self.score[place == self.k - 1]
        return out

    def add(self, q: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        if self.key is not None:
            q, score, key = np.concatenate([self.q, q]), np.concatenate([self.score, score]), np.concatenate([self.key, key])
        order = np.lexsort((np.unique(key, return_inverse=True)[1], -score, q))
        q, score, key = q[order], score[order], key[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.q, self.score, self.key = q[first], score[first], key[first]


def _within(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that stand ``counts`` times each: the row's number, and 0, 1, ... within the row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _slices(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Rows in slices whose counts add up to about ``most``."""
    edges = np.searchsorted(np.cumsum(counts), np.arange(most, int(counts.sum()) + most, most), "left") + 1
    edges = np.unique(np.append(0, np.minimum(edges, len(counts))))
    yield from map(slice, edges[:-1], edges[1:])


class _Field:
    """The rows of the queries' terms in one field of a part, flat: postings, stretches of one term and block, and pairs of a query and a term."""

    def __init__(self, rows: pa.Table | pd.DataFrame, dl: np.ndarray, boost: float):
        rows = (pa.Table.from_pandas(rows) if isinstance(rows, pd.DataFrame) else rows).combine_chunks()
        lists = {c: rows.column(c).chunk(0) for c in ("docs", "tf", "qs", "qtfs")}
        flat = lambda c, kind: lists[c].flatten().to_numpy(zero_copy_only=False).astype(kind)
        size = lists["docs"].value_lengths().to_numpy(zero_copy_only=False)
        start = np.append(0, np.cumsum(size))
        self.docs = flat("docs", np.int64)
        tf = flat("tf", float)
        each = lambda c: np.repeat(rows.column(c).to_numpy().astype(float), size)
        self.impact = each("idf") * (tf / (tf + K1 * ((1 - B) + B * dl[self.docs] / each("avgdl"))))
        block = self.docs // BLOCK
        new = np.ones(len(block), bool)
        new[1:] = block[1:] != block[:-1]
        new[start[:-1]] = True
        self.begin = np.flatnonzero(new)
        self.length = np.diff(np.append(self.begin, len(block)))
        self.block, self.most = block[self.begin], np.maximum.reduceat(self.impact, self.begin)
        run = np.searchsorted(self.begin, start)
        row = np.repeat(np.arange(len(size)), lists["qs"].value_lengths().to_numpy(zero_copy_only=False))
        self.q, self.qtf = flat("qs", np.int64), flat("qtfs", float)
        self.run, self.runs, self.products, self.boost = run[row], np.diff(run)[row], size[row], boost

    def of(self, first: int, last: int) -> _Field:
        """The same for the queries from ``first`` up to ``last``, numbered from 0."""
        own, out = (self.q >= first) & (self.q < last), copy(self)
        out.q = self.q[own] - first
        out.qtf, out.run, out.runs, out.products = self.qtf[own], self.run[own], self.runs[own], self.products[own]
        return out

    def _stretches(self, pairs: slice) -> tuple[np.ndarray, np.ndarray]:
        pair, n = _within(self.runs[pairs])
        return pair + pairs.start, self.run[pairs][pair] + n

    def bounds(self, n: int, blocks: int) -> np.ndarray:
        """What no document of a block can exceed, for each query."""
        out = np.zeros(n * blocks)
        for pairs in _slices(self.runs, PRODUCTS):
            pair, run = self._stretches(pairs)
            out += np.bincount(self.q[pair] * blocks + self.block[run], self.qtf[pair] * self.most[run], n * blocks)
        return out.reshape(n, blocks) * self.boost

    def scores(self, wanted: np.ndarray, docs: int) -> tuple[np.ndarray, int]:
        """The scores of the wanted blocks of each query, and how many products that took."""
        out, made = np.zeros(len(wanted) * docs), 0
        for pairs in _slices(self.products, PRODUCTS):
            pair, run = self._stretches(pairs)
            chosen = wanted[self.q[pair], self.block[run]]
            pair, run = pair[chosen], run[chosen]
            which, n = _within(self.length[run])
            at = self.begin[run][which] + n
            out += np.bincount(self.q[pair][which] * docs + self.docs[at], self.qtf[pair][which] * self.impact[at], len(out))
            made += len(at)
        return out.reshape(len(wanted), docs) * self.boost, made


def score_part(fields: list[_Field], keys: np.ndarray, best: _Best, live: np.ndarray | None = None) -> None:
    """The documents of a part (those of ``live``) against the queries of ``best``, block by block where that can matter."""
    n, blocks = best.n, -(-len(keys) // BLOCK)
    bound = np.max([f.bounds(n, blocks) for f in fields], axis=0)
    least, left = best.least(), bound > 0
    # for queries that lack a k-th score: first the blocks of the highest bounds that hold k documents
    some = np.argsort(-bound, axis=1, kind="stable")[:, : -(-best.k // BLOCK) + 1]
    start = np.zeros_like(left)
    np.put_along_axis(start, some, True, 1)
    for wanted in (start & left, left & ~start):
        wanted = wanted & (bound + SLACK >= best.least()[:, None] if wanted is not start else True)
        if not wanted.any():
            continue
        total = None
        for f in fields:
            own, made = f.scores(wanted, len(keys))
            best.pairs += made
            total = own if total is None else np.maximum(total, own)
        if live is not None:
            total[:, ~live] = 0
        score = np.rint(total * 10**DIGITS) / 10**DIGITS
        least = np.maximum(best.least() - SLACK, 0)
        q, d = np.nonzero((score > 0) & (score >= least[:, None]))
        if len(q) > 4 * best.k * n:  # many rows: the k-th of each query in this part alone
            kth = -np.partition(-score, min(best.k, score.shape[1]) - 1, axis=1)[:, min(best.k, score.shape[1]) - 1]
            q, d = np.nonzero((score > 0) & (score >= np.maximum(least, kth)[:, None]))
        best.add(q, score[q, d], keys[d])


@dataclass
class Asked:
    """Queries numbered within chunks (qid, chunk, q), and their terms with the queries that have them (chunk, term, qs, qtfs)."""

    numbered: DataFrame
    terms: DataFrame
    chunks: int
    small: bool

    @staticmethod
    def of(queries: DataFrame, analyze=T.tokens) -> Asked:
        # how many queries and words there are, about, is counted while they are written
        seen = Observation()
        rows = query_terms(queries, analyze=analyze).observe(seen, F.approx_count_distinct("qid").alias("n"), F.approx_count_distinct("term").alias("words"))
        terms = workspace.written(rows, "terms")
        n, words = int(1.1 * (seen.get["n"] or 0)), int(1.1 * (seen.get["words"] or 0))
        chunks = max(1, -(-n // (QUERIES * TOGETHER)))
        ids = terms.select("qid").distinct().withColumn("chunk", F.pmod(F.xxhash64("qid"), F.lit(chunks)).cast("int"))
        numbered = ids.withColumn("q", (F.row_number().over(Window.partitionBy("chunk").orderBy("qid")) - 1).cast("int"))
        rows = F.array_sort(F.collect_list(F.struct("q", F.col("qtf").cast("int").alias("qtf"))))
        grouped = terms.join(numbered, "qid").groupBy("chunk", "term").agg(rows.alias("r"))
        grouped = workspace.written(grouped.select("chunk", "term", F.col("r.q").alias("qs"), F.col("r.qtf").alias("qtfs")), "asked")
        return Asked(numbered, grouped, chunks, words * max(1, -(-n // LISTED)) <= BROADCAST_TERMS)

    def near(self, df: DataFrame) -> DataFrame:
        """A table of terms, broadcast if it is small."""
        return F.broadcast(df) if self.small else df

    def words(self) -> DataFrame:
        return self.terms.select("term").distinct()


def _whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows of whole parts, which lie together while batches end anywhere, each with its chunk."""
    held, last = [], None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        chunk, part = batch.column("chunk").to_numpy(), batch.column("part").dictionary_encode()
        code = part.indices.to_numpy()
        new = np.flatnonzero((chunk[1:] != chunk[:-1]) | (code[1:] != code[:-1])) + 1
        for a, b in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
            name = int(chunk[a]), part.dictionary[int(code[a])].as_py()
            if held and name != last:
                yield last[0], pa.Table.from_batches(held)
                held = []
            last = name
            held.append(batch.slice(a, b - a))
    if held:
        yield last[0], pa.Table.from_batches(held)


def search_index(index_: Index, queries: DataFrame | Asked, k: int, fields: dict[str, float], analyze=T.tokens) -> DataFrame:
    """qid, key, score, rank: the best of the fields' boosted scores, of documents that have a term. Scores are rounded to 9 digits; ties by rising key."""
    asked = queries if isinstance(queries, Asked) else Asked.of(queries, analyze)
    numbered, chunks, near = asked.numbered, asked.chunks, asked.near
    found = index_.postings.where(F.col("field").isin(list(fields)))
    if "shard" in found.columns:  # row groups without these parts are skipped
        parts = [r.shard for r in asked.words().select(shard().alias("shard")).distinct().limit(NAMED + 1).collect()]
        found = found.where(F.col("shard").isin(parts)) if len(parts) <= NAMED else found
    found = found if index_.wanted is asked else found.join(near(asked.words()), "term", "left_semi")
    found = found.select("part", "field", "term", "docs", "tf")
    df = index_.frequencies(found).join(F.broadcast(index_.stats), "field")  # a row a field
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    known = df.select("field", "term", idf.alias("idf"), "avgdl").join(asked.terms, "term")
    rows = found.join(near(known), ["field", "term"]).select("chunk", "part", "field", F.lit(1).alias("kind"), "docs", "tf", "idf", "avgdl", "qs", "qtfs")
    key_type = index_.rows.schema["keys"].dataType.simpleString()
    null = lambda kind: F.lit(None).cast(kind)
    papers = index_.documents.where(F.col("field").isin(list(fields)))
    parts = -(-papers.select("field").count() // len(fields))
    # the names of a part's documents go with one of its fields
    first = F.when(F.col("field") == next(iter(fields)), F.col("keys")).alias("keys")
    papers = papers.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "part", "field", F.lit(0).alias("kind"), first, "dl", "live")
    rows = papers.unionByName(rows, allowMissingColumns=True)
    slices = max(1, -(-max(2 * rows.sparkSession.sparkContext.defaultParallelism, parts * chunks // PARTS) // chunks))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("part"), F.lit(slices)).cast("int"))
    rows = rows.repartition(min(20_000, chunks * slices), *(["chunk", "slice"] if chunks > 1 else ["part"])).sortWithinPartitions("chunk", "part", "field", "kind")
    kind = key_type.removeprefix("array<").removesuffix(">")
    boosts = dict(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bests, names = None, {}, None

        def out() -> Iterator[pa.RecordBatch]:
            for n, best in bests.items():
                for at in range(0, len(best.q), 100_000):
                    q, key, score = (x[at : at + 100_000] for x in (best.q, best.key, best.score))
                    yield pa.record_batch({"chunk": pa.array(np.full(len(q), now, np.int32)), "q": pa.array((q + n * QUERIES).astype(np.int32)), "key": pa.array(key, names), "score": pa.array(score)})

        for chunk, part in _whole_parts(batches):
            if chunk != now:
                yield from out()
                now, bests = chunk, {}
            made, keys, live = [], None, None
            for f, boost in boosts.items():
                own = part.filter(pc.equal(part.column("field"), f))
                if own.num_rows and own.column("kind")[0].as_py() == 0:
                    if keys is None:
                        names, keys = own.column("keys").type.value_type, own.column("keys")[0].values.to_numpy(zero_copy_only=False)
                        live = own.column("live")[0]
                    if own.num_rows > 1:
                        made.append(_Field(own.slice(1), own.column("dl")[0].values.to_numpy().astype(float), boost))
            live = live.values.to_numpy(zero_copy_only=False).astype(bool) if live is not None and live.is_valid else None
            most = max((int(f.q.max()) + 1 for f in made), default=0)
            for n in range(-(-most // QUERIES)):
                some = [f.of(n * QUERIES, (n + 1) * QUERIES) for f in made]
                best = bests.setdefault(n, _Best(0, k))
                best.n = max(best.n, min(QUERIES, most - n * QUERIES))
                score_part(some, keys, best, live)
        yield from out()

    found = rows.mapInArrow(run, f"chunk int, q int, key {kind}, score double").join(numbered, ["chunk", "q"])
    return top(found.select("qid", F.col("key").alias(index_.key), "score"), k, index_.key)


def top(ranked: DataFrame, k: int, key: str, by: str = "qid", score: str = "score") -> DataFrame:
    """The best k of each query with their rank; ties by rising key."""
    order = Window.partitionBy(by).orderBy(F.desc(score), F.asc(key))
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", fields: dict[str, float] | None = None, analyze=T.tokens) -> DataFrame:
    """``search_index`` over the part of the index that these queries need."""
    fields = fields or {"text": 1.0}
    asked = Asked.of(queries, analyze)
    return search_index(index(docs, key, list(fields), analyze, wanted=asked), asked, k, fields)
