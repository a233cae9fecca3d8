"""All queries over the retrieval operators, with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.operators import chunking, dense, evaluate, fusion, lexical, prompting, resolve, router, semantic
from fathom.operators.vector_index import VectorIndex
from fathom.plans import contextual
from fathom.plans.providers import CoverageReranker, ExtractiveGenerator
from fathom.sources.tables import document_pages, page_segments, table
from fathom.sources.workspace import new_folder, spread, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- parts of the SQL ---------------------------------------------------------------------------

_WORDS = r"list_filter(string_split(trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g')), ' '), lambda x: x <> '')"


def _cut(source: str, keys: str, size: int, overlap: int, index: str) -> str:
    step = size - overlap
    return f"""SELECT {keys}, i AS {index}, array_to_string(w[i * {step} + 1:i * {step} + {size}], ' ') AS content
  FROM (SELECT *, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE 1 + greatest(ceil((len(w) - {size}) / {step}.0), 0)::BIGINT END)) AS i FROM {source})"""


_PARENTS = f"""
w1 AS (SELECT doc_id::VARCHAR AS doc_id, source AS filename, 1 AS page, {_WORDS.format('text')} AS w FROM documents),
p1 AS ({_cut('w1', 'doc_id, filename, page', 1000, 150, 'p_idx')}),
parents AS (SELECT doc_id || '_p_' || p_idx || '_' || substr(md5(doc_id || '|' || page || '|' || p_idx), 1, 8) AS parent_id, doc_id, filename, content,
  page AS page_start, page AS page_end FROM p1)"""
_CHILDREN = f"""{_PARENTS},
w2 AS (SELECT *, {_WORDS.format('content')} AS w FROM parents),
c1 AS ({_cut('w2', 'parent_id, doc_id, filename, page_start', 200, 30, 'c_idx')}),
children AS (SELECT parent_id || '_c_' || c_idx AS chunk_id, parent_id, doc_id, filename, content, page_start AS page_number FROM c1)"""
_CONTEXT = f"""{_CHILDREN},
contextual AS (SELECT c.*, coalesce('Document: ' || c.filename || ' (Page ' || c.page_number || E')\\nSection: ' || substring(p.content, 1, 200) || E'...\\n\\n' || c.content, c.content)
  AS contextualized_content FROM children c LEFT JOIN parents p USING (parent_id))"""


def _tokens(c: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}_]+(?:[''.][\p{{L}}\p{{N}}_]+)*')"


def _bm25(name: str, docs: str, key: str, field: str, queries: str = "q0") -> str:
    """CTEs that end in ``name``: qid, key, score over one field of ``docs``."""
    return f"""{name}_w AS (SELECT {key}, {_tokens(field)} AS w FROM {docs}),
{name}_n AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM {name}_w WHERE len(w) > 0),
{name}_t AS (SELECT {key}, len(w) AS dl, unnest(w) AS term FROM {name}_w),
{name}_f AS (SELECT {key}, term, count(*) AS tf, any_value(dl) AS dl FROM {name}_t GROUP BY 1, 2),
{name}_d AS (SELECT term, count(*) AS df FROM {name}_f GROUP BY 1),
{name}_q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({_tokens('query')}) AS term FROM {queries}) GROUP BY 1, 2),
{name} AS (SELECT qid, {key}, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))) AS score
  FROM {name}_f JOIN {name}_q USING (term) JOIN {name}_d USING (term), {name}_n GROUP BY 1, 2)"""


_Q = "q0 AS (SELECT item_id AS qid, text AS query FROM benchmark)"
_SPARSE = f"""{_Q},
docs AS (SELECT doc_id, text FROM documents),
{_bm25('b', 'docs', 'doc_id', 'text')},
s AS (SELECT qid, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b QUALIFY rank <= 40)"""
_DENSE = """qv AS (SELECT item_id AS qid, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON vec_id = item_id),
dn AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
dr AS (SELECT qid, doc_id, round(list_dot_product(qv.v, dn.v), 6) AS score FROM qv, dn),
d AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC) AS rank FROM dr QUALIFY rank <= 40)"""


def _rrf(name: str, a: str, b: str, k: int, wa: float = 1.0, wb: float = 1.0) -> str:
    return f"""{name}_j AS (SELECT qid, doc_id, coalesce({wa}::DOUBLE / (60::DOUBLE + x.rank), 0) + coalesce({wb}::DOUBLE / (60::DOUBLE + y.rank), 0) AS rrf_score, x.rank AS dr, y.rank AS sr
  FROM (SELECT qid, doc_id, rank FROM {a}) x FULL JOIN (SELECT qid, doc_id, rank FROM {b}) y USING (qid, doc_id)),
{name} AS (SELECT qid, doc_id, rrf_score, row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, dr NULLS LAST, sr) AS rank FROM {name}_j QUALIFY rank <= {k})"""


# --- inputs -------------------------------------------------------------------------------------


def _pages(spark, d):
    return document_pages(table(spark, d, "documents"))


def _chunks(spark, d):
    parents = chunking.parents(_pages(spark, d))
    return parents, chunking.children(parents)


def _written_chunks(spark, d):
    """For plans that read the chunks more than once."""
    parents = written(chunking.parents(_pages(spark, d)), "parents")
    return parents, written(chunking.children(parents), "children")


def _queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def _sparse(spark, d, k=40):
    return lexical.search(table(spark, d, "documents"), _queries(spark, d), k)


def _dense(spark, d, k=40):
    vectors = table(spark, d, "embeddings")
    asked = table(spark, d, "benchmark").join(vectors, F.expr("vec_id = item_id")).select(F.col("item_id").alias("qid"), F.col("embedding").alias("vector"))
    corpus = vectors.join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("doc_id"), "embedding")
    return dense.nearest(corpus, asked, k, key="doc_id")


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# --- chunking -----------------------------------------------------------------------------------


@query(f"WITH {_PARENTS} SELECT * FROM parents")
def parent_chunks(spark, d):
    return chunking.parents(_pages(spark, d))


@query(f"WITH {_CHILDREN} SELECT * FROM children")
def child_chunks(spark, d):
    return _chunks(spark, d)[1]


@query(f"WITH {_CHILDREN} SELECT doc_id, count(DISTINCT parent_id) AS n_parents, count(*) AS n_children FROM children GROUP BY 1")
def chunk_stats_per_doc(spark, d):
    return _chunks(spark, d)[1].groupBy("doc_id").agg(F.countDistinct("parent_id").alias("n_parents"), F.count("*").alias("n_children"))


@query(f"WITH {_CONTEXT} SELECT chunk_id, contextualized_content FROM contextual")
def contextualize_children(spark, d):
    parents, children = _chunks(spark, d)
    return chunking.contextualise(children, parents).select("chunk_id", "contextualized_content")


_SEGMENTS = r"""seg AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS seg_idx, unnest(s) AS text FROM (SELECT doc_id,
  list_filter(list_transform(flatten(list_transform(string_split(coalesce(text, ''), E'\n\n'), lambda p: regexp_split_to_array(p, '[.!?]+'))),
  lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 10) AS s FROM documents))"""


@query(f"WITH {_SEGMENTS} SELECT doc_id, seg_idx, text FROM seg")
def sentence_segments(spark, d):
    return _long(page_segments(table(spark, d, "documents").select("doc_id", F.lit(1).alias("page"), "text")).drop("page"), "seg_idx")


@query(f"""WITH {_SEGMENTS}, w AS (SELECT *, {_WORDS.format('text')} AS w FROM seg),
long AS ({_cut('(SELECT * FROM w WHERE len(w) * 1.3 > 50)', 'doc_id, seg_idx', 39, 0, 'piece')})
SELECT doc_id, seg_idx, 0::BIGINT AS piece, text FROM w WHERE len(w) * 1.3 <= 50 UNION ALL SELECT doc_id, seg_idx, piece, content AS text FROM long""")
def split_by_size(spark, d):
    return _long(chunking.split_by_size(sentence_segments(spark, d)), "piece")


@query("""SELECT doc_id, CASE WHEN a IS NULL THEN 'Page: Unknown' WHEN b IS NOT NULL AND a <> b THEN 'Pages: ' || a || '-' || b || ' (chunk spans multiple pages)' ELSE 'Page: ' || a END AS page_info,
CASE WHEN coalesce(a, 0) <> 0 AND coalesce(b, 0) <> 0 THEN CASE WHEN a = b THEN 'p. ' || a ELSE 'pp. ' || a || '-' || b END ELSE 'page unknown' END AS citation
FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 7 END AS a, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 7 + doc_id % 2 END AS b FROM documents)""")
def page_labels(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.expr("CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 7 END").alias("a"), F.expr("CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 7 + doc_id % 2 END").alias("b"))
    return rows.select("doc_id", T.page_info("a", "b").alias("page_info"), T.page_citation("a", "b").alias("citation"))


@query(f"""WITH {_CHILDREN}, c AS (SELECT chunk_id, content, content || E'\\nPage: ' || page_number AS contextualized_content FROM children)
SELECT chunk_id, contextualized_content, content || E'\\n\\n' || contextualized_content AS text_to_embed, content || E'\\n\\nContext: ' || contextualized_content AS rerank_text FROM c""")
def legacy_context_text(spark, d):
    rows = _chunks(spark, d)[1].select("chunk_id", "content", F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"))
    out = chunking.legacy_context(rows)
    return out.select("chunk_id", "contextualized_content", "text_to_embed", chunking.rerank_text("content").alias("rerank_text"))


_SIMILAR = """
e AS (SELECT label AS doc_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY 1),
m AS (SELECT a.doc_id, a.i, b.i AS j, list_dot_product(a.v, b.v) AS s FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.i < b.i),
mu AS (SELECT doc_id, round(avg(s), 9) AS mu FROM m GROUP BY 1),
near AS (SELECT doc_id, i, j, 2 * (round(s, 9) - mu) AS g FROM m JOIN mu USING (doc_id) WHERE j - i < 8),"""
# of e (doc_id, i), n and near: the clusters of each document
_CLUSTERS = """
span AS (SELECT doc_id, i AS st, i + k AS en FROM e JOIN n USING (doc_id), range(0, 8) r(k) WHERE i + k < n),
rew AS (SELECT s.doc_id, st, en, coalesce(sum(g), 0) AS r FROM (SELECT *, unnest(range(0, 8)) AS o FROM span) s LEFT JOIN near ON near.doc_id = s.doc_id AND near.i = st + o AND near.j <= en GROUP BY 1, 2, 3),
opt AS MATERIALIZED (SELECT doc_id, en, list({st: st, r: r} ORDER BY st DESC) AS o FROM rew GROUP BY 1, 2),
run AS (SELECT doc_id, 0::BIGINT AS en, [0::DOUBLE] AS w, 0::BIGINT AS st FROM n
 UNION ALL SELECT doc_id, en + 1, list_append(w[greatest(len(w) - 6, 1):len(w)], best.v), best.st FROM (
  SELECT run.doc_id, run.en, run.w, list_reduce(list_prepend({v: 0::DOUBLE, st: 0::BIGINT}, list_transform(o, lambda x: {v: round(x.r + run.w[len(run.w) - (run.en - x.st)], 6), st: x.st})),
   lambda a, b: CASE WHEN b.v > a.v THEN b ELSE a END) AS best FROM run JOIN opt ON opt.doc_id = run.doc_id AND opt.en = run.en) run),
back AS (SELECT doc_id, n - 1 AS last, st AS first FROM n JOIN run USING (doc_id) WHERE en = n AND n > 0
 UNION ALL SELECT back.doc_id, first - 1, st FROM back JOIN run ON run.doc_id = back.doc_id AND run.en = back.first WHERE first > 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS cluster, first, last FROM back"""
_SEGMENTATION = _SIMILAR + _CLUSTERS
# the pieces of all documents with hashed vectors by dimension; the mean over all pairs by sums
_PIECES = f"""{_SEGMENTS}, pw AS (SELECT *, {_WORDS.format('text')} AS w FROM seg),
plong AS ({_cut('(SELECT * FROM pw WHERE len(w) * 1.3 > 50)', 'doc_id, seg_idx', 39, 0, 'piece')}),
piece AS (SELECT doc_id::VARCHAR AS doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg_idx, piece) - 1 AS i, text FROM (SELECT doc_id, seg_idx, 0 AS piece, text FROM pw WHERE len(w) * 1.3 <= 50 UNION ALL SELECT doc_id, seg_idx, piece, content FROM plong)),
ph AS (SELECT doc_id, i, unnest(list_transform({_tokens('text')}, lambda w: concat('0x', substr(md5(w), 1, 8))::BIGINT)) AS h FROM piece),
pd AS (SELECT doc_id, i, (h // 2) % 64 AS d, sum(CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM ph GROUP BY 1, 2, 3),
pn AS (SELECT doc_id, i, sqrt(sum(v * v)) AS norm FROM pd GROUP BY 1, 2),
pv AS (SELECT doc_id, i, d, v / norm AS v FROM pd JOIN pn USING (doc_id, i) WHERE norm > 0),
e AS (SELECT doc_id, i FROM piece),
n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY 1),
q1 AS (SELECT doc_id, sum(t * t) AS a, sum(o) AS b FROM (SELECT doc_id, d, sum(v) AS t, sum(v * v) AS o FROM pv GROUP BY 1, 2) GROUP BY 1),
mu AS (SELECT doc_id, CASE WHEN n > 1 THEN round((coalesce(a, 0) - coalesce(b, 0)) / (n * (n - 1)), 9) ELSE 0 END AS mu FROM n LEFT JOIN q1 USING (doc_id)),
m AS (SELECT a.doc_id, a.i, b.i AS j, sum(a.v * b.v) AS s FROM pv a JOIN pv b ON a.doc_id = b.doc_id AND a.d = b.d AND a.i < b.i AND b.i < a.i + 8 GROUP BY 1, 2, 3),
near AS (SELECT e.doc_id, e.i, e.i + k AS j, 2 * (round(coalesce(s, 0), 9) - mu) AS g FROM e JOIN n USING (doc_id) JOIN mu USING (doc_id), range(1, 8) r(k) LEFT JOIN m ON m.doc_id = e.doc_id AND m.i = e.i AND m.j = e.i + k WHERE e.i + k < n),"""
_CLUSTERED = f"""{_PIECES} {_CLUSTERS.replace("\nSELECT doc_id, row_number()", ",\ncl AS (SELECT doc_id, row_number()")}),
cc AS (SELECT doc_id, cluster, string_agg(text, ' ' ORDER BY i) AS content FROM cl JOIN piece USING (doc_id) WHERE i BETWEEN first AND last GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE {_CLUSTERED}
SELECT doc_id, cluster AS original_index, content, 1 AS page_start, round(len({_WORDS.format('content')}) * 1.3::DOUBLE, 6) AS token_count FROM cc""")
def cluster_chunks(spark, d):
    """All documents cut into sentences, embedded, and gathered to chunks."""
    rows = contextual.cluster_chunks(_pages(spark, d))
    return rows.select("doc_id", F.col("original_index").cast("long").alias("original_index"), "content", "page_start", F.round("token_count", 6).alias("token_count"))


@query(f"""WITH RECURSIVE {_CLUSTERED}, {_Q},
ck AS (SELECT doc_id || '#' || lpad(cluster::VARCHAR, 10, '0') AS key, content, content || chr(10) || 'Page: 1' AS contextualized_content FROM cc),
{_bm25('x', 'ck', 'key', 'contextualized_content')}, {_bm25('y', 'ck', 'key', 'content')},
u AS (SELECT qid, key, round(max(score), 9) AS score FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY 1, 2)
SELECT qid, key, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM u QUALIFY rank <= 20""")
def contextual_store_search(spark, d):
    """A contextual store of all documents, of which those of one language come in a second time, opened again by its name and searched."""
    root, pages = new_folder(spark, "store"), table(spark, d, "documents")
    store = contextual.ContextualStore(spark, root, "documents")
    store.insert_pages(document_pages(pages))
    store.insert_pages(document_pages(pages.where("lang = 'de'")))
    again = contextual.ContextualStore(spark, root, "documents")
    return _long(again.search_bm25(_queries(spark, d), 20), "rank")


@query("WITH RECURSIVE " + _SEGMENTATION)
def cluster_segmentation(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "embeddings").withColumn("seg_idx", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    found = semantic.clusters(rows.select(F.col("label").alias("doc_id"), "seg_idx", "embedding"))
    return found.groupBy("doc_id", "cluster").agg(F.min("seg_idx").alias("first"), F.max("seg_idx").alias("last"))


# --- lexical search -----------------------------------------------------------------------------


@query(f"WITH w AS (SELECT {_tokens('text')} AS w FROM documents) SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM w) GROUP BY 1")
def term_stats(spark, d):
    return lexical.term_stats(table(spark, d, "documents"), "doc_id", "text")


@query(f"WITH w AS (SELECT len({_tokens('text')}) AS dl FROM documents) SELECT count(*) AS n, avg(dl) AS avgdl FROM w WHERE dl > 0")
def field_stats(spark, d):
    return lexical.field_stats(table(spark, d, "documents"), "text")


@query(f"SELECT doc_id, len({_tokens('text')})::BIGINT AS dl FROM documents")
def doc_lengths(spark, d):
    return lexical.doc_lengths(table(spark, d, "documents"), "doc_id", "text")


@query(f"WITH {_SPARSE} SELECT qid, doc_id, score, rank FROM s")
def bm25_batch(spark, d):
    return _long(_sparse(spark, d), "rank")


@query(f"""WITH {_CONTEXT}, {_Q}, {_bm25('x', 'contextual', 'chunk_id', 'contextualized_content')}, {_bm25('y', 'contextual', 'chunk_id', 'content')},
u AS (SELECT qid, chunk_id, round(max(score), 9) AS score FROM (SELECT qid, chunk_id, 2 * score AS score FROM x UNION ALL SELECT * FROM y) GROUP BY 1, 2)
SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM u QUALIFY rank <= 20""")
def bm25_multifield_topk(spark, d):
    parents, children = _written_chunks(spark, d)
    docs = chunking.contextualise(children, parents)
    return _long(lexical.search(docs, _queries(spark, d), 20, "chunk_id", {"contextualized_content": 2.0, "content": 1.0}), "rank")


# --- dense search -------------------------------------------------------------------------------

_ALL_DENSE = """r AS (SELECT a.vec_id AS qid, b.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id DESC) AS rank FROM r QUALIFY rank <= 10)"""


def _self_dense(spark, d, knn=False):
    vectors = table(spark, d, "embeddings")
    return _long(dense.nearest(vectors, vectors.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")), 10, knn=knn), "rank")


@query(f"WITH {_ALL_DENSE} SELECT qid, vec_id, score, rank FROM t")
def dense_batch_topk(spark, d):
    return _self_dense(spark, d)


@query(f"WITH {_ALL_DENSE} SELECT qid, vec_id, round((score + 1) / 2, 7) AS score, rank FROM t")
def dense_knn_score(spark, d):
    return _self_dense(spark, d, True)


@query(None)
def kept_index_topk(spark, d):
    """Approximate neighbours of each hundredth vector by a kept index, made and opened again; the tests hold its recall."""
    vectors, path = table(spark, d, "embeddings"), new_folder(spark, "vectors")
    made = VectorIndex(spark, path)
    made.fit(vectors)
    made.add(vectors)
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return _long(VectorIndex(spark, path).search(vectors, asked, 10), "rank")


@query(f"""WITH h AS (SELECT doc_id, list_transform({_tokens('text')}, lambda w: concat('0x', substr(md5(w), 1, 8))::BIGINT) AS h FROM documents),
x AS (SELECT doc_id, unnest(h) AS h FROM h), y AS (SELECT doc_id, (h // 2) % 64 AS d, sum(CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM x GROUP BY 1, 2),
z AS (SELECT doc_id, nullif(sqrt(sum(v * v)), 0) AS norm, sum(v) AS s, CASE WHEN count(*) < 64 THEN greatest(max(v), 0) ELSE max(v) END AS m, sum(CASE WHEN v = 0 THEN 0 ELSE d + 1 END) AS places FROM y GROUP BY 1)
SELECT doc_id, round(coalesce(s / norm, 0), 6) AS total, round(coalesce(m / norm, 0), 6) AS largest, coalesce(places, 0)::BIGINT AS places FROM documents LEFT JOIN z USING (doc_id)""")
def hash_embedding(spark, d):
    """Digests of the vectors that the engine's embedder gives: sum, largest component, sum of the places that are not zero."""
    rows = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", dense.hashed_embedding("text").alias("v"))
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    places = F.aggregate(F.transform("v", lambda x, i: F.when(x != 0, i + 1).otherwise(0).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.select("doc_id", F.round(add(F.col("v")), 6).alias("total"), F.round(F.array_max("v"), 6).alias("largest"), places.alias("places"))


# --- fusion -------------------------------------------------------------------------------------


def _rounded(df):
    return _long(df.withColumn("rrf_score", F.round("rrf_score", 12)), "rank")


@query(f"WITH {_SPARSE}, {_DENSE}, {_rrf('f', 'd', 's', 20)} SELECT qid, doc_id, round(rrf_score, 12) AS rrf_score, rank FROM f")
def rrf_fusion(spark, d):
    return _rounded(fusion.rrf(_dense(spark, d), _sparse(spark, d), "doc_id", 20))


@query(f"WITH {_SPARSE}, {_DENSE}, {_rrf('f', 'd', 's', 20, 0.7, 0.3)} SELECT qid, doc_id, round(rrf_score, 12) AS rrf_score, rank FROM f")
def rrf_weighted(spark, d):
    return _rounded(fusion.rrf(_dense(spark, d), _sparse(spark, d), "doc_id", 20, w_dense=0.7, w_sparse=0.3))


@query(f"""WITH {_SPARSE}, {_DENSE}, l AS (SELECT vec_id AS doc_id, qid, label FROM embeddings e JOIN (SELECT item_id AS qid FROM benchmark) ON e.label = qid % 10 AND vec_id IN (SELECT doc_id FROM documents)),
third AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY doc_id) AS rank FROM l QUALIFY rank <= 40),
{_rrf('f1', 'd', 's', 1000000)}, {_rrf('f2', 'f1', 'third', 20)} SELECT qid, doc_id, round(rrf_score, 12) AS rrf_score, rank FROM f2""")
def rrf_multi_query_fold(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"))
    asked = _queries(spark, d).select("qid", (F.col("qid") % 10).cast("int").alias("label"))
    rows = table(spark, d, "embeddings").join(docs, "vec_id", "left_semi").join(F.broadcast(asked) if asked.count() <= 100_000 else asked, "label").select("qid", F.col("vec_id").alias("doc_id"))
    third = lexical.top(rows.withColumn("score", F.lit(0.0)), 40, "doc_id")
    return _rounded(fusion.fold([_dense(spark, d), _sparse(spark, d), third], "doc_id", 20))


_WEIGHTED = f"""WITH {_SPARSE}, {_DENSE}, j AS (SELECT qid, doc_id, x.rank AS dr, y.rank AS sr, round(coalesce(0.7::DOUBLE / x.rank, 0) + coalesce(0.3::DOUBLE / y.rank, 0), 12) AS w
  FROM (SELECT qid, doc_id, rank FROM d) x FULL JOIN (SELECT qid, doc_id, rank FROM s) y USING (qid, doc_id)),
h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY w DESC, doc_id DESC) AS rank FROM j QUALIFY rank <= 20)"""


@query(_WEIGHTED + " SELECT qid, doc_id, rank, round(1::DOUBLE / rank, 12) AS score, dr IS NOT NULL AS from_semantic, sr IS NOT NULL AS from_bm25 FROM h")
def weighted_reciprocal_hybrid(spark, d):
    out = fusion.weighted_reciprocal(_dense(spark, d), _sparse(spark, d), ["doc_id"], 20)
    return _long(out.withColumn("score", F.round("score", 12)), "rank").select("qid", "doc_id", "rank", "score", "from_semantic", "from_bm25")


@query(_WEIGHTED + """ SELECT round(sum(CASE WHEN dr IS NULL THEN 0 WHEN sr IS NULL THEN 1 ELSE 0.5 END)::DOUBLE * 100 / count(*), 9) AS semantic_percent,
round(sum(CASE WHEN sr IS NULL THEN 0 WHEN dr IS NULL THEN 1 ELSE 0.5 END)::DOUBLE * 100 / count(*), 9) AS bm25_percent, count(*) AS n_results FROM h""")
def hybrid_provenance(spark, d):
    out = fusion.provenance(fusion.weighted_reciprocal(_dense(spark, d), _sparse(spark, d), ["doc_id"], 20))
    return out.select(F.round("semantic_percent", 9).alias("semantic_percent"), F.round("bm25_percent", 9).alias("bm25_percent"), "n_results")


# --- parents and reranking ----------------------------------------------------------------------

_RESOLVED = f"""WITH {_CHILDREN}, {_Q}, {_bm25('b', 'children', 'chunk_id', 'content')},
hits AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM b QUALIFY rank <= 20),
fp AS (SELECT qid, parent_id, min(rank) AS fr FROM hits JOIN children USING (chunk_id) GROUP BY 1, 2),
res AS (SELECT qid, parent_id, p.doc_id, p.filename, p.content, p.page_start, p.page_end, row_number() OVER (PARTITION BY qid ORDER BY fr, parent_id) AS parent_rank FROM fp JOIN parents p USING (parent_id))"""


def _resolved(spark, d):
    parents, children = _written_chunks(spark, d)
    return resolve.resolve_parents(lexical.search(children, _queries(spark, d), 20, "chunk_id", {"content": 1.0}), children, parents)


@query(_RESOLVED + " SELECT qid, parent_id, parent_rank FROM res")
def parent_resolution(spark, d):
    return _long(_resolved(spark, d), "parent_rank").select("qid", "parent_id", "parent_rank")


@query(_RESOLVED + " SELECT qid, parent_id, parent_rank AS rank, round(1::DOUBLE - 0.05::DOUBLE * (parent_rank - 1), 9) AS score FROM res WHERE parent_rank <= 5")
def rerank_fallback(spark, d):
    return _long(resolve.rerank_fallback(_resolved(spark, d), 5), "rank").select("qid", "parent_id", "rank", "score")


@query(_RESOLVED + " SELECT qid, parent_id, parent_rank AS rank, 1::DOUBLE AS score FROM res WHERE parent_rank <= 5")
def no_rerank(spark, d):
    return _long(resolve.no_rerank(_resolved(spark, d), 5), "rank").select("qid", "parent_id", "rank", "score")


_BLOCK = "'[Source ' || parent_rank || '] (Document: ' || filename || ', Page ' || page_start || E')\\n' || content"


@query(_RESOLVED + f" SELECT qid, string_agg({_BLOCK}, E'\\n\\n---\\n\\n' ORDER BY parent_rank) AS context FROM res WHERE parent_rank <= 5 GROUP BY 1")
def context_block_prompt(spark, d):
    return prompting.context_blocks(resolve.no_rerank(_resolved(spark, d), 5))


@query(_RESOLVED + " SELECT qid, parent_rank::INTEGER AS index, filename, page_start, page_end, 1::DOUBLE AS score, substring(content, 1, 200) AS content_preview FROM res WHERE parent_rank <= 5")
def source_previews(spark, d):
    return prompting.source_rows(resolve.no_rerank(_resolved(spark, d), 5))


# --- routing ------------------------------------------------------------------------------------

_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


# letters, marks and digits beyond ASCII become Z, which lower-cased text does not hold: part of a word for \b, but of no term
_SPECIFICITY = rf"""sw AS (SELECT item_id AS qid, regexp_extract_all(regexp_replace(lower(text), '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}\p{{C}}\p{{No}}]', 'Z', 'g'), '\b[a-z0-9_-]+\b') AS w FROM benchmark),
sp AS (SELECT qid, CASE WHEN len(w) = 0 THEN 0 ELSE list_sum(list_transform(w, lambda x: CASE WHEN list_contains([{_STOPS}], x) THEN 0.5::DOUBLE
  ELSE 2::DOUBLE * ln(length(x) + 1) * (len(list_distinct(string_split(x, ''))) / length(x)::DOUBLE) END)) / len(w) END AS specificity FROM sw)"""


@query(f"WITH {_SPECIFICITY} SELECT qid, round(specificity, 9) AS specificity FROM sp")
def query_specificity(spark, d):
    """All queries, in any script."""
    return _queries(spark, d).select("qid", F.round(T.specificity("query"), 9).alias("specificity"))


_PROBE = f"""WITH {_ALL_DENSE}, p AS (SELECT qid, list((score + 1) / 2 ORDER BY score DESC) AS s FROM t WHERE rank <= 5 GROUP BY 1),
e AS (SELECT qid, s, list_transform(s, lambda x: exp((x - s[1]) / 0.15::DOUBLE)) AS e FROM p),
m AS (SELECT qid, CASE WHEN len(s) > 1 THEN s[1] - s[2] ELSE coalesce(s[1], 0) END AS margin,
  CASE WHEN len(s) > 1 THEN -list_sum(list_transform(e, lambda x: x / list_sum(e) * ln(x / list_sum(e) + 1e-12))) ELSE 0 END AS entropy FROM e)"""


def _probe(spark, d):
    hits = dense.nearest(table(spark, d, "embeddings"), table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")), 5)
    scores = router.probe_scores(hits.withColumn("score", (F.col("score") + 1) / 2))
    return scores.select("qid", T.probe_margin(F.col("scores")).alias("margin"), T.probe_entropy(F.col("scores")).alias("entropy"))


@query(_PROBE + " SELECT qid, round(margin, 7) AS margin, round(entropy, 4) AS entropy FROM m")
def probe_entropy(spark, d):
    return _probe(spark, d).select("qid", F.round("margin", 7).alias("margin"), F.round("entropy", 4).alias("entropy"))


@query(_PROBE.replace("FROM e)", "FROM e)", 1) + f""", {_SPECIFICITY}, o AS (SELECT sp.qid, specificity AS s, coalesce(margin, 0) AS m, coalesce(entropy, 0) AS h FROM sp LEFT JOIN m USING (qid)),
w AS (SELECT *, CASE WHEN s >= 3.5 OR m >= 0.08 AND h <= 1.3 THEN 'direct' WHEN h > 1.3 AND m < 0.08 THEN 'hyde' ELSE 'multi_query' END AS tier FROM o)
SELECT qid, tier, round(s, 9) AS specificity, round(m, 7) AS margin, round(h, 4) AS entropy, CASE tier WHEN 'direct' THEN 'High query specificity' WHEN 'hyde' THEN 'High retrieval ambiguity' ELSE 'Moderate query complexity' END AS reason FROM w""")
def route_decision(spark, d):
    """The router's decisions: the words of each benchmark text, and a probe of the vectors near its own."""
    vectors = table(spark, d, "embeddings")
    asked = _queries(spark, d)
    probes = asked.join(vectors, F.col("qid") == F.col("vec_id")).select("qid", F.col("embedding").alias("vector"))
    out = router.route(asked, dense.nearest(vectors, probes, 5, knn=True))
    reason = F.regexp_extract("reason", "^(High query specificity|High retrieval ambiguity|Moderate query complexity)", 1)
    return out.select("qid", "tier", F.round("specificity_score", 9).alias("specificity"), F.round("score_margin", 7).alias("margin"), F.round("entropy", 4).alias("entropy"), reason.alias("reason"))


@query(rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), E'\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, array_to_string(list_transform(l, lambda x: regexp_replace(x, '^\d+[.)]\s*', ''))[1:3], ' | ') AS sub_queries FROM l""")
def sub_query_lines(spark, d):
    """What the router makes of a model's reply; each document's text stands for one."""
    return table(spark, d, "documents").select("doc_id", F.array_join(router.sub_queries(F.coalesce("text", F.lit(""))), " | ").alias("sub_queries"))


@query(f"""WITH {_SPARSE}, qv AS (SELECT item_id AS qid, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON vec_id = item_id + 1),
{_DENSE.partition(',' + chr(10))[2]}, {_rrf('f', 'd', 's', 20)} SELECT qid, doc_id, rank FROM f""")
def hyde_hybrid(spark, d):
    """The vector is that of another passage, the words are the query's own."""
    vectors = table(spark, d, "embeddings")
    asked = table(spark, d, "benchmark").join(vectors, F.expr("vec_id = item_id + 1")).select(F.col("item_id").alias("qid"), F.col("embedding").alias("vector"))
    corpus = vectors.join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("doc_id"), "embedding")
    return _long(fusion.rrf(dense.nearest(corpus, asked, 40, key="doc_id"), _sparse(spark, d), "doc_id", 20), "rank").select("qid", "doc_id", "rank")


# --- evaluation ---------------------------------------------------------------------------------


@query(f"""WITH {_SPARSE}, gold AS (SELECT item_id AS qid, trim(d.text, E' \\t\\n\\r') AS c FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
hit AS (SELECT DISTINCT qid, trim(d.text, E' \\t\\n\\r') AS c, 1 AS hit FROM s JOIN documents d USING (doc_id) WHERE rank <= 20),
e AS (SELECT qid, count(hit) / count(*)::DOUBLE AS share, count(hit) AS found FROM gold LEFT JOIN hit USING (qid, c) GROUP BY 1)
SELECT round(sum(coalesce(share, 0)) / count(*) * 100, 9) AS pass_at_k, count(*) AS n_queries, coalesce(sum(found), 0)::BIGINT AS n_found FROM q0 LEFT JOIN e USING (qid)""")
def pass_at_k(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    asked = _queries(spark, d)
    gold = evaluate.containing(docs, asked).select("qid", "content")
    hits = _sparse(spark, d, 20).join(docs, "doc_id").select("qid", "content")
    return evaluate.pass_at_k(asked, gold, hits).withColumn("pass_at_k", F.round("pass_at_k", 9))


@query(f"""WITH {_SPARSE}, {_DENSE}, {_rrf('f', 'd', 's', 20)}, lab AS (SELECT vec_id AS doc_id, label FROM embeddings),
gold AS (SELECT qid, l.doc_id FROM (SELECT qid, label FROM q0 JOIN embeddings ON vec_id = qid) q JOIN lab l USING (label)),
e AS (SELECT qid, count(f.doc_id) / count(*)::DOUBLE AS share, count(f.doc_id) AS found FROM gold LEFT JOIN f USING (qid, doc_id) GROUP BY 1)
SELECT round(sum(coalesce(share, 0)) / count(*) * 100, 9) AS pass_at_k, count(*) AS n_queries, coalesce(sum(found), 0)::BIGINT AS n_found FROM q0 LEFT JOIN e USING (qid)""")
def pass_at_k_hybrid(spark, d):
    """Gold are the vectors of the same label; contents are their ids."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    asked = _queries(spark, d)
    of_label = asked.join(vectors, F.col("qid") == F.col("doc_id")).select("qid", "label")
    gold = of_label.join(vectors, "label").select("qid", F.col("doc_id").cast("string").alias("content"))
    hits = fusion.rrf(_dense(spark, d), _sparse(spark, d), "doc_id", 20).select("qid", F.col("doc_id").cast("string").alias("content"))
    return evaluate.pass_at_k(asked, gold, hits).withColumn("pass_at_k", F.round("pass_at_k", 9))


# --- prompts and citations ----------------------------------------------------------------------


@query("""SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'Human' ELSE 'Assistant' END || ': ' || coalesce(text, '') || E'\\n', '' ORDER BY turn) AS history
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6 GROUP BY 1""")
def recent_history_prompt(spark, d):
    return prompting.recent_history(table(spark, d, "conversations"))


_LINK = "'<a href=\"#source-' || n || '\" style=\"" + T.LINK_STYLE + "\">[' || n || ']</a>'"
_GROUP = T.CITATION_GROUP.replace("'", "''")


@query(rf"""WITH a AS (SELECT doc_id, coalesce(text, '') || ' [Source ' || doc_id % 9 || ', Source ' || doc_id % 4 || ', p. 15] and (Source ' || doc_id % 5 || ', 15) or [Source 2; Source 3, p. 2] [Source 7)' ||
CASE WHEN doc_id % 2 = 0 THEN E'\n\n**Sources:**\n[1] x, p. 2\n[2] y' ELSE E'\n\nSources: x' END AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\n\n\*\*Sources:\*\*.*$', '', 's'), '\n\nSources:.*$', '', 's') AS t FROM a),
g AS (SELECT doc_id, t, list_distinct(regexp_extract_all(t, '{_GROUP}')) AS g FROM b)
SELECT doc_id, list_reduce(list_prepend(t, g), lambda acc, m: replace(acc, m, array_to_string(list_transform(regexp_extract_all(m, 'Source\s+(\d+)', 1), lambda n: {_LINK}), ' '))) AS answer FROM g""")
def citation_links(spark, d):
    n = lambda m: (F.col("doc_id") % m).cast("string")
    tail = F.when(F.col("doc_id") % 2 == 0, F.lit("\n\n**Sources:**\n[1] x, p. 2\n[2] y")).otherwise(F.lit("\n\nSources: x"))
    parts = [F.coalesce("text", F.lit("")), F.lit(" [Source "), n(9), F.lit(", Source "), n(4), F.lit(", p. 15] and (Source "), n(5), F.lit(", 15) or [Source 2; Source 3, p. 2] [Source 7)"), tail]
    return table(spark, d, "documents").select("doc_id", F.concat(*parts).alias("t")).select("doc_id", T.cite("t").alias("answer"))


def _label_sql(name: str) -> str:
    mark = f"{name}: "
    return f"replace(list_filter(string_split(t, E'\\n'), lambda x: starts_with(x, '{mark}'))[-1], '{mark}', '')"


@query(f"""WITH a AS (SELECT doc_id, 'Chapter: ' || source || E'\\nSection: s' || doc_id % 7 || E'\\nHeading: ' || lang || E'\\nChapter: Chapter: ' || source || doc_id % 3 || E'\\n' || coalesce(text, '') AS t FROM documents),
h AS (SELECT doc_id, {_label_sql('Chapter')} AS chapter, {_label_sql('Section')} AS section, {_label_sql('Heading')} AS heading, {_label_sql('Sub-Heading')} AS sub_heading FROM a)
SELECT *, '[Source ' || doc_id || '] (' || chapter || CASE WHEN coalesce(heading, '') <> '' AND heading <> chapter THEN ' → ' || heading ELSE '' END ||
CASE WHEN coalesce(sub_heading, '') <> '' THEN ' → ' || sub_heading ELSE '' END || ', Page 1)' AS label FROM h""")
def header_parse(spark, d):
    t = F.concat(F.lit("Chapter: "), "source", F.lit("\nSection: s"), (F.col("doc_id") % 7).cast("string"), F.lit("\nHeading: "), "lang", F.lit("\nChapter: Chapter: "), "source", (F.col("doc_id") % 3).cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")))
    rows = table(spark, d, "documents").select("doc_id", t.alias("t"))
    names = {"chapter": "Chapter", "section": "Section", "heading": "Heading", "sub_heading": "Sub-Heading"}
    rows = rows.select("doc_id", *[T.header("t", v).alias(k) for k, v in names.items()])
    return rows.withColumn("label", T.source_label("doc_id", "chapter", "section", "heading", "sub_heading", F.lit("Page 1")))


# --- tables -------------------------------------------------------------------------------------


@query("SELECT doc_id, source, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS preview FROM documents")
def metadata_previews(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", T.preview("text", dots=True).alias("preview"))


@query("""WITH new AS (SELECT doc_id, upper(coalesce(text, '')) AS text FROM documents WHERE lang = 'fr')
SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT * FROM new""")
def doc_upsert(spark, d):
    """Texts of one language are ingested again, changed: old rows of these documents go."""
    from fathom.sources.collection import upsert

    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return upsert(docs.drop("lang"), docs.where("lang = 'fr'").select("doc_id", T.upper(F.coalesce("text", F.lit(""))).alias("text")))


@query("SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src1')")
def doc_delete(spark, d):
    from fathom.sources.collection import delete

    docs = table(spark, d, "documents")
    return delete(docs.select("doc_id", "text"), docs.where("source = 'src1'").select("doc_id"))


@query(f"""WITH {_CONTEXT}, {_Q}, {_bm25('x', 'contextual', 'chunk_id', 'contextualized_content')}, {_bm25('y', 'contextual', 'chunk_id', 'content')},
u AS (SELECT qid, chunk_id, round(max(score), 9) AS score FROM (SELECT qid, chunk_id, 2 * score AS score FROM x UNION ALL SELECT * FROM y) GROUP BY 1, 2),
s AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM u QUALIFY rank <= 40),
em AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
qv AS (SELECT qid, v FROM q0 JOIN em ON vec_id = qid), cv AS (SELECT chunk_id, v FROM children JOIN em ON vec_id = doc_id::BIGINT),
r AS (SELECT qid, chunk_id, round(list_dot_product(qv.v, cv.v), 6) AS score FROM qv, cv),
d AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id DESC) AS rank FROM r QUALIFY rank <= 40),
j AS (SELECT qid, chunk_id, coalesce(1 / (60::DOUBLE + x.rank), 0) + coalesce(1 / (60::DOUBLE + y.rank), 0) AS f, x.rank AS dr, y.rank AS sr
  FROM (SELECT qid, chunk_id, rank FROM d) x FULL JOIN (SELECT qid, chunk_id, rank FROM s) y USING (qid, chunk_id)),
f AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY f DESC, dr NULLS LAST, sr) AS rank FROM j QUALIFY rank <= 20),
fp AS (SELECT qid, parent_id, min(rank) AS fr FROM f JOIN children USING (chunk_id) GROUP BY 1, 2),
res AS (SELECT qid, parent_id, row_number() OVER (PARTITION BY qid ORDER BY fr, parent_id) AS rank FROM fp)
SELECT qid, parent_id, p.doc_id, p.filename, p.content, rank, round(1::DOUBLE - 0.05::DOUBLE * (rank - 1), 9) AS score FROM res JOIN parents p USING (parent_id) WHERE rank <= 5""")
def end_to_end_search(spark, d):
    """Hybrid search over child chunks, resolved to parents, five for each query."""
    parents, children = _written_chunks(spark, d)
    asked = _queries(spark, d)
    sparse = lexical.search(chunking.contextualise(children, parents), asked, 40, "chunk_id", {"contextualized_content": 2.0, "content": 1.0})
    vectors = table(spark, d, "embeddings")
    of_chunk = children.select("chunk_id", F.col("doc_id").cast("bigint").alias("vec_id")).join(vectors, "vec_id").select("chunk_id", "embedding")
    of_query = asked.join(vectors, F.col("vec_id") == F.col("qid")).select("qid", F.col("embedding").alias("vector"))
    hits = fusion.rrf(dense.nearest(of_chunk, of_query, 40, key="chunk_id"), sparse, "chunk_id", 20)
    found = resolve.rerank_fallback(resolve.resolve_parents(hits, children, parents), 5)
    return _long(found, "rank").select("qid", "parent_id", "doc_id", "filename", "content", "rank", "score")


# --- reranking of chunks, evaluation, prompts ---------------------------------------------------

_COVERAGE = "CASE WHEN len(qw) = 0 THEN 0 ELSE len(list_intersect(list_distinct(qw), cw[1:greatest(512 - len(qw), 0)])) / len(list_distinct(qw))::DOUBLE END"
#: Documents as chunks of one page each, with the context that needs no model.
_AS_CHUNKS = r"ch AS (SELECT doc_id, coalesce(text, '') AS content, coalesce(text, '') || E'\nPage: 1' AS contextualized_content FROM documents)"


def _reranked_sql(hits: str, k: int) -> str:
    pair = r"content || E'\n\nContext: ' || contextualized_content"
    return f"""{_AS_CHUNKS}, rw AS (SELECT h.qid, h.doc_id, h.rank AS fr, {_tokens('query')} AS qw, {_tokens(f'({pair})')} AS cw FROM {hits} h JOIN ch USING (doc_id) JOIN q0 ON q0.qid = h.qid),
rr AS (SELECT qid, doc_id, round({_COVERAGE}, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY {_COVERAGE} DESC, fr) AS rank FROM rw QUALIFY rank <= {k})"""


def _as_chunks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))
    return chunking.legacy_context(docs)


def _reranked(spark, d, hits, k):
    rows = hits.select("qid", "doc_id", "rank").join(_as_chunks(spark, d), "doc_id").join(_queries(spark, d), "qid")
    return _long(resolve.rerank_chunks(rows, k, CoverageReranker().score(F.col("query"), chunking.rerank_text("content")), "doc_id"), "rank")


def _digest(df):
    return df.select("qid", "doc_id", F.round("score", 9).alias("score"), "rank")


def _wide(k: int) -> str:
    return _DENSE.replace("rank <= 40", f"rank <= {k}")


@query(f"WITH {_Q}, {_wide(200)}, {_reranked_sql('d', 20)} SELECT qid, doc_id, score, rank FROM rr")
def retrieve_rerank(spark, d):
    """Ten times as many dense hits as asked for, reranked."""
    return _digest(_reranked(spark, d, _dense(spark, d, 200), 20))


@query(f"WITH {_Q}, {_wide(15)}, {_reranked_sql('d', 5)} SELECT qid, doc_id, score, rank FROM rr")
def agent_rerank(spark, d):
    """The agent's form: three times as many dense hits."""
    return _digest(_reranked(spark, d, _dense(spark, d, 15), 5))


@query(_WEIGHTED + f", {_reranked_sql('h', 10)} SELECT qid, doc_id, score, rank FROM rr")
def chat_rerank(spark, d):
    """The chat's form: twice as many hits of the weighted fusion."""
    return _digest(_reranked(spark, d, fusion.weighted_reciprocal(_dense(spark, d), _sparse(spark, d), ["doc_id"], 20), 10))


@query(_RESOLVED + f""", rw AS (SELECT r.*, {_tokens('query')} AS qw, {_tokens('content')} AS cw FROM res r JOIN q0 USING (qid))
SELECT qid, parent_id, round({_COVERAGE}, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY {_COVERAGE} DESC, parent_rank) AS rank FROM rw QUALIFY rank <= 5""")
def rerank_parents(spark, d):
    found = _resolved(spark, d).join(_queries(spark, d), "qid")
    out = resolve.rerank(found, 5, CoverageReranker().score(F.col("query"), F.col("content")))
    return _long(out, "rank").select("qid", "parent_id", F.round("score", 9).alias("score"), "rank")


_LABEL_GOLD = """lab AS (SELECT vec_id AS doc_id, label FROM embeddings),
gold AS (SELECT qid, l.doc_id FROM (SELECT qid, label FROM q0 JOIN embeddings ON vec_id = qid) q JOIN lab l USING (label)),
e AS (SELECT qid, count(f.doc_id) / count(*)::DOUBLE AS share, count(f.doc_id) AS found FROM gold LEFT JOIN f USING (qid, doc_id) GROUP BY 1)
SELECT round(sum(coalesce(share, 0)) / count(*) * 100, 9) AS pass_at_k, count(*) AS n_queries, coalesce(sum(found), 0)::BIGINT AS n_found FROM q0 LEFT JOIN e USING (qid)"""


def _label_gold(spark, d, hits):
    """Gold are the vectors of the same label; contents are their ids."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    asked = _queries(spark, d)
    gold = asked.join(vectors, F.col("qid") == F.col("doc_id")).select("qid", "label").join(vectors, "label").select("qid", F.col("doc_id").cast("string").alias("content"))
    return evaluate.pass_at_k(asked, gold, hits.select("qid", F.col("doc_id").cast("string").alias("content"))).withColumn("pass_at_k", F.round("pass_at_k", 9))


@query(f"WITH {_Q}, {_wide(20)}, f AS (SELECT qid, doc_id FROM d), {_LABEL_GOLD}")
def pass_at_k_dense(spark, d):
    return _label_gold(spark, d, _dense(spark, d, 20))


@query(f"WITH {_Q}, {_wide(200)}, {_reranked_sql('d', 20)}, f AS (SELECT qid, doc_id FROM rr), {_LABEL_GOLD}")
def pass_at_k_reranked(spark, d):
    return _label_gold(spark, d, _reranked(spark, d, _dense(spark, d, 200), 20))


@query(None)
def bm25_english(spark, d):
    """The older search by words: both fields alike, English analysis with Porter's stems (beyond SQL)."""
    docs = _as_chunks(spark, d)
    return _long(lexical.search(docs, _queries(spark, d), 20, "doc_id", {"content": 1.0, "contextualized_content": 1.0}, lexical.english_tokens), "rank")


def _lit(x: str) -> str:
    return "E'" + x.replace("'", "''").replace("\n", "\\n") + "'"


_ANSWER_CONTEXT = f"c AS (SELECT qid, string_agg({_BLOCK}, E'\\n\\n---\\n\\n' ORDER BY parent_rank) AS context FROM res WHERE parent_rank <= 5 GROUP BY 1)"


@query(_RESOLVED + f", {_ANSWER_CONTEXT} SELECT qid, {_lit(prompting.RULES + 'Context:' + chr(10))} || context || {_lit(chr(10) * 2 + 'Question: ')} || query || {_lit(chr(10) * 2 + 'Answer:')} AS prompt FROM c JOIN q0 USING (qid)")
def answer_prompts(spark, d):
    context = prompting.context_blocks(resolve.no_rerank(_resolved(spark, d), 5))
    return context.join(_queries(spark, d), "qid").select("qid", prompting.answer_prompt("context", "query").alias("prompt"))


_LEGACY = [_lit(x) for x in prompting.LEGACY_PROMPT]


@query(f"""WITH {_SPARSE}, h AS (SELECT qid, rank, doc_id, coalesce(text, '') AS content, doc_id % 3 AS a, doc_id % 3 + doc_id % 2 AS b FROM s JOIN documents USING (doc_id) WHERE rank <= 5),
c AS (SELECT qid, string_agg('[Source ' || rank || ']: ' || content, E'\\n\\n' ORDER BY rank) AS context, E'\\n\\n**Sources:**\\n' || string_agg('[' || rank || '] ' || doc_id || ', ' ||
  CASE WHEN a = 0 OR b = 0 THEN 'page unknown' WHEN a = b THEN 'p. ' || a ELSE 'pp. ' || a || '-' || b END, E'\\n' ORDER BY rank) AS citations FROM h GROUP BY 1)
SELECT qid, {_LEGACY[0]} || context || {_LEGACY[1]} || query || {_LEGACY[2]} AS prompt, 'reply' || citations AS answer FROM c JOIN q0 USING (qid)""")
def legacy_prompts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"), (F.col("doc_id") % 3).alias("page_start"), (F.col("doc_id") % 3 + F.col("doc_id") % 2).alias("page_end"))
    out = prompting.legacy_context(_sparse(spark, d, 5).join(docs, "doc_id")).join(_queries(spark, d), "qid")
    return out.select("qid", prompting.legacy_prompt("context", "query").alias("prompt"), prompting.legacy_answer(F.lit("reply"), "citations").alias("answer"))


_CHAT = [_lit(x) for x in prompting.CHAT_PROMPT]


@query(f"""WITH {_SPARSE}, h AS (SELECT qid, rank, coalesce(text, '') AS content, doc_id, CASE WHEN doc_id % 4 < 2 THEN source END AS chapter, 's' || doc_id % 7 AS section, CASE WHEN doc_id % 4 = 0 THEN lang END AS heading FROM s JOIN documents USING (doc_id) WHERE rank <= 25),
c AS (SELECT qid, string_agg('[Source ' || rank || '] (' || CASE WHEN chapter IS NOT NULL THEN chapter || CASE WHEN heading IS NOT NULL THEN ' → ' || heading ELSE '' END || ', ' WHEN doc_id % 4 = 2 THEN section || ', ' ELSE '' END || 'p. 1): ' || content, E'\\n\\n' ORDER BY rank) AS context FROM h GROUP BY 1),
t AS (SELECT conv_id AS qid, string_agg(CASE WHEN role = 'user' THEN 'Human' ELSE 'Assistant' END || ': ' || coalesce(text, '') || E'\\n', '' ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6 GROUP BY 1)
SELECT qid, {_CHAT[0]} || coalesce(context, '') || {_CHAT[1]} || coalesce(history, '') || {_CHAT[2]} || query || {_CHAT[3]} AS prompt FROM q0 LEFT JOIN c USING (qid) LEFT JOIN t USING (qid)""")
def chat_prompts(spark, d):
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c, F.lit("\n"))).otherwise(F.lit(""))
    m = F.col("doc_id") % 4
    head = F.concat(line("Chapter", F.when(m < 2, F.col("source"))), line("Section", F.when(m != 3, F.concat(F.lit("s"), (F.col("doc_id") % 7).cast("string")))), line("Heading", F.when(m == 0, F.col("lang"))))
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"), head.alias("contextualized_content"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))
    context = prompting.chat_context(_sparse(spark, d).join(docs, "doc_id"))
    history = prompting.recent_history(table(spark, d, "conversations")).withColumnRenamed("conv_id", "qid")
    return _queries(spark, d).join(context, "qid", "left").join(history, "qid", "left").select("qid", prompting.chat_prompt("context", "history", "query").alias("prompt"))


@query(_RESOLVED + " SELECT qid, parent_rank::INTEGER AS rank, doc_id, 1::DOUBLE AS score, page_start, page_end, content FROM res WHERE parent_rank <= 5")
def result_projection(spark, d):
    return prompting.result_rows(resolve.no_rerank(_resolved(spark, d), 5))


@query("WITH RECURSIVE " + _SEGMENTATION.replace("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS cluster, first, last FROM back", r""", cl AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS cluster, first, last FROM back),
tx AS (SELECT label AS doc_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, 'piece ' || vec_id AS text, (vec_id % 9)::INTEGER AS page FROM embeddings)
SELECT cl.doc_id, 'chunk_' || cluster AS chunk_id, cluster AS original_index, string_agg(text, ' ' ORDER BY i) AS content, min(page) AS page_start, max(page) AS page_end, round(2 * count(*) * 1.3::DOUBLE, 6) AS token_count
FROM cl JOIN tx ON tx.doc_id = cl.doc_id AND i BETWEEN first AND last GROUP BY 1, 2, 3"""))
def cluster_assembly(spark, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = table(spark, d, "embeddings").select(F.col("label").alias("doc_id"), place.cast("long").alias("seg_idx"), F.concat(F.lit("piece "), "vec_id").alias("text"), (F.col("vec_id") % 9).cast("int").alias("page"), "embedding")
    out = semantic.assemble(rows.drop("embedding"), semantic.clusters(rows))
    return out.withColumn("token_count", F.round("token_count", 6))


@query(r"""WITH s AS (SELECT doc_id, coalesce(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1], '') AS s FROM documents)
SELECT doc_id, 'Content Summary: ' || s || E'\nPage(s): Page: 1' AS contextualized_content FROM s""")
def summarised_context(spark, d):
    """Contexts from a model's summary; the stand-in takes the first sentence."""
    return chunking.summarised_context(_as_chunks(spark, d).drop("page_info", "contextualized_content", "text_to_embed"), ExtractiveGenerator().chunk_summary(F.col("content"))).select("doc_id", "contextualized_content")


@query(r"SELECT page_id, string_split(url, '/')[-1] AS base_name, regexp_replace(string_split(url, '/')[-1], '^(.+)\.[^.]*$', '\1') AS stem FROM pages")
def path_names(spark, d):
    return table(spark, d, "pages").select("page_id", T.base_name("url").alias("base_name"), T.stem_of_path("url").alias("stem"))


@query("""SELECT doc_id, '[Source ' || doc_id || '] (' || CASE doc_id % 3 WHEN 0 THEN source || ', ' WHEN 1 THEN lang || ', ' ELSE '' END ||
CASE WHEN a = 0 OR b = 0 THEN 'Page unknown' WHEN a = b THEN 'Page ' || a ELSE 'Pages ' || a || '-' || b END || ')' AS label FROM (SELECT *, doc_id % 5 AS a, doc_id % 5 + doc_id % 2 AS b FROM documents)""")
def source_labels(spark, d):
    """Labels by chapter, by section and by page alone, with the wording of the chat."""
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("chapter"), F.when(F.col("doc_id") % 3 == 1, F.col("lang")).alias("section"), (F.col("doc_id") % 5).alias("a"), (F.col("doc_id") % 5 + F.col("doc_id") % 2).alias("b"))
    none = F.lit(None).cast("string")
    return rows.select("doc_id", T.source_label("doc_id", "chapter", "section", none, none, T.page_citation("a", "b", "Page", "Pages", "Page unknown")).alias("label"))


# --- the engine as a whole ----------------------------------------------------------------------


def _rrf_chunks(name: str, a: str, b: str, k: int) -> str:
    """As ``_rrf``, over chunks; ``a`` and ``b`` are selections of qid, chunk_id, rank."""
    return f"""{name}_j AS (SELECT qid, chunk_id, coalesce(1 / (60::DOUBLE + x.rank), 0) + coalesce(1 / (60::DOUBLE + y.rank), 0) AS v, x.rank AS dr, y.rank AS sr FROM ({a}) x FULL JOIN ({b}) y USING (qid, chunk_id)),
{name} AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY v DESC, dr NULLS LAST, sr) AS rank FROM {name}_j QUALIFY rank <= {k})"""


def _list(n: int, name: str = "few") -> str:
    return f"SELECT qid // 10 AS qid, chunk_id, rank FROM {name} WHERE qid % 10 = {n}"


# queries and their three sub-queries are numbered 10 qid + n
_ENGINE = rf"""WITH {_CONTEXT}, {_SPECIFICITY}, {_Q}, w0 AS (SELECT qid, {_WORDS.format('query')} AS w FROM q0),
sub AS (SELECT qid * 10 + 1 AS qid, array_to_string(w[1:(len(w) + 1) // 2], ' ') AS query FROM w0 UNION ALL SELECT qid * 10 + 2, array_to_string(w[len(w) // 2 + 1:], ' ') FROM w0
  UNION ALL SELECT qid * 10 + 3, regexp_replace(array_to_string(list_sort(w), ' '), '^\d+[.)]\s*', '') FROM w0),
v0 AS (SELECT qid * 10 AS qid, query FROM q0 UNION ALL SELECT * FROM sub WHERE query <> ''),
hx AS (SELECT key, unnest(list_transform({_tokens('t')}, lambda w: concat('0x', substr(md5(w), 1, 8))::BIGINT)) AS h FROM (SELECT chunk_id AS key, contextualized_content AS t FROM contextual UNION ALL SELECT 'q' || qid, query FROM v0)),
hy AS (SELECT key, (h // 2) % 64 AS d, sum(CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM hx GROUP BY 1, 2),
hn AS (SELECT key, sqrt(sum(v * v)) AS norm FROM hy GROUP BY 1),
ev AS (SELECT k.key, list(coalesce(hy.v / nullif(norm, 0), 0) ORDER BY r.d) AS v FROM hn k CROSS JOIN range(64) r(d) LEFT JOIN hy ON hy.key = k.key AND hy.d = r.d GROUP BY 1),
dn AS (SELECT v0.qid, c.key AS chunk_id, round(list_dot_product(q.v, c.v), 6) AS score FROM v0 JOIN ev q ON q.key = 'q' || v0.qid, ev c WHERE NOT starts_with(c.key, 'q')),
d AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id DESC) AS rank FROM dn QUALIFY rank <= 40),
{_bm25('x', 'contextual', 'chunk_id', 'contextualized_content', 'v0')}, {_bm25('y', 'contextual', 'chunk_id', 'content', 'v0')},
u AS (SELECT qid, chunk_id, round(max(score), 9) AS score FROM (SELECT qid, chunk_id, 2 * score AS score FROM x UNION ALL SELECT * FROM y) GROUP BY 1, 2),
s AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM u QUALIFY rank <= 40),
{_PROBE.split(', p AS', 1)[1].join(['p AS', '']).replace('FROM t WHERE rank <= 5', 'FROM (SELECT qid // 10 AS qid, score, rank FROM d WHERE qid % 10 = 0) WHERE rank <= 5')},
o AS (SELECT qid, CASE WHEN specificity >= 3.5 OR coalesce(margin, 0) >= 0.08 AND coalesce(entropy, 0) <= 1.3 THEN 'direct' WHEN entropy > 1.3 AND margin < 0.08 THEN 'hyde' ELSE 'multi_query' END AS tier FROM sp LEFT JOIN m USING (qid)),
{_rrf_chunks('wide', 'SELECT qid // 10 AS qid, chunk_id, rank FROM d WHERE qid % 10 = 0', 'SELECT qid // 10 AS qid, chunk_id, rank FROM s WHERE qid % 10 = 0', 20)},
{_rrf_chunks('few', 'SELECT qid, chunk_id, rank FROM d WHERE rank <= 20', 'SELECT qid, chunk_id, rank FROM s WHERE rank <= 20', 10)},
{_rrf_chunks('g1', _list(0), _list(1), 1 << 30)}, {_rrf_chunks('g2', 'SELECT * FROM g1', _list(2), 1 << 30)}, {_rrf_chunks('g3', 'SELECT * FROM g2', _list(3), 20)},
cand AS (SELECT qid, tier, chunk_id, rank FROM wide JOIN o USING (qid) WHERE tier <> 'multi_query' UNION ALL SELECT qid, tier, chunk_id, rank FROM g3 JOIN o USING (qid) WHERE tier = 'multi_query'),
fp AS (SELECT qid, tier, parent_id, min(rank) AS fr FROM cand JOIN children USING (chunk_id) GROUP BY 1, 2, 3),
res AS (SELECT qid, tier, parent_id, content, row_number() OVER (PARTITION BY qid ORDER BY fr, parent_id) AS parent_rank FROM fp JOIN parents USING (parent_id)),
rw AS (SELECT res.*, {_tokens('query')} AS qw, {_tokens('content')} AS cw FROM res JOIN q0 USING (qid))
SELECT qid, tier, parent_id, round({_COVERAGE}, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY {_COVERAGE} DESC, parent_rank) AS rank FROM rw QUALIFY rank <= 5"""


@query(_ENGINE)
def engine_search(spark, d):
    """A collection of all documents, and the engine's answers to all benchmark texts: probe, route, tiers, fusion, parents, reranking."""
    import uuid

    from fathom.plans.engine import Engine
    from fathom.sources.workspace import folder

    engine = Engine(spark, f"{folder(spark)}/engine-{uuid.uuid4().hex}", "documents")
    engine.ingest_pages(_pages(spark, d))
    found = engine.search(_queries(spark, d), 5)
    return _long(found, "rank").select("qid", "tier", "parent_id", F.round("score", 9).alias("score"), "rank")
