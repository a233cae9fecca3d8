"""Fusion, segmentation, routing, resolution and evaluation against small restatements."""

import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.operators import chunking, dense, evaluate, fusion, lexical, resolve, router, semantic, vector_index
from fathom.sources import collection


def ranked(spark, items, q=0):
    return spark.createDataFrame([(q, c, n, 0.0) for n, c in enumerate(items, 1)], "qid long, id string, rank int, score double")


def test_rrf_ties_and_payload(spark):
    d, s = ["a", "b", "c", "d"], ["c", "x", "b", "y"]
    score = {}
    for items in (d, s):
        for n, c in enumerate(items, 1):
            score[c] = score.get(c, 0) + 1 / (60 + n)
    want = sorted(score, key=lambda c: -score[c])  # stable: dense first, then sparse
    got = fusion.rrf(ranked(spark, d), ranked(spark, s), "id", 10).orderBy("rank").collect()
    assert [r.id for r in got] == want
    assert all(math.isclose(r.rrf_score, score[r.id]) for r in got)


def test_fold_ranks_the_merged_list_anew(spark):
    lists = [["a", "b"], ["b", "c"], ["c", "a"]]
    order = lists[0]
    for later in lists[1:]:
        score = {}
        for items in (order, later):
            for n, c in enumerate(items, 1):
                score[c] = score.get(c, 0) + 1 / (60 + n)
        order = sorted(score, key=lambda c: -score[c])
    got = fusion.fold([ranked(spark, x) for x in lists], "id", 10).orderBy("rank").collect()
    assert [r.id for r in got] == order


def test_weighted_reciprocal(spark):
    got = fusion.weighted_reciprocal(ranked(spark, ["a", "b", "a"]), ranked(spark, ["b", "c"]), ["id"], 3).orderBy("rank").collect()
    assert [(r.id, r.from_semantic, r.from_bm25) for r in got] == [("a", True, False), ("b", True, True), ("c", False, True)]
    assert [r.score for r in got] == [1.0, 0.5, 1 / 3]


def brute(v, longest):
    n = len(v)
    m = np.round(v @ v.T, 9)
    if n > 1:
        m = m - round(float(m[np.triu_indices(n, 1)].mean()), 9)
    np.fill_diagonal(m, 0)
    best, seg = [0.0] * n, [0] * n
    for i in range(n):
        for size in range(1, longest + 1):
            if i - size + 1 >= 0:
                x = round(m[i - size + 1 : i + 1, i - size + 1 : i + 1].sum() + (best[i - size] if i - size >= 0 else 0), 6)
                if x > best[i]:
                    best[i], seg[i] = x, i - size + 1
    out, i = [], n - 1
    while i >= 0:
        out.append((seg[i], i))
        i = seg[i] - 1
    return out[::-1]


@settings(max_examples=40, deadline=None)
@given(n=st.integers(1, 40), seed=st.integers(0, 1000), longest=st.integers(1, 9))
def test_segmentation(n, seed, longest):
    v = np.random.default_rng(seed).normal(size=(n, 3)).round(2)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    got = semantic.segmentation(v, longest)
    assert [i for a, b in got for i in range(a, b + 1)] == list(range(n))
    assert got == brute(v, longest)


def test_segmentation_without_gain_is_one_cluster():
    assert semantic.segmentation(np.ones((20, 2))) == [(0, 19)]
    assert semantic.segmentation(np.ones((1, 2))) == [(0, 0)]
    assert all(b - a < 8 for a, b in semantic.segmentation(np.ones((20, 2)), strict=True))


def test_split_by_size(spark):
    rows = spark.createDataFrame([(n, " ".join(["w"] * n)) for n in (1, 38, 39, 78, 80)], "n int, text string")
    got = {}
    for r in chunking.split_by_size(rows).collect():
        got.setdefault(r.n, []).append(len(r.text.split()))
    assert {k: sorted(v, reverse=True) for k, v in got.items()} == {1: [1], 38: [38], 39: [39], 78: [39, 39], 80: [39, 39, 2]}


def test_orphans_keep_their_content(spark):
    c = spark.createDataFrame([("c", "p", "d", "f", "text", 1), ("o", "x", "d", "f", "own", 1)], "chunk_id string, parent_id string, doc_id string, filename string, content string, page_number int")
    p = spark.createDataFrame([("p", "d", "f", "y" * 300, 1, 1)], "parent_id string, doc_id string, filename string, content string, page_start int, page_end int")
    got = {r.chunk_id: r.contextualized_content for r in chunking.contextualise(c, p).collect()}
    assert got == {"o": "own", "c": "Document: f (Page 1)\nSection: " + "y" * 200 + "...\n\ntext"}


def test_bm25(spark):
    texts = ["a b b", "b c", "", None, "d"]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "b b a"), (2, "zzz"), (3, None)], "qid long, query string")
    words = [t.split() for t in texts if t]
    avg, n = sum(map(len, words)) / len(words), len(words)
    df = {t: sum(t in w for w in words) for t in "ab"}
    want = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * (tf / (tf + 1.2 * (0.25 + 0.75 * 3 / avg))) for t, tf in (("b", 2), ("b", 2), ("a", 1)))
    got = lexical.search(docs, q, 5).orderBy("rank").collect()
    assert [(r.qid, r.doc_id) for r in got] == [(1, 0), (1, 1)]
    assert math.isclose(got[0].score, want, abs_tol=1e-8)


def test_dense_ties_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(30, 4))
    v[7] = v[3]
    have = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    asked = have.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    monkeypatch.setattr(dense, "BLOCK", 28)
    got = {}
    for r in dense.nearest(have, asked, 3).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.vec_id)
    s = np.round(v @ v.T, 6)
    assert got == {q: sorted(range(30), key=lambda i: (-s[q, i], -i))[:3] for q in range(30)}


def test_hashed_embedding(spark):
    r = spark.createDataFrame([("a b c",), ("",)], "x string").select(dense.hashed_embedding("x", 16).alias("v")).collect()
    assert math.isclose(sum(x * x for x in r[0].v), 1) and r[1].v == [0.0] * 16


def test_specificity_of_all_queries(spark):
    import duckdb

    from fathom.plans import catalog

    data = "/root/testdata/sf0.01"
    got = {r.qid: r.specificity for r in catalog.QUERIES["query_specificity"](spark, data).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{data}/benchmark.parquet'")
    want = dict(con.execute(catalog.ORACLES["query_specificity"]).fetchall())
    assert len(got) == con.execute("SELECT count(*) FROM benchmark").fetchone()[0] and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-8 for k in got)


def test_tiers(spark):
    rows = spark.createDataFrame([(3.5, 0.0, 2.0), (0.0, 0.08, 1.3), (0.0, 0.0, 1.4), (0.0, 0.1, 1.5), (0.0, 0.0, 0.0)], "s double, m double, h double")
    assert [r.t for r in rows.select(router.tier(F.col("s"), F.col("m"), F.col("h")).alias("t")).collect()] == ["direct", "direct", "hyde", "multi_query", "multi_query"]
    line = spark.createDataFrame([("1. a\n\n 2) b \nc\nd",)], "x string").select(router.sub_queries(F.col("x")).alias("y")).first().y
    assert line == ["a", "b", "c"]


def test_parents_and_fallback(spark):
    hits = ranked(spark, ["c3", "c1", "c2", "zz"]).withColumnRenamed("id", "chunk_id")
    children = spark.createDataFrame([("c1", "p1"), ("c2", "p2"), ("c3", "p2"), ("zz", "gone")], "chunk_id string, parent_id string")
    parents = spark.createDataFrame([("p1", "x"), ("p2", "y")], "parent_id string, content string")
    found = resolve.resolve_parents(hits, children, parents)
    assert [r.parent_id for r in found.orderBy("parent_rank").collect()] == ["p2", "p1"]
    assert [r.score for r in resolve.rerank_fallback(found, 5).orderBy("rank").collect()] == [1.0, 0.95]


def test_pass_at_k(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    gold = spark.createDataFrame([(1, " a\n"), (1, "b"), (2, "c")], "qid long, content string")
    hits = spark.createDataFrame([(1, "a"), (1, "a "), (2, "x"), (3, "c")], "qid long, content string")
    r = evaluate.pass_at_k(q, gold, hits).first()
    assert math.isclose(r.pass_at_k, 100 / 6) and (r.n_queries, r.n_found) == (3, 1)
    assert evaluate.pass_at_k(q.limit(0), gold, hits).first().pass_at_k is None


def test_golden_items(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"query":"q","golden_chunk_uuids":[["u",1],["u",9]],"golden_documents":[{"uuid":"u","chunks":[{"index":1,"content":"x"},{"index":1,"content":"y"}]}]}\n')
    from fathom.sources.tables import evaluation_items

    assert [r.content for r in evaluate.golden(evaluation_items(spark, str(tmp_path / "e.jsonl"))).collect()] == ["x"]


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "doc_id long, text string")
    new = spark.createDataFrame([(2, "n"), (3, "m")], "doc_id long, text string")
    assert sorted(map(tuple, collection.upsert(old, new).collect())) == [(1, "a"), (2, "n"), (3, "m")]
    assert [r.doc_id for r in collection.delete(old, new).collect()] == [1]


def test_nearest_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (300, 4)).astype(float)  # many ties
    rows = spark.createDataFrame([(f"k{n:03d}", x.tolist()) for n, x in enumerate(v)] + [("none", None)], "key string, embedding array<double>")
    asked = spark.createDataFrame([(q, x.tolist()) for q, x in enumerate(v[:7])] + [(99, None)], "qid long, vector array<double>")
    want = {}
    for q in range(7):
        order = sorted(range(300), key=lambda n: (-(v[n] @ v[q]), [-ord(c) for c in f"k{n:03d}"]))[:6]
        want[q] = [f"k{n:03d}" for n in order]
    for block, product, corpus, query, held in ((4_000_000, 4_000_000, 4096, 1024, 32_000_000), (8, 70, 50, 2, 20), (4_000_000, 70, 7, 1, 5)):
        for name, value in (("BLOCK", block), ("PRODUCT", product), ("CORPUS_ROWS", corpus), ("QUERY_ROWS", query), ("HELD", held)):
            monkeypatch.setattr(dense, name, value)
        got = dense.nearest(rows, asked, 6, key="key").orderBy("qid", "rank").collect()
        assert {q: [r.key for r in got if r.qid == q] for q in range(7)} == want and len(got) == 42
    assert dense.nearest(rows, asked.where("qid = 99"), 6, key="key").count() == 0


def test_nearest_scans_the_corpus_once(spark, tmp_path, monkeypatch):
    """Ten blocks of queries are one plan with one scan, not ten."""
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(rng.normal(size=(200, 4)))], "vec_id long, embedding array<double>")
    rows.write.parquet(str(tmp_path / "corpus"))
    corpus = spark.read.parquet(str(tmp_path / "corpus"))
    asked = rows.where("vec_id < 100").selectExpr("vec_id as qid", "embedding as vector").repartition(1)
    want = [tuple(r) for r in dense.nearest(corpus, asked, 5).orderBy("qid", "rank").collect()]
    for name, value in (("BLOCK", 40), ("QUERY_ROWS", 10)):
        monkeypatch.setattr(dense, name, value)
    found = dense.nearest(corpus, asked, 5)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    assert [tuple(r) for r in found.orderBy("qid", "rank").collect()] == want and len(want) == 500


def test_lsh_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    v = centres[rng.integers(0, 20, 600)] + 0.3 * rng.normal(size=(600, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(v)], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id < 40").selectExpr("vec_id as qid", "embedding as vector")
    exact = {(r.qid, r.vec_id): r.score for r in dense.nearest(rows, asked, 10, knn=True).collect()}
    found = dense.lsh_candidates(rows, asked, 10).collect()
    assert sum((r.qid, r.vec_id) in exact for r in found) / len(exact) >= 0.9
    assert all(abs(exact[r.qid, r.vec_id] - r.score) < 1e-5 for r in found if (r.qid, r.vec_id) in exact)


def bm25(texts, query, term=lambda w: w, k1=1.2, b=0.75):
    """Scores of all documents by loops."""
    docs = [[t for t in map(term, re.findall(r"\w+(?:['.]\w+)*", (x or "").lower())) if t] for x in texts]
    n, avg = sum(map(bool, docs)), sum(map(len, docs)) / max(1, sum(map(bool, docs)))
    out = [0.0] * len(docs)
    for w in (t for t in map(term, re.findall(r"\w+(?:['.]\w+)*", query.lower())) if t):
        df = sum(w in d for d in docs)
        for k, d in enumerate(docs):
            tf = d.count(w)
            if tf:
                out[k] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + k1 * (1 - b + b * len(d) / avg))
    return out


@pytest.mark.parametrize("analyze", [T.tokens, lexical.english_tokens])
def test_bm25_equals_brute_force(spark, monkeypatch, analyze):
    """Small parts, blocks and chunks of queries, of plain and of English terms; null and empty texts."""
    for name, n in (("PART", 40), ("BLOCK", 4), ("QUERIES", 3), ("PRODUCTS", 50)):
        monkeypatch.setattr(lexical, name, n)
    rng = random.Random(8)
    words = "the running runs ran of harbour's harbours lanterns lantern and old ponies it's x.y".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(25))) for _ in range(150)] + [None, "", "lantern " * 30]
    asked = ["running harbours", "the of and", "lantern lantern old", "", "unknown", "it's ponies X.Y runs", "old", "harbour's"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = lexical.search(docs, spark.createDataFrame(list(enumerate(asked)), "qid long, query string"), 7, analyze=analyze).collect()
    term = lexical.english_term if analyze is lexical.english_tokens else (lambda w: w)
    for q, query in enumerate(asked):
        want = sorted(((-round(x, 9), d) for d, x in enumerate(bm25(texts, query, term)) if x > 0))[:7]
        assert [(r.doc_id, round(r.score, 8)) for r in sorted((r for r in got if r.qid == q), key=lambda r: r.rank)] == [(d, round(-x, 8)) for x, d in want]


def test_blocks_that_cannot_matter_are_left_out():
    """Documents with a rare term stand together: for a query that has it, the other blocks are never scored."""
    rng, n = np.random.default_rng(3), 64 * lexical.BLOCK
    dl = np.full(n, 20.0)
    rows = {"docs": [np.arange(n), np.arange(100, 160)], "tf": [rng.integers(1, 4, n), np.full(60, 2)], "idf": [0.1, 6.0], "avgdl": [20.0, 20.0], "qs": [np.array([0, 1]), np.array([0])], "qtfs": [np.array([1.0, 1.0]), np.array([1.0])]}
    field = lexical._Field(pd.DataFrame(rows), dl, 1.0)
    for k in (5, 40):
        best = lexical._Best(2, k)
        lexical.score_part([field], np.arange(n), best)
        whole, made = field.scores(np.ones((2, 64), bool), n)
        assert made == 2 * n + 60 and best.pairs < made - n // 2
        for q in range(2):
            order = sorted(range(n), key=lambda d: (-round(whole[q, d], 9), d))[:k]
            assert best.key[best.q == q].tolist() == order


def test_containing(spark):
    docs = spark.createDataFrame([(1, "x aone two three four five six sevenb y"), (2, "one two  three four five six seven"), (3, "one two three four five six seven"), (4, "a b c"), (5, None)], "doc_id long, content string")
    asked = spark.createDataFrame([(0, "one two three four five six seven"), (1, "b c"), (2, "one two three four five six seven eight")], "qid long, query string")
    got = sorted((r.qid, r.doc_id) for r in evaluate.containing(docs, asked).collect())
    assert got == [(0, 1), (0, 3), (1, 4)]


def test_containing_of_many_short_queries(spark, monkeypatch):
    texts = ["abcdefghij klm", "xy", "", "é b c", None, "cdefghijkl", "the cat the cat"]
    asked = [*"abé ", "", "bc", "cdefghij", "cdefghijk", "the cat", "t the c", "zz", "abcdefghij klm"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    monkeypatch.setattr(evaluate, "FEW", 3)
    got = sorted((r.qid, r.doc_id) for r in evaluate.containing(docs, spark.createDataFrame(list(enumerate(asked)), "qid long, query string")).collect())
    assert got == sorted((q, d) for q, a in enumerate(asked) for d, t in enumerate(texts) if t is not None and a in t)


def test_kept_vector_index(spark, tmp_path):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 10))
    v = centres[rng.integers(0, 12, 900)] + 0.3 * rng.normal(size=(900, 10))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(f"k{n:03d}", x.tolist()) for n, x in enumerate(v)] + [("none", None)], "key string, embedding array<double>")
    asked = rows.where("key < 'k050'").selectExpr("key as qid", "embedding as vector")
    path = f"file://{tmp_path}/index"
    vector_index.VectorIndex(spark, path).fit(rows.where("key < 'k600'"), "key", lists=16)
    kept = vector_index.VectorIndex(spark, path)  # opened again, and added to
    kept.add(rows.where("key < 'k600'"), "key")
    kept.add(rows.where("key >= 'k600' or embedding is null"), "key")
    assert kept.lists().selectExpr("sum(size(keys))").first()[0] == 900
    exact = {(r.qid, r.key): (r.score, r.rank) for r in dense.nearest(rows, asked, 10, key="key").collect()}
    found = kept.search(rows, asked, 10, "key").collect()
    assert sum((r.qid, r.key) in exact for r in found) / len(exact) >= 0.9 and len(found) == 500
    assert all(abs(exact[r.qid, r.key][0] - r.score) < 1e-5 for r in found if (r.qid, r.key) in exact)
    one = asked.limit(1)
    named = [r.centroid for r in kept.probed(one).select("centroid").distinct().collect()]
    read = lambda x: x.select(F.input_file_name()).distinct().count()
    assert read(kept.lists(named)) < read(kept.lists()) / 2
    assert "PartitionFilters: [centroid" in kept.lists(named)._jdf.queryExecution().executedPlan().toString()
    # all lists and a shortlist of all rows give the exact result
    whole = {(r.qid, r.key): (r.score, r.rank) for r in kept.search(rows, asked, 10, "key", probes=16, shortlist=900).collect()}
    assert whole == exact


def test_stems():
    from fathom.functions.stemming import stem

    # the algorithm's published examples
    pairs = "caresses:caress ponies:poni cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat sized:size hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat rational:ration vietnamization:vietnam triplicate:triplic electrical:electr adoption:adopt probate:probat rate:rate cease:ceas controll:control roll:roll generalizations:gener oscillators:oscil"
    for x in pairs.split():
        word, want = x.split(":")
        assert stem(word) == want
    assert stem("für") == "für" and stem("is") == "is"


def test_english_terms(spark):
    got = spark.range(1).select(lexical.english_tokens(F.lit("The ponies' owner's horses were running to the river"))).first()[0]
    assert got == ["poni", "owner", "hors", "were", "run", "river"]


def test_missing_chunks_are_counted(spark):
    hits = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (1, "b", 1)], "qid long, chunk_id string, rank int")
    have = spark.createDataFrame([("a",)], "chunk_id string")
    assert sorted(map(tuple, resolve.missing(hits, have).collect())) == [(0, 1), (1, 1)]


def test_rerank_with_fewer_candidates(spark):
    rows = spark.createDataFrame([(0, "a", 1, 0.5), (0, "b", 2, 0.5), (0, "c", 3, 0.9)], "qid long, chunk_id string, rank int, s double")
    got = resolve.rerank_chunks(rows, 9, F.col("s"), "chunk_id").orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["c", "a", "b"]


def test_chunks_of_documents_that_span_batches(spark):
    from fathom.plans import contextual

    rng = np.random.default_rng(3)
    rows = [(f"d{n % 7 if n % 3 else 0}", n // 9, n, f"s{n}", rng.normal(size=4).round(2).tolist()) for n in range(200)]
    rows += [("lone", None, 0, "x", [1.0, 0.0, 0.0, 0.0]), (None, 2, 0, "y", [0.0] * 4), (None, 1, 1, "z", [0.0] * 4)]
    segments = spark.createDataFrame(rows, "doc_id string, page int, seg_idx long, text string, embedding array<double>")
    want = semantic.assemble(segments.drop("embedding"), semantic.clusters(segments)).where("doc_id is not null").collect()
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = semantic.chunks(segments.repartition("doc_id").sortWithinPartitions("doc_id", "seg_idx")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted(map(tuple, (r for r in got if r.doc_id))) == sorted(map(tuple, want)) and [(r.content, r.page_start, r.page_end) for r in got if not r.doc_id] == [("y z", 1, 2)]
    # one shuffle by document, and nothing is written between
    pages = spark.createDataFrame([("a", 1, "One sentence here. Another sentence here.")], "doc_id string, page int, text string")
    plan = contextual.cluster_chunks(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(doc_id") == 1 and "Window" not in plan and "FlatMapGroups" not in plan and "Join" not in plan


def test_nearest_makes_few_products_twice_and_keeps_ties():
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    corpus, queries = unit(rng.normal(size=(9000, 16))), unit(rng.normal(size=(50, 16)))
    cases = [(corpus, queries, 10), (np.repeat(corpus[:30], 300, 0), queries, 10), (rng.normal(size=(3000, 16)).round(1) * 1e30, queries * 1e20, 5), (corpus[:7], queries, 10)]
    odd = corpus.copy()
    odd[4000, 3], odd[8000, 2] = np.nan, 1e300
    for x, q, k in [*cases, (odd, queries, 10)]:
        for keys in (rng.permutation(len(x)), rng.permutation(len(x)).astype(str)):
            best = dense._Best(list(range(len(q))), q, k)
            for at in range(0, len(x), 4096):
                best.add(x[at : at + 4096], keys[at : at + 4096])
            near = np.round(x @ q.T, 6)
            want, names = dense._best_each(near, np.broadcast_to(keys[:, None], near.shape), k)
            assert np.array_equal(best.keys, names) and np.allclose(best.scores, want, rtol=1e-9, atol=0, equal_nan=True)
            if x is corpus:
                assert best.made < 0.2 * near.size


def test_queries_that_go_together_score_as_alone(spark, monkeypatch):
    """Postings are sent once for several numbers of queries that are scored together, with the same result."""
    for name, n in (("PART", 40), ("BLOCK", 4), ("QUERIES", 3), ("PRODUCTS", 50)):
        monkeypatch.setattr(lexical, name, n)
    rng, words = random.Random(4), [f"w{n}" for n in range(30)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = spark.createDataFrame([(n, text(12)) for n in range(150)], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(n, text(3)) for n in range(20)], "qid long, query string")
    found = {}
    for together in (1, 8):
        monkeypatch.setattr(lexical, "TOGETHER", together)
        assert (lexical.Asked.of(asked).chunks == 1) == (together == 8)
        found[together] = sorted(map(tuple, lexical.search(docs, asked, 5).collect()))
    assert found[1] == found[8] and len(found[1]) > 90


def test_memory_of_scoring_a_part():
    """A whole part against a full set of queries, each document with each term."""
    import tracemalloc

    n, terms, rng = lexical.PART, 24, np.random.default_rng(1)
    every, own = np.arange(n), np.arange(lexical.QUERIES)
    rows = {"docs": [every] * terms, "tf": [rng.integers(1, 4, n) for _ in range(terms)], "idf": [0.5] * terms, "avgdl": [20.0] * terms, "qs": [own] * terms, "qtfs": [np.ones(len(own), int)] * terms}
    field = lexical._Field(pd.DataFrame(rows), np.full(n, 20.0), 1.0)
    tracemalloc.start()
    lexical.score_part([field], every, lexical._Best(lexical.QUERIES, 20))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 220, peak


def test_contexts_without_a_join(spark):
    pages = spark.createDataFrame([("a", "f", 1, "one two three " * 500), ("b", None, 2, "four"), ("c", "f", 1, None)], "doc_id string, filename string, page int, text string")
    parents = chunking.parents(pages)
    alone = chunking.contextualise(chunking.children(parents, head=True)).drop("head")
    want = chunking.contextualise(chunking.children(parents), parents).select(*alone.columns)
    assert sorted(map(repr, alone.collect())) == sorted(map(repr, want.collect()))
    assert "Join" not in alone._jdf.queryExecution().executedPlan().toString()


def test_texts_of_chunks_are_cut_into_terms_once(spark):
    """Terms of sentences become those of chunks, contexts and vectors; the plans cut no text of a chunk for its vector, and one for the index."""
    from fathom.plans import contextual

    store_pages = spark.createDataFrame(
        [(f"a{n}", "f", n, "Old ΣΑΣ lanterns burn. The harbour's keeper v1.2 slept!\n\n'Quoted words, again.' Another long sentence here? " * n) for n in range(1, 4)] + [("b", "f", 1, None)],
        "doc_id string, filename string, page int, text string",
    )
    found = contextual.cluster_chunks(store_pages, terms=True)
    assert found.drop("terms").columns == contextual.cluster_chunks(store_pages).columns
    rows = contextual.with_contexts(found.withColumn("original_uuid", F.col("doc_id")))
    assert rows.where(F.col("terms") != T.tokens("content")).isEmpty() and rows.count() > 1
    known = dense.hashed_terms((F.col("terms"), 2), (T.tokens("page_info"), 1))
    assert rows.where(known != dense.hashed_embedding("text_to_embed")).isEmpty()
    plan = contextual.cluster_chunks(store_pages)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan


def test_index_of_fields_put_together(spark, monkeypatch):
    rows = spark.createDataFrame([(n, f"red lantern {n} {n % 3}" if n % 4 else None, f"Page: {n % 2}") for n in range(50)], "key long, content string, page_info string")
    rows = rows.withColumn("context", F.concat("content", F.lit("\n"), "page_info")).repartition(2, "key")
    entries = lambda index: sorted((r.field, r.term, key, tf) for r, keys in named(index) for key, tf in zip((keys[d] for d in r.docs), r.tf, strict=True))

    def named(index):
        all_ = index.rows.collect()
        keys = {r.part: r["keys"] for r in all_ if r.term is None}
        return [(r, keys[r.part]) for r in all_ if r.term is not None]

    for analyze in (T.tokens, lexical.english_tokens):
        plain = lexical.index(rows, "key", ["content", "context"], analyze)
        once = lexical.index(rows, "key", ["content", "context"], analyze, made_of={"context": ["content", "page_info"]})
        assert entries(once) == entries(plain) and sorted(map(tuple, once.stats.collect())) == sorted(map(tuple, plain.stats.collect()))
    # parts are filled over batches, and end early where texts are long
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        monkeypatch.setattr(lexical, "PART", 20)
        whole = lexical.index(rows, "key", ["content"], owner="key")
        assert max(len(r["keys"]) for r in whole.documents.collect()) > 7 and entries(whole) == entries(lexical.index(rows, "key", ["content"]))
        monkeypatch.setattr(lexical, "FULL", 8)
        short = lexical.index(rows, "key", ["content"], owner="key")
        assert max(len(r["keys"]) for r in short.documents.collect()) <= 4 and entries(short) == entries(whole)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
