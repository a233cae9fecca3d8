"""The network over bytes: against plain loops, its gradient, held-out rows, odd tables."""

import zlib

import numpy as np

from fathom.llm import byte_cnn as B
from fathom.llm.tables import table
from tests.llm.test_corpus_operators import ODD, docs_of

TEXTS = [b"", b"x", b"some words, " * 40, bytes(range(256)) * 3, b"z" * B.BLOCK, b"z" * (B.BLOCK - 4), "déjà vu ".encode() * 70]


def plain(net, text):
    """The same network by loops over the text."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    lead = B.PAIR * (B.WIDE - 1)
    n = -(-(lead + len(text)) // B.BLOCK)
    codes = [*[B.PAD] * lead, *text, *[B.PAD] * (n * B.BLOCK - len(text))]
    blocks = []
    for i in range(n):
        places = range(i * B.BLOCK, (i + 1) * B.BLOCK, B.PAIR)
        z = [sum(np.concatenate([p["e"][codes[at + B.PAIR * k + j]] for j in range(B.PAIR)]) @ p["w"][k] for k in range(B.WIDE)) for at in places]
        blocks.append(np.maximum(np.max(z, axis=0) + p["b"], 0))
    chunks = [np.maximum(a, b) for a, b in zip(blocks, blocks[1:], strict=False)] or blocks
    top = np.max([np.maximum(h @ p["v"] + p["c"], 0) for h in chunks], axis=0)
    return float(top @ p["u"] + p["d"][0])


def test_scores_equal_plain_loops(monkeypatch):
    net = B.Network(7)
    want = [1 / (1 + np.exp(-plain(net, t))) for t in TEXTS]
    for tile in (B.TILE, 2):
        monkeypatch.setattr(B, "TILE", tile)
        np.testing.assert_allclose(net.score(TEXTS), want, atol=1e-4)
        np.testing.assert_allclose([net.score([t])[0] for t in TEXTS], want, atol=1e-4)
    assert len(net.score([])) == 0


def test_gradient_equals_differences():
    net, y = B.Network(3), np.array([0, 1, 1, 0, 1, 0, 1], np.float32)
    # no ties between chunks, at which the loss has a corner
    net.p["b"] += np.linspace(0.1, 0.2, B.FILTERS, dtype=np.float32)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    batch = B.Batch.of(TEXTS)

    def loss():
        z = net.forward(batch)[0]
        return float(np.mean(np.logaddexp(0, z) - y * z))

    g, rng = net.gradient(batch, y), np.random.default_rng(1)
    for k, v in net.p.items():
        used = np.flatnonzero(g[k].ravel()) if np.any(g[k]) else np.arange(v.size)
        for i in rng.choice(used, min(5, len(used)), replace=False):
            old, eps = float(v.ravel()[i]), 1e-5
            v.ravel()[i] = old + eps
            up = loss()
            v.ravel()[i] = old - eps
            down = loss()
            v.ravel()[i] = old
            assert abs((up - down) / (2 * eps) - g[k].ravel()[i]) < 1e-5 + 1e-3 * abs(g[k].ravel()[i]), (k, i)


def test_held_out_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = {r.doc_id: r for r in B.quality_scores(docs, labels).collect()}
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    rows = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = [r.predicted for r, q in rows if q == 1], [r.predicted for r, q in rows if q == 0]
    assert len(bad) > 5 and sum(good) / len(good) > 0.9 and sum(bad) / len(bad) < 0.5


def test_odd_tables(spark):
    few = spark.createDataFrame([(1, 1), (4, 1), (None, 0), (5, None)], "doc_id long, quality int")
    odd = docs_of(spark, ODD)
    assert {r.score for r in B.quality_scores(odd, few.limit(0)).collect()} == {0.5}
    assert {r.score for r in B.quality_scores(odd, few).collect()} == {1.0}
    rows = [*ODD, *[(i, "#% " * i if i % 2 else "some calm words ") for i in range(20, 60)]]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(20, 60)] + [(20, 1), (5, 1), (5, 0), (6, 1)], "doc_id long, quality int")
    df = docs_of(spark, rows)
    first, again = [sorted((r.doc_id or 0, r.score) for r in B.quality_scores(df, labels).collect()) for _ in range(2)]
    assert first == again and len(first) == len(rows)
    texts, y = B.sample(df, labels)
    assert len(texts) == len(y) and all(zlib.crc32(str(i).encode()) % 5 for i, t in rows if i and i >= 20 and t.encode() in texts and i % 2)
    assert B.quality_scores(df.limit(0), labels).count() == 0
    out = B.score(df, B.Constant(0.25), name="score_")
    assert out.columns == [*df.columns, "score_"]


def test_sample_keeps_both_bounds(spark, monkeypatch):
    monkeypatch.setattr(B, "BYTES", 100)
    df = docs_of(spark, [(i, "x" * (101 if i == 3 else i)) for i in range(60)])
    texts, y = B.sample(df, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int"))
    assert 0 < sum(map(len, texts)) <= 100 and len(texts) == len(y)
    monkeypatch.setattr(B, "ROWS", 2)
    assert len(B.sample(df, spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int"))[0]) <= 2
