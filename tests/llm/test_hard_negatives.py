"""Dual-tree search against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, score double, block string"


def brute(rows, every=50):
    v = []
    for i, e, lab, *_ in rows:
        if i is None or e is None or lab is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        q = [int(np.clip(np.floor(256 * float(np.float32(x))), -H.BOUND, H.BOUND)) for x in e]
        v.append((i, (lab + 1) % 10 if i % 7 == 0 else lab, q))
    wide, out = max((len(q) for *_, q in v), default=0), []
    q = np.array([x + [0] * (wide - len(x)) for *_, x in v], np.int64).reshape(len(v), wide)
    for n, (i, lab, _) in enumerate(v):
        if i % every:
            continue
        s = q @ q[n]
        order = sorted((m for m in range(len(v)) if m != n), key=lambda m: (-s[m], v[m][0]))
        for p in [m for m in order if v[m][1] == lab][:5]:
            fits = [m for m in order if v[m][1] != lab and 50 * s[p] <= 100 * s[m] <= 95 * s[p]][:3]
            out += [(i, v[p][0], r, v[m][0], int(s[p]), int(s[m])) for r, m in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(i, e and [None if x is None else float(x) for x in e], k, 0.5, "b") for i, e, k in rows], SCHEMA)
    return sorted(tuple(r) for r in H.hard_negatives(df).collect())


def made(rng, n, dim, kinds, centres):
    """Clusters, with copies of some vectors under other ids and labels."""
    rows = []
    for i in range(n):
        c = centres[rng.randrange(len(centres))]
        e = rng.choice(rows)[1] if rows and rng.random() < 0.2 else [float(np.float32(x + rng.gauss(0, 0.2))) for x in c]
        rows.append((i, e, rng.randrange(kinds)))
    return rows


@pytest.mark.parametrize("sizes", [(1024, 16_384, 4_096), (16, 64, 3)])
def test_mined_rows_equal_all_pairs(spark, monkeypatch, sizes):
    for name, n in zip(("LEAST", "MOST", "ANCHORS"), sizes, strict=True):
        monkeypatch.setattr(H, name, n)
    monkeypatch.setattr(H, "CELL", 2)
    rng = random.Random(sizes[0])
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = made(rng, 700, 6, 4, centres)
    # ties: one vector many times; odd rows; rows that are there twice
    rows += [(i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.25], i % 3) for i in range(700, 1000)]
    rows += [(None, [1.0] * 6, 1), (1001, None, 1), (1050, [1.0] * 6, None), (1003, [1.0, None], 1), (1100, [1.0, float("nan")], 2), (1101, [float("inf")], 2), (1102, [], 2), (1150, [0.5, 2.0], 2), (1200, [1e30, -1e30], 3)]
    rows += rows[:60]
    want = brute(rows)
    assert mined(spark, rows) == want and len({r[0] for r in want}) > 15


def test_odd_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert H.hard_negatives(df).count() == 0
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert mined(spark, [(50, [1.0], 1), (51, [1.0], 1), (52, [0.6], 2)]) == [(50, 51, 1, 52, 65536, 256 * 153)]
    own = spark.createDataFrame([(7, [1.0, 0.0], 5, 0.5, "b"), (8, [1.0, 0.0], 5, 0.5, "b"), (9, [0.9, 0.0], 6, 0.5, "b")], SCHEMA).withColumnsRenamed({"vec_id": "k", "embedding": "v", "label": "l"})
    got = H.mine(own, F.col("key") == 7, key="k", label="l", vector="v", positives=1, negatives=1, low=10, high=100).collect()
    assert [tuple(r) for r in got] == [(7, 8, 1, 9, 65536, 58880)]


def test_intervals_hold_all_products_and_prune_groups():
    rng = np.random.default_rng(2)
    a, c = (np.concatenate([rng.integers(-40, 40, (n, 8)) + 300 * np.eye(8, dtype=int)[k] for k in range(2)]).astype(float) for n in (64, 256))
    a, c = a[H.tree_order(a, 8)], c[H.tree_order(c, 16)]
    ta, tc = H.Tree(a, 8), H.Tree(c, 16)
    for la in range(len(ta.levels)):
        for lc in range(len(tc.levels)):
            ea, ec = ta.levels[la][0], tc.levels[lc][0]
            i, j = (x.ravel() for x in np.meshgrid(np.arange(len(ea) - 1), np.arange(len(ec) - 1)))
            lo, hi = H.intervals(ta, tc, la, lc, i, j)
            for n in range(len(i)):
                s = a[ea[i[n]] : ea[i[n] + 1]] @ c[ec[j[n]] : ec[j[n] + 1]].T
                assert lo[n] <= s.min() and s.max() <= hi[n]
    held = H.Anchors.of(np.arange(len(a)), np.zeros(len(a), np.int64), a, np.full((len(a), 1), 60_000), np.full((len(a), 1), H.ALL), 3)
    held.meet(np.arange(len(c)) + 1000, np.arange(len(c)), 1, tc, False)
    assert held.pairs <= len(a) * len(c) / 2  # one half has nothing for the other
    s = (a @ c.T).astype(int)
    for n in range(len(a)):
        best = sorted((-s[n, m], m) for m in range(len(c)) if s[n, m] >= 60_000)[:3]
        assert [(-x, int(m)) for x, m in zip(held.score[n, 0], held.key[n, 0], strict=True) if x > H.NONE] == [(x, m) for x, m in best]
