"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathom.llm import period_runs
from tests.llm.test_corpus_operators import ODD, docs_of


def brute(w, least=6, exponent=4):
    """For each period the stretches that keep it."""
    out = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


pieces = st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=6), st.integers(1, 9)), max_size=5)


@settings(max_examples=150, deadline=None)
@given(st.lists(pieces, max_size=4))
def test_runs_equal_brute_force(documents):
    documents = [[w for piece, n in d for w in piece * n] for d in documents]
    assert [[tuple(map(int, r)) for r in rows] for rows in period_runs.runs_of(documents)] == [brute(w) for w in documents]


@pytest.mark.parametrize("least,exponent,k", [(6, 4, 5), (4, 4, 3), (12, 5, 10), (40, 4, 30)])
def test_k_follows_from_the_least_overlap(least, exponent, k):
    assert period_runs.overlap(least, exponent) == k == min(max(least, exponent * q) - q for q in range(1, 500))
    rng = random.Random(k)
    for _ in range(60):
        w = [rng.choice("ab") for _ in range(rng.randrange(30))] + [rng.choice("abc") for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 12)
        assert [tuple(map(int, r)) for r in period_runs.runs_of([w], least, exponent)[0]] == brute(w, least, exponent)


def test_long_documents_stay_cheap():
    rng = random.Random(1)
    for w in (["a"] * 60_000, [str(i % 7001) for i in range(60_000)], [rng.choice("ab") for _ in range(60_000)]):
        rows = period_runs.runs_of([w])[0]
        for s, e, q in rows[:50]:
            assert w[s : e - q] == w[s + q : e] and (e == len(w) or w[e] != w[e - q]) and (s == 0 or w[s - 1] != w[s - 1 + q])
    with pytest.raises(ValueError):
        period_runs.runs_of([["a"] * 30], exponent=3)


def test_report(spark):
    rng = random.Random(5)
    rows = [*ODD, (-3, "a b " * 9), (-4, "a " * 7 + "x y z " * 4 + "c " * 6), (2**62 + 1, "x y z " * 5 + "q"), *[(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(300))) + "\x0b\n y" * rng.randrange(9)) for i in range(100, 180)]]
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            a = (h // 10) % len(w)
            p = 1 + (len(w) - a) // (3 + (h // 10) % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(len(w))]
        runs = brute(w) if len(set(w)) > 1 or len(w) < 1000 else [(0, len(w), 1)]
        gone = {j for s, e, q in runs for j in range(s + q, e)}
        best = min(((s - e, s, q) for s, e, q in runs), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(runs), *((best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    got = [tuple(r) for r in period_runs.run_report(docs_of(spark, rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and any(r[1] > 1 for r in want)
    assert period_runs.run_report(docs_of(spark, rows).limit(0)).count() == 0
