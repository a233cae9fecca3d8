"""Expressions against restatements in Python."""

import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathom.functions import text as T


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def cut(words, size, overlap):
    out, step, i = [], max(1, size - overlap), 0
    while i < len(words):
        out.append(" ".join(words[i : i + size]))
        if i + size >= len(words):
            break
        i += step
    return out


def test_windows(spark):
    texts = [None, "", "  \n", "a", "a b c\x85d\x1ce"] + [" ".join(map(str, range(n))) for n in (199, 200, 201, 370, 371, 1000, 1001, 1851)]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, x string")
    got = {r.n: (r.a, r.b) for r in rows.select("n", T.windows(T.words("x"), 200, 30).alias("a"), T.windows(T.words("x"), 7, 9).alias("b")).collect()}
    for n, t in enumerate(texts):
        assert got[n] == (cut((t or "").split(), 200, 30), cut((t or "").split(), 7, 9))


def test_sentences_and_segments(spark):
    assert one(spark, "A b. \n C!? 3.14 ", T.sentences("x")) == ["A b", "C", "3", "14"]
    assert one(spark, "ten chars!\n\nten chars z. elevenchars", T.segments("x")) == ["ten chars z", "elevenchars"]


def test_labels(spark):
    rows = spark.createDataFrame([(None, None), (0, 0), (3, 3), (3, 5), (4, None)], "a int, b int")
    got = [tuple(r) for r in rows.select(T.page_info("a", "b"), T.page_citation("a", "b")).collect()]
    assert got == [("Page: Unknown", "page unknown"), ("Page: 0", "page unknown"), ("Page: 3", "p. 3"), ("Pages: 3-5 (chunk spans multiple pages)", "pp. 3-5"), ("Page: 4", "page unknown")]


def test_specificity(spark):
    def expected(q):
        w = re.findall(r"\b[a-zA-Z0-9_-]+\b", q.lower())
        each = [0.5 if x in T.STOP_WORDS else 2 * math.log(len(x) + 1) * len(set(x)) / len(x) for x in w]
        return sum(each) / len(each) if each else 0.0

    for q in ("what is the table", "Database revenue", "", "?!", "für elan", "aaa-b_c 12"):
        assert abs(one(spark, q, T.specificity("x")) - expected(q)) < 1e-9
    assert len(T.STOP_WORDS) == 41


def test_probe(spark):
    def entropy(s):
        e = [math.exp((x - max(s)) / 0.15) for x in s]
        return -sum(x / sum(e) * math.log(x / sum(e) + 1e-12) for x in e)

    for s in ([], [0.7], [0.9, 0.8, 0.8, 0.8, 0.8], [0.5] * 5):
        got = spark.createDataFrame([(s,)], "s array<double>").select(T.probe_margin(F.col("s")).alias("m"), T.probe_entropy(F.col("s")).alias("h")).first()
        assert abs(got.m - (s[0] - s[1] if len(s) > 1 else sum(s))) < 1e-12
        assert abs(got.h - (entropy(s) if len(s) > 1 else 0)) < 1e-9


def test_citations(spark):
    def link(n):
        return f'<a href="#source-{n}" style="{T.LINK_STYLE}">[{n}]</a>'

    got = one(spark, "x [Source 1, Source 8, p. 15] (Source 4, 15) [Source 2; Source 3, p. 2] [Source 7)\n\n**Sources:**\n[1] a", T.cite("x"))
    assert got == f"x {link(1)} {link(8)} {link(4)} {link(2)} {link(3)} {link(7)}"


def test_headers(spark):
    t = "Chapter: One\nSection: s\nChapter: Two Chapter: x"
    assert one(spark, t, T.header("x", "Chapter")) == "Two x"
    assert one(spark, t, T.header("x", "Heading")) is None


@settings(max_examples=15, deadline=None)
@given(n=st.integers(0, 60), size=st.integers(1, 20), overlap=st.integers(0, 25))
def test_windows_cover_every_word(n, size, overlap):
    w = [str(i) for i in range(n)]
    assert {x for c in cut(w, size, overlap) for x in c.split()} == (set(w) if overlap <= size or n <= size else {x for c in cut(w, size, overlap) for x in c.split()})


def test_upper_letter_by_letter(spark):
    import duckdb

    every = [chr(n) for n in range(1, 0x20000) if not 0xD800 <= n < 0xE000]
    texts = ["straße\nŉ ﬁn ᾳß", "Ärger", "", None, *("a" + "".join(every[n : n + 500]) + "z" for n in range(0, len(every), 500))]
    got = [r[0] for r in spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n long, t string").orderBy("n").select(T.upper("t")).collect()]
    want = [duckdb.execute("select upper(?)", [t]).fetchone()[0] for t in texts]
    assert got[0] == "STRAẞE\nŉ ﬁN ᾼẞ" and got == want
