"""The ten operators and the pipeline against brute force, round trips and held-out labels."""

import hashlib
import io
import random
import re
import struct
import zlib
from collections import Counter
from functools import lru_cache

import duckdb
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathom.llm import components, decontamination, near_dup, packing, pii, quality_rules, queries, scratch, secret_scan, token_planes, tokens, toxicity, url_filter, warc
from fathom.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, blob string, node string, score double, n_chars long"


def docs_of(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "b", "n", 0.5, None if t is None else len(t)) for i, t in rows], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(["on", "the", "sea", "Wind", "rain", "old", "tree,", "ñandú", "house", "stone"]) + rng.choice(["", "s", "er", "ing"]) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n\t"), (None, None), (None, "no id"), (4, "x"), (5, "x"), (5, "x"), (6, "long " * 30_000)]

# --- secrets ---


def brute_spans(t):
    out = []
    for n, (kind, pattern, least, group) in enumerate((("assign", secret_scan.ASSIGN, 6, 2), ("access", secret_scan.ACCESS, 20, 0), ("hex", secret_scan.HEX, 24, 0))):
        for m in re.finditer(pattern, t, re.ASCII | (re.I if kind == "assign" else 0)):
            if len(m[group]) >= least:
                out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out))


def test_secrets_and_ledger(spark):
    rows = [*ODD, (7, 'é PASSWORD = "abcdef123"; token: token:x; AKIA' + "Z" * 16), (8, "0123456789abcdef01234567 api-key=abc\nAPI_KEY:  'abc/+=.-_1'"), (9, "ſecret=abcdefgh secret==abcdef")]
    path = scratch.new_path(spark, "ledger")
    df = docs_of(spark, rows)
    got = secret_scan.secret_report(df, path).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.spans) for r in got) == sorted(((i is None, i or 0), brute_spans(t or "")) for i, t in rows)
    for r in got:
        assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest() and len(r.spans.split(",")) == max(1, r.n_assign + r.n_access + r.n_hex)
    # the second scan meets known blobs only, but for one; a new version of a rule scans all again
    size = lambda: secret_scan.read_ledger(spark, path).count()
    n = size()
    assert n == 3 * len({t or "" for _, t in rows})
    again = secret_scan.scan(docs_of(spark, [*rows, (10, "new token=abcdefgh")]), path).collect()
    assert size() == n + 3 and len(again) == len(rows) + 1 and [len(r.assign) for r in again if r.path == 10] == [1]
    newer = (*secret_scan.RULES[:2], secret_scan.Rule("hex", secret_scan.HEX, 24, version=2))
    secret_scan.scan(df, path, rules=newer).collect()
    assert size() == n + 3 + n // 3
    assert {r.spans for r in secret_scan.secret_report(df, path).collect()} == {r.spans for r in got}


def test_secrets_of_an_empty_table(spark):
    assert secret_scan.secret_report(docs_of(spark, [(1, "x")]).limit(0), scratch.new_path(spark, "ledger")).count() == 0


# --- tokens, planes, packing ---


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet=" \n\t\x1c\x85\xa0'sStTlLé̈ΣσAa12.#<|>endoftx你", max_size=60))
@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_chunked_encoding_is_exact(name, kind, text):
    assert next(tokens.encoder(vocabulary(name), kind).encode([text])) == ids_of(name, text)
    assert tokens.encoder(vocabulary(name), kind, True).one(text) == ids_of(name, text, True)


@lru_cache
def library(name, special_as_text=False):
    """The tokenizer as it comes."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    if special_as_text:
        t.encode_special_tokens = True
    return t


def ids_of(name, text, special_as_text=False):
    return np.asarray(library(name, special_as_text).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


SPECIAL = ["<|endoftext|>", "x\n <|endoftext|> y", "A<|endoftext|>b <|STARTOFTEXT|> <|startoftext|>", "a  b   c\n \nd e \n", " <|endoftext|>\n", "<|end <| endoftext|>"]


@pytest.mark.parametrize("name,kind,end", [("word_bpe_49k.json", "word", 49407), ("byte_bpe_50k.json", "byte", 50256)])
def test_special_tokens_are_those_of_the_library(name, kind, end):
    e = tokens.Encoder(vocabulary(name), kind)
    assert np.frombuffer(e.one(SPECIAL[0]), "<u4").tolist() == [end]
    for t in SPECIAL:
        assert e.one(t) == ids_of(name, t) and tokens.encoder(vocabulary(name), kind, True).one(t) == ids_of(name, t, True)


def test_the_encoder_keeps_a_bounded_table(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 4000)
    e, rng = tokens.Encoder(vocabulary("byte_bpe_50k.json"), "byte"), random.Random(4)
    texts = [" ".join("".join(rng.choice("abcé1\n,") for _ in range(rng.randrange(1, 5))) for _ in range(60)) for _ in range(30)]
    for t in texts:
        assert e.one(t) == ids_of("byte_bpe_50k.json", t)
        assert e.known.held <= 2000 and len(e.known) + len(e.known.older) < 30


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=40), max_size=8), st.sampled_from(["bit", "byte"]))
def test_planes_round_trip(rows, mode):
    sink = io.BytesIO()
    w = token_planes.Writer(sink, mode, block=16)
    for n, ids in enumerate(rows):
        w.add(None if n == 2 else n, np.asarray(ids, "<u4").tobytes())
    assert w.close() == sum(map(len, rows))
    r = token_planes.Reader(io.BytesIO(sink.getvalue()))
    got = [(k, b"".join(parts)) for k, parts in r.documents()]
    assert got == [(None if n == 2 else n, np.asarray(ids, "<u4").tobytes()) for n, ids in enumerate(rows)]
    assert len(r.foot["chunks"]) == -(-sum(map(len, rows)) // 16)


def test_token_planes(spark):
    rng = random.Random(1)
    rows = [*ODD, *[(i, prose(rng, rng.randrange(90))) for i in range(10, 60)], *enumerate(SPECIAL, 70)]
    got = token_planes.token_planes(docs_of(spark, rows), vocabulary("word_bpe_49k.json")).collect()
    ids = {i: [*np.frombuffer(ids_of("word_bpe_49k.json", t or ""), "<u4"), 2] for i, t in rows if i is not None}
    at = sum(r.n_tokens for r in got if r.doc_id is None)
    assert sum(r.doc_id is None for r in got) == 2
    for r in sorted((r for r in got if r.doc_id is not None), key=lambda r: (r.doc_id, r.start)):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), zlib.crc32(np.asarray(ids[r.doc_id], "<u4").tobytes()))
        at += r.n_tokens
    assert token_planes.token_planes(docs_of(spark, ODD).limit(0), vocabulary("word_bpe_49k.json")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=60), st.integers(20, 40))
def test_differencing(sizes, capacity):
    found = packing.windows(sizes, capacity)
    assert sorted(i for w in found for i in w) == list(range(len(sizes)))
    assert max(sum(sizes[i] for i in w) for w in found) <= capacity


def test_differencing_merges_opposing_imbalances():
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.difference([8, 7, 6, 5, 4], 2)) == [14, 16]  # the known result for this input
    assert len(packing.difference([5, 3], 4)) == 2


def test_packing(spark):
    rng = random.Random(2)
    rows = [*ODD, *[(i, prose(rng, rng.randrange(1500))) for i in range(10, 90)], *enumerate(SPECIAL, 100)]
    got = packing.pack(docs_of(spark, rows).coalesce(1), vocabulary("byte_bpe_50k.json"), with_ids=True).collect()
    by, seq = {}, {}
    for r in got:
        by.setdefault((r.doc_id, r.ids_crc32 if r.doc_id in (None, 5) else 0), []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for i, t in rows:
        if i not in (None, 5):
            parts = sorted(by[i, 0], key=lambda r: r.start)
            ids = [*np.frombuffer(ids_of("byte_bpe_50k.json", t or ""), "<u4"), 1]
            assert b"".join(r.ids for r in parts) == np.asarray(ids, "<u4").tobytes() and {r.doc_tokens for r in parts} == {len(ids)}
    for rs in seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sum(r.length for r in got) / (2048 * len(seq)) > 0.98
    assert packing.pack(docs_of(spark, ODD).limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


# --- toxicity ---


def test_toxicity_held_out(spark):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(900):
        bad = i % 9 == 0
        t = prose(rng, 40) + (" " + " ".join(rng.sample(["vile", "nastying", "foulest"], 2)).upper() + "!" if bad else "")
        rows.append((i, t))
        if i % 2:
            marks.append((i, int(bad), "x"))
    df = docs_of(spark, [*rows, *ODD[:5]])
    labels = spark.createDataFrame([*marks, *marks[:3], (None, 1, "x"), (7, None, "x")], "doc_id long, toxic int, text string")
    got = toxicity.toxicity_report(df, labels).collect()
    assert len(got) == 905 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    out = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id > 5]
    assert sum(r.predicted == (r.doc_id % 9 == 0) for r in out) / len(out) > 0.97
    none = toxicity.toxicity_report(df, labels.where("toxic = 0")).agg(F.max("score")).first()[0]
    assert none == 0


def test_nn_pu_separates():
    rng = np.random.default_rng(0)
    p = [np.array([0, *rng.choice(np.arange(1, 30), 5, False)]) for _ in range(200)]
    u = [np.array([0] * (k % 10 == 0) + [*rng.choice(np.arange(1, 30), 5, False)]) for k in range(600)]
    w, b = toxicity.nn_pu(p, u, 30, 0.1)
    assert w[0] + b > 1 and w[0] > 3 * np.abs(w[1:]).max()


# --- WARC ---


def test_archives(spark):
    rows = [(5, "http://a", "p" * 200), (3, "http://b\r\nx: y", "p" * 200), (9, None, "p" * 200), (3, "http://b2", "p" * 200), (7, "u", "short"), (8, "u", "short"), (1, "u", None), (2, "u", ""), (None, "u", "p" * 200), (None, "v", "é" * 90), (11, "big", "ab\r\n\r\n" * 200_000)]
    df = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.archive_round_trip(df).collect()
    least = {}
    for i, _, h in rows:
        if h is not None and len(h.encode()) >= 100 and i is not None:
            least[h] = min(i, least.get(h, i))
    n = Counter(h for _, _, h in rows)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = least[h] if h in least and n[h] > 1 and i != least[h] else None
        want.append((str(i), len(raw), hashlib.sha256(raw).hexdigest(), "response" if to is None else "revisit", str(to)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_reader_verifies():
    raw = warc.write_record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest())
    two = raw + warc.write_record(2, "v", b"", hashlib.sha256(b"").hexdigest())
    assert [r.payload for r in warc.read_records(io.BytesIO(two))] == [b"payload", b""]
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(raw[:-20])))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(warc.write_record(1, "u", b"payload", "0" * 64))))
    plain = zlib.decompress(raw, 31).replace(b"Content-Length: 8", b"Content-Length: 7", 1)
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    bad = z.compress(plain.replace(b"payload\r\n", b"payloaX\r\n")) + z.flush()
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(bad)))


# --- URLs ---


def test_urls(spark):
    canonical = '<head><LINK href="https://a.example.com/en/79" rel="canonical"></head>'
    refresh = "<meta http-equiv='refresh' content='0; url=/en/1'>"
    rows = [
        (1, "http://x.com/en/1", None), (2, "HTTP://A.Example.COM/en/79?q#f", ""), (3, "http://example.net/de/8/", ""), (4, "ftp://s.org/es/", ""), (5, None, ""), (6, "no scheme/en/", ""), (7, "http://xcom/en/", ""),
        (8, "http://mirror.org/page", canonical), (9, "http://x.com/start", refresh), (10, "https://www.x.com/start/#top", ""), (11, "http://other.org/", '<link rel="canonical" href="http://x.com/start">'), (11, "http://other.org/", ""),
        (12, "http://both.org/", '<link rel="canonical" href="http://a.example.com/en/79"><meta http-equiv="refresh" content="5;url=http://x.com/en/1">'), (None, "http://q.com/en/", ""),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, component string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    # 12 joins the classes of an explicit allow and of blocks: allow comes first for pages without a rule
    assert got[1] == ("x.com", "/en/1", "com/en/", "block")
    assert got[2] == ("a.example.com", "/en/79", "example.com/en/7", "allow")
    assert got[3] == ("example.net", "/de/8/", "example.net/de/8", "block") and got[4][2:] == ("org/es/", "block")
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow") and got[7][2:] == (None, "allow")
    assert all(got[k][3] == "allow" for k in (8, 9, 10, 11, 12)) and got[None][3] == "block"
    without = {r.page_id: r.verdict for r in url_filter.judge(df.where("page_id <> 12")).collect()}
    assert (without[8], without[9], without[10], without[11]) == ("allow", "block", "block", "block")
    assert url_filter.judge(df.limit(0)).count() == 0
    more = spark.createDataFrame([("http://xcom/en/", "http://x.com/en/1"), (None, "x")], "from_url string, to_url string")
    assert {r.page_id: r.verdict for r in url_filter.judge(df.where("page_id in (1, 7)"), edges=more).collect()}[7] == "block"


def test_rules_are_those_of_the_contract(spark):
    urls = ["http://x.com/en/1", "http://example.com/en/7", "http://s.net/de/1", "http://net/de/", "http://a.example.net/de/7", "http://example.net/de/81", "http://s.org/es/"]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit(None).cast("string"))).collect()
    want = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
    assert [(r.rule, r.verdict) for r in sorted(got, key=lambda r: r.page_id)] == want


def test_words_met_again_are_not_merged_again():
    for name, kind in (("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")):
        encoder = tokens.Encoder(queries.vocabulary(name), kind)
        asked, merge = [], encoder.tokenize
        encoder.tokenize = lambda w, asked=asked, merge=merge: asked.append(w) or merge(w)
        text = "so thwhon esója, x thwhon. x esója.\nRendly esója!\nRendly thwhon;\nRendly"
        whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert list(np.frombuffer(encoder.one(text), "<u4")) == whole
        assert len([w for w in asked if w.endswith("thwhon")]) == 1 and len([w for w in asked if w.endswith("Rendly") or w.endswith("rendly")]) == 1
        encoder.known.older = dict(encoder.known)
        encoder.known.clear()
        assert list(np.frombuffer(encoder.one(text.replace("x", "thwhon?")), "<u4")) == encoder.tokenizer.encode(text.replace("x", "thwhon?"), add_special_tokens=False).ids
        assert len([w for w in asked if w.endswith("thwhon")]) == 1


def test_relative_targets(spark):
    from urllib.parse import urljoin

    pages = ["http://x.com/a/b/c.html?q=1#f", "http://x.com", "http://x.com/a/b/", "http://x.com/?k"]
    targets = ["index.html", "../en/1", "?p=2", "./", ".", "..", "../..", "../../../en/2", "d/./e/../f?x=../y", "/en/../de/1", "//y.com/1", "http://z.com/2", "#top", "i.html#a/..", "go?u=http://q.com/1"]
    rows = [(p, t) for p in pages for t in targets]
    got = spark.createDataFrame(rows, "url string, target string").select("url", "target", url_filter._absolute(F.col("target"), F.col("url")).alias("found")).collect()
    for r in got:
        want = urljoin(r.url, r.target)
        same = spark.range(1).select(url_filter.plain_form(F.lit(r.found)), url_filter.plain_form(F.lit(want))).first() if r.found != want else (1, 1)
        assert same[0] == same[1], (r, want)
    assert spark.range(1).select(url_filter._absolute(F.lit("mailto:a@b.com"), F.lit(pages[0])), url_filter._absolute(F.lit("index.html"), F.lit("no scheme"))).first()[:] == (None, None)
    meta = "<meta http-equiv='refresh' content='0; url={}'>"
    pages = [(1, "http://x.com/de/start", meta.format("../en/1")), (2, "http://x.com/en", meta.format("en/index.html")), (3, "http://a.example.com/up/in", '<link rel="canonical" href="../en/79">'), (4, "http://x.com/list", meta.format("?p=2")), (5, "http://q.com/from", meta.format("http://x.com/list?p=2")), (6, "http://q.com/r", '<link rel="canonical" href="en/1">')]
    judged = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert judged == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block"}
    rules = (url_filter.UrlRule("q.com", "/en/", False), url_filter.UrlRule("q.com", "/from", False))
    judged = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert judged == {1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "block"}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(300, k) for k in range(301, 340)] + [(None, 1), (7, 7)]
    par = {}

    def find(x):
        par.setdefault(x, x)
        while par[x] != x:
            x = par[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            par[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in par}


# --- decontamination ---


def test_containment(spark):
    rng = random.Random(6)
    items = [(k, prose(rng, n)) for k, n in enumerate((3, 5, 12, 30, 64, 65))] + [(90, None), (91, "!!"), (None, prose(rng, 20))]
    rows = [*ODD]
    for n in range(60):
        _, t = items[n % 6]
        w = t.split()
        cut = w[: max(1, int(len(w) * rng.choice([0.5, 0.7, 0.8, 0.9, 1])))]
        rows.append((100 + n, prose(rng, rng.choice([0, 5, 900])) + " " + " ".join(cut).upper() + ("" if n % 6 == 0 else "!! " + prose(rng, 30))))
    rows += [(200, items[0][1]), (None, items[3][1])]

    def sh(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    want = set()
    for i, t in rows:
        for k, q in items:
            s = sh(q)
            if s and 100 * len(s & sh(t)) >= 75 * len(s):
                want.add((str(i), str(k), len(s), len(s & sh(t))))
    df, bench = docs_of(spark, rows), spark.createDataFrame([(*x, "h") for x in items], "item_id long, text string, hash string")
    got = {(str(r.doc_id), str(r.item_id), r.n_item_shingles, r.n_shared) for r in decontamination.contaminations(df, bench).collect()}
    assert got == want and len(want) > 20
    kept = decontamination.decontaminate(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(i is None or str(i) not in {x[0] for x in want} for i, _ in rows)
    assert decontamination.contaminations(df, bench.limit(0)).count() == 0


# --- personal data ---


def test_surrogates():
    s = pii.Surrogates(b"key")
    text, found = s.rewrite("Mrs. Maria Lopez <Ann.B1@Mail5.example.com>, +1 (017) 555-7713, 4111 1111 1111 1111, 10.0.0.255; (017) 555-7713 ann.b1@mail5.example.com 1234567890123456 v1.2.3.4.5")
    assert [k for k, _, _ in found] == ["person", "email", "phone", "card", "ip", "phone", "email"]
    m = re.fullmatch(r"Mrs\. ([A-Z][a-zü]+) [A-Z][a-zü]+ <([A-Z][a-z]{2}\.[A-Z]\d@[A-Z][a-z]{3}\d\.example\.com)>, \+1 (\(\d{3}\) 555-\d{4}), (\d{4} \d{4} \d{4} \d{4}), (\d+\.\d+\.\d+\.\d+); (.*) (\S+) 1234567890123456 v1\.2\.3\.4\.5", text)
    assert m and m[3] == m[6] and m[2].lower() == m[7] and "Maria" not in text and "7713" not in text
    digits = m[4].replace(" ", "")
    assert pii.luhn(digits[:-1]) == int(digits[-1]) and digits != "4111111111111111"
    assert pii.Surrogates(b"other").rewrite(text)[0] != text
    assert s.rewrite("Clean text, 2024-05-06 12:30, page 3.14.") == ("Clean text, 2024-05-06 12:30, page 3.14.", [])
    assert m[1].lower() in pii.NAMES["latin women"]
    assert [k for k, _, _ in s.entities("Mr. Фёкл Глыбов")] == ["person"] and re.fullmatch("Mr. [А-Я].{2}л [А-Я][а-я]{4}в", s.rewrite("Mr. Фёкл Глыбов")[0])


@pytest.mark.parametrize("title", ["Mr. ", "Frau "])
def test_listed_names_stay_in_their_list(title):
    s = pii.Surrogates(b"key")
    for kind, names in pii.NAMES.items():
        new = [s.rewrite(title + n.capitalize())[0].removeprefix(title) for n in names]
        assert sorted(x.lower() for x in new) == sorted(names) and all(a.lower() != b for a, b in zip(new, names, strict=True)), kind
        assert all(x == x.capitalize() for x in new) and s.rewrite(title + names[0].upper())[0] == title + new[0].upper()
    men, women = (s.rewrite(f"Mr. {n}")[0][4:] for n in ("Петров", "Петрова"))
    assert women == men + "а"


def test_surrogates_of_one_person_agree():
    s = pii.Surrogates(b"key")
    text, found = s.rewrite("Anna Keller met Dr Anna Keller, Dr KELLER and Frau A. Keller's aunt. Later Keller, A. Keller and Anna-Keller left the keller. Mr O'Neil, O'Neil")
    assert [k for k, _, _ in found] == ["person"] * 9
    m = re.fullmatch(r"(\w+) (\w+) met Dr (\w+) (\w+), Dr (\w+) and Frau (\w)\. (\w+)'s aunt\. Later (\w+), (\w)\. (\w+) and (\w+)-(\w+) left the keller\. Mr O'(\w{3}l), O'(\w+)", text)
    assert m and m[1] == m[3] == m[11] != "Anna" and m[2] == m[4] == m[7] == m[8] == m[10] == m[12] != "Keller" and m[5] == m[2].upper()
    assert m[6] == m[9] != "A" and m[13] == m[14] != "Neil"
    assert s.rewrite("Keller alone") == ("Keller alone", [])


def test_telephone_groupings():
    s = pii.Surrogates(b"key")
    for t in ("+49 30 1234567", "+33 1 23 45 67 89", "+34 912 345 678", "+491701234567", "+49 (0)30 1234567", "0049 30 1234567", "030 1234567", "(030) 1234567", "030/1234567", "01 23 45 67 89", "01.23.45.67.89", "+1 (017) 555-7713"):
        new, found = s.rewrite(f"call {t}, now")
        assert [x[0] for x in found] == ["phone"] and found[0][1:] == (5, 5 + len(t)), t
        assert t not in new and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", f"call {t}, now")
    same = [re.sub(r"\D", "", s.rewrite(t)[0])[-9:] for t in ("+49 30 1234567", "+49 (0)30 1234567", "0049 30 1234567", "030 1234567", "+49301234567")]
    assert len(set(same)) == 1 and same[0] != "301234567"
    for t in ("01-02-2024 10 11 12", "01.02.2024", "2024-05-06 12:30", "0.123456789", "1 + 2", "0123456789", "a +12345"):
        assert s.rewrite(t) == (t, []), t
    assert [x[0] for x in s.entities("012-34-5678")] == ["ssn"]


@settings(max_examples=25, deadline=None)
@given(st.integers(2, 400), st.binary(min_size=1, max_size=8))
def test_permutation_moves_everything(n, key):
    p = pii.Permutation(hashlib.blake2b(key).digest()[:32])
    got = [p.move(i, n, "t") for i in range(n)]
    assert sorted(got) == list(range(n)) and all(a != b for a, b in enumerate(got))


def test_pseudonymise(spark):
    rows = [*ODD, *[(100 + i, f"call (017) 555-{i:04d} or mail u{i % 7}@x{i}.com") for i in range(60)], (99, "call (017) 555-0001")]
    df = docs_of(spark, rows)
    out = pii.pseudonymise(df, b"k")
    assert out.columns == [*df.columns, "pii"]
    got = {r.doc_id: r for r in out.where("doc_id >= 99").collect()}
    assert len({r.text for r in got.values()}) == 61 and all(r.n_chars == len(r.text) for r in got.values())
    assert got[99].text in got[101].text
    same = {(str(r.doc_id), r.text, r.n_chars) for r in out.where("doc_id < 99 or doc_id is null").collect()}
    assert same == {(str(i), t, None if t is None else len(t)) for i, t in ODD}
    # surrogates that met would be given another key
    plain = pii.Surrogates(b"k")
    a = plain.one_spelling("phone", "(017) 555-0001")
    again = pii.Surrogates(b"k", {("phone", plain.hashed("phone", a)): 1})
    assert again.of_entity("phone", a) != plain.of_entity("phone", a)
    assert pii.collisions(df, b"k", {}) == []
    report = pii.surrogate_report(df, b"k").where("doc_id = 100").first()
    assert (report.n_entities, report.n_phone, report.n_email) == (2, 1, 1)


# --- near duplicates ---


def jaccard_components(rows):
    sets = {}
    upper = {c: c + 32 for c in range(65, 91)}
    for i, t in rows:
        w = WORD.findall((t or "").translate(upper))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    par = {i: i for i in sets}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
                x, y = find(a), find(b)
                par[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark):
    rng = random.Random(7)
    rows, n = [(1, None), (2, ""), (3, " \n"), (4, "x"), (5, "X"), (6, "x y"), (7, "İ K"), (8, "long " * 20_000)], 10
    for _ in range(12):
        t = prose(rng, rng.choice([6, 30, 120, 400])).split()
        for _ in range(rng.choice([1, 4, 12])):
            rows.append((n, " ".join(t)))
            n += 1
            t = list(t)
            for _ in range(rng.choice([0, 1, 3])):
                t[rng.randrange(len(t))] = f"w{rng.randrange(10**6)}"  # a chain of changes: far ends are not similar
    got = near_dup.near_duplicates(docs_of(spark, [*rows, (None, "x"), (None, None)])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == jaccard_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    again = near_dup.near_duplicates(docs_of(spark, [(1, "a b"), (1, "a b"), (0, "a b")])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in again) == [(0, 0, True), (1, 0, False), (1, 0, False)]
    assert near_dup.near_duplicates(docs_of(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("large,rare", [(2, 2), (2, 16), (5, 4)])
def test_near_duplicates_in_large_groups(spark, monkeypatch, large, rare):
    monkeypatch.setattr(near_dup, "LARGE", large)
    monkeypatch.setattr(near_dup, "RARE", rare)
    rng = random.Random(11)
    base = prose(rng, 120).split()
    rows = [(0, " ".join(base))]
    for n in range(1, 90):
        t = list(base)
        for _ in range(rng.randrange(9)):
            t[rng.randrange(len(t))] = f"w{rng.randrange(3)}"  # changes that several texts share
        rows.append((n, " ".join(t[: rng.randrange(90, 121)])))
    got = near_dup.near_duplicates(docs_of(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_components(rows)


@pytest.mark.parametrize("seed,large", [(8, 23), (20, 30)])
def test_near_duplicates_in_and_outside_large_groups(spark, monkeypatch, seed, large):
    monkeypatch.setattr(near_dup, "LARGE", large)
    monkeypatch.setattr(near_dup, "RARE", large)
    rng, rows = random.Random(seed), []
    for i in range(53):  # related texts, of which some are in a group over LARGE; links are among the last three
        t = [f"b{k}" for k in range(160)]
        for p in rng.sample(range(160), 4 if i < 50 else 2):
            t[p] = f"f{i}x{p}"
        rows.append((i, " ".join(t)))
    got = near_dup.near_duplicates(docs_of(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_components(rows)


def test_dropping_spares_other_texts_of_an_id(spark):
    import corpus_pipeline

    docs = docs_of(spark, [(3, "b " * 9), (5, "the only a"), (5, "b " * 9), (5, None), (6, "b " * 9), (None, "b " * 9)])
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == [("3", "b " * 9), ("5", "None"), ("5", "the only a"), ("None", "b " * 9)]


def test_near_duplicates_across_a_large_group_at_the_defaults(spark):
    """One end of the only link is in a large group, the other in small ones alone."""
    def family(seed):
        rng = random.Random(seed)
        base = [f"b{k}" for k in range(1000)]
        def away(t, n, tag):
            t = list(t)
            for k, p in enumerate(rng.sample(range(len(t)), n)):
                t[p] = f"{tag}{k}"
            return t
        x = away(base, 0, "x")
        y = away(x, 23, "y")
        rows = [(900, " ".join(x)), (901, " ".join(y))]
        rows += [(n, " ".join(away(y, 34, f"u{n}w"))) for n in range(60)]
        rows += [(1000 + n, " ".join(away(x, 34, f"v{n}w"))) for n in range(80)]
        return rows

    for seed in (1,):
        rows = family(seed)
        got = near_dup.near_duplicates(docs_of(spark, rows)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_components(rows)


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(1)
    a = near_dup.mix(rng.integers(1, 2**62, 900, dtype=np.uint64))
    for same in (0, 300, 600, 800):
        b = np.concatenate([a[:same], near_dup.mix(rng.integers(1, 2**62, 900 - same, dtype=np.uint64))])
        e = near_dup.estimate(near_dup.compress(near_dup.minima(a)), near_dup.compress(near_dup.minima(b)), 900, 900)
        assert abs(e - same / (1800 - same)) < 0.12


# --- quality ---


def test_statistics(spark):
    rng = random.Random(8)
    rows = [*ODD, *[(10 + i, "\n".join(rng.choice(["a b c", "a b c d", "", " ", "* # x!", "é é é é"]) for _ in range(rng.randrange(14)))) for i in range(40)]]
    got = {(r.doc_id, r.word_chars): r for r in quality_rules.statistics(docs_of(spark, rows)).collect()}
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        count = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if count[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i, sum(map(len, w))]
        assert (r.n_words, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_decision_list(spark):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = [f"w{rng.randrange(10**6)}" + ("###" if bad else "") for _ in range(70)]
        rows.append((i, " ".join(w)))
        if i % 2 or i % 5 == 0:
            marks.append((i, 0 if bad else 1, "t"))
    labels = spark.createDataFrame([*marks, (None, 0, "t"), (1, None, "t")], "doc_id long, quality int, text string")
    got = quality_rules.quality_report(docs_of(spark, [*rows, *ODD]), labels).collect()
    assert all(r.kept == (r.doc_id % 5 != 0) for r in got if r.doc_id is not None and r.n_words == 70)
    assert all(r.base_failed and not r.kept for r in got if r.n_words != 70)
    stats = quality_rules.statistics(docs_of(spark, rows))
    assert quality_rules.fit(stats, labels.where("quality = 1")) == [] and stats.select(quality_rules.expression([]).alias("k")).distinct().collect()[0].k
    assert quality_rules.fit(stats.limit(0), labels) == []


# --- whole tables against SQL ---


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = ", ".join(got.columns)
    want = con.execute(f"select {columns} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and want


def test_secrets_equal_sql_on_odd_texts(spark):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    rows = [(1, None), (2, ""), (7, 'é PASSWORD = "abcdef123"; token: token:x; AKIA' + "Z" * 16), (8, "0123456789abcdef01234567 api-key=abc\nAPI_KEY:  'abc/+=.-_1'"), (9, "ſecret=abcdefgh secret==abcdef tOKEN=x token=abcdefg"), (9, "x")]
    con.executemany("insert into documents values (?, ?)", rows)
    got = secret_scan.secret_report(docs_of(spark, rows), scratch.new_path(spark, "ledger"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, con.execute(f"select {', '.join(got.columns)} from ({secret_scan.report_sql()})").fetchall()))


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_urls_equal_sql_on_random_links(spark, seed):
    rng = random.Random(seed)
    hosts, paths = ["x.com", "www.x.com", "a.example.com", "q.org", "s.net"], ["/en/1", "/en/79", "/de/", "/de/8", "/es/", "/", "", "/a/b.html?x=1&amp;y=2", "/a/b.html?y=2&x=1#f"]
    url = lambda: f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}"
    target = lambda: rng.choice([url(), "../en/1", "?p=2", "b.html", "/es/", "//q.org/es/", "mailto:a@b", "./x/.."])
    tag = lambda: rng.choice(['<link rel="canonical" href="{}">', "<LINK href={} REL=canonical>", "<link rel='alternate' href='{}'>", '<meta http-equiv="refresh" content="0.5; url={}">', "<meta content='3;URL={}' http-equiv=Refresh>", '<!-- <link rel="canonical" href="{}"> -->', '<a href="{}">refresh</a>']).format(target())
    rows = [(n, url().replace("&amp;", "&"), rng.choice([None, "", tag(), tag() + "x" + tag()])) for n in range(80)]
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, con.execute(f"select {', '.join(got.columns)} from ({url_filter.judge_sql()})").fetchall()))


def test_targets_of_pages(spark):
    html = '<!-- <link rel=canonical href=/no> --><link rel="x canonical" href="/a?b=1&amp;c=&#39;2"><META HTTP-EQUIV=refresh CONTENT="1.5;URL=\'/b\'"><meta name=refresh content="0;url=/no"><link rel=canonical href="/c"><!-- open <link rel=canonical href=/no>'
    assert spark.range(1).select(url_filter.targets(F.lit(html))).first()[0] == ["/a?b=1&c='2", "/b", "/c"]
    assert spark.range(1).select(url_filter.targets(F.lit("<link " * 50_000 + "canonical"))).first()[0] == []


# --- samples ---


def test_least_by_hash(spark):
    rows = scratch.materialize(spark.range(5000).toDF("doc_id"), "rows")
    want = [r.doc_id for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(300).collect()]
    assert [r.doc_id for r in scratch.least_by_hash(rows, "doc_id", 300).collect()] == want
    same = scratch.materialize(spark.range(5000).select(F.lit(7).cast("long").alias("doc_id")), "rows")
    assert scratch.least_by_hash(same, "doc_id", 300).count() == 300 and scratch.least_by_hash(rows, "doc_id", 9000).count() == 5000


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    class Session:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            @staticmethod
            def get(*_):
                return ""

    assert scratch.shared_dir(spark)
    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session)


# --- pipeline ---


CLASHES = "doc_id long, text string, n_chars long, toxic_score string, toxic_predicted string, pii string, new string, class_key string, _pii string, hash string, node string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, 0, "ts", "tp", "mine", "n", "ck", "p", "h", "nd") for i, t in rows], CLASHES)


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, no rows, and columns with names that operators use."""
    import corpus_pipeline

    rng = random.Random(12)
    long = prose(rng, 60_000)
    rows = [(1, None), (2, ""), (None, None), (None, "no id (017) 555-7713"), (3, "same text"), (3, "same text"), (3, "another text of that id"), (4, long), (5, long + " more"), (6, "Mr. Anna Glyb 4111 1111 1111 1111")]
    spark.createDataFrame([(3, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "some passage that nothing here has in it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = clashing(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = scratch.materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == clashing(spark, []).columns
        for r in docs.collect():
            assert (r.toxic_score, r.toxic_predicted, r.pii, r.new, r.class_key, r._pii, r.hash, r.node) == ("ts", "tp", "mine", "n", "ck", "p", "h", "nd")
    texts = sorted((str(r.doc_id), str(r.text)[:20]) for r in docs.collect())
    assert [i for i, _ in texts] == ["1", "2", "3", "3", "3", "4", "6", "None", "None"] and all("7713" not in t and "4111" not in t for _, t in texts)
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == {1, 2, 3, 4, 6, None}
    empty = clashing(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0, name


def test_operators_on_empty_tables(spark):
    none = clashing(spark, [])
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, toxic int, quality int")
    assert toxicity.toxicity_report(none, labels).count() == 0 and toxicity.toxicity_report(none, labels.limit(0)).count() == 0
    assert pii.surrogate_report(none, b"k").count() == 0
    assert quality_rules.quality_report(none, labels).count() == 0
    assert decontamination.contaminations(none, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        pii.pseudonymise(none, b"k")




def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(10)
    rows = [(i, prose(rng, 80) + f" id{i}" + (" vile foulest" if i % 9 == 0 else "")) for i in range(400)]
    passage = prose(rng, 40)
    rows += [(500, rows[1][1]), (501, rows[2][1] + " more"), (502, prose(rng, 300) + " " + passage), (503, prose(rng, 60) + " call (017) 555-7713")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got, now = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        now = scratch.materialize(stage(spark, now, str(tmp_path)), name)
        got.append(now)
    assert all(x.columns == docs.columns for x in got[:4])
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in got[:4]]
    assert not {i for i in ids[0] if i < 400 and i % 9 == 0} and len(ids[0]) == 404 - 45
    assert ids[0] - ids[1] == {500, 501} and ids[1] - ids[2] == {502} and ids[3] == ids[2]
    assert "7713" not in got[3].where("doc_id = 503").first().text
    assert {r.doc_id for r in now.select("doc_id").collect()} == ids[3]
    assert struct.calcsize("<I") == 4
