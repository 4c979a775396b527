"""The ten operators: awkward inputs, brute force, round trips and held-out accuracy."""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from oracle import expected, rows
from pyspark.sql import functions as F

from corpusmill.llm import chat, decontam, html_extract, jaccard_join, mixing, perplexity, pii_crf, quality_rules, sharding, warc
from corpusmill.llm.common import Workspace
from corpusmill.llm.queries import QUERIES, SQL
from corpusmill.llm.tokens import word_hash, words

SF = "/root/testdata/sf0.001"


def split(text: str) -> list[str]:
    return [w for w in re.split(r"[^0-9a-z\x80-\U0010ffff]+", text.lower()) if w]


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    assert rows(QUERIES[name](spark, SF)) == expected(SQL[name], SF)


def test_tokens():
    texts = ["Hello, wörld! a1", None, "", "  ", "x" * 100 + " y"]
    found = [h[at[i] : at[i + 1]].tolist() for a, b, h, at in words(pa.array(texts)) for i in range(b - a)]
    assert found == [[word_hash(w) for w in split(t or "")] for t in texts]


# ---- 3 sharding


def slow_jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump():
    keys = np.random.default_rng(0).integers(0, 2**60, 3000)
    before, after = sharding.jump(keys, 64), sharding.jump(keys, 72)
    assert before.tolist() == [slow_jump(int(k), 64) for k in keys]
    moved = before != after
    assert abs(moved.mean() - 8 / 72) < 0.03 and (after[moved] >= 64).all()
    assert np.bincount(before, minlength=64).max() < 2 * 3000 / 64
    assert sharding.jump(keys, 1).max() == 0 and len(sharding.jump(keys[:0], 8)) == 0


def test_sharding_awkward(spark, awkward, nothing):
    got = sharding.assign_shards(awkward)
    assert got.columns == awkward.columns and got.count() == 12
    by = defaultdict(set)
    for r in got.collect():
        by[r.doc_id].add(r.shard)
    assert all(len(s) == 1 and 0 <= min(s) < 64 for s in by.values())
    assert sharding.assign_shards(nothing).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(nothing, shards=0)


# ---- 6 mixing


def test_mixing_awkward(spark, awkward, nothing):
    got = mixing.mix(awkward)
    assert set(got.columns) == set(awkward.columns)
    n = Counter(r.doc_id for r in got.collect())
    assert {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None} == set(n) and n[1] % 2 == 0
    assert mixing.mix(nothing).count() == 0 and mixing.source_rates(nothing).count() == 0


def test_mixing_reaches_weights(spark):
    rows = [(i, "w " * 10, "en", "big" if i % 4 else "small", 20) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix(docs, weights={"big": 1, "small": 1}, total=40_000)
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["big"] - 2000) < 120 and abs(n["small"] - 2000) < 120
    small = got.where("source = 'small'").groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert small == 2
    assert mixing.mix(docs, weights={"big": 1}).select("source").distinct().count() == 1
    assert rows_of(mixing.mix(docs)) == rows_of(mixing.mix(docs.repartition(7)))


def rows_of(df):
    return sorted((r.doc_id, r.copy) for r in df.select("doc_id", "copy").collect())


# ---- 9 WARC


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/b", "<p>é</p>" * 3), (2, None, ""), (3, "u", None), (4, "u\r\nx", "y" * 2_000_000), (1, "http://a/b", "<p>é</p>" * 3), (None, "n", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    warc.write_warc(df, f"file://{tmp_path}/w")
    got = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    back = sorted(((r.headers.get("x-row-id"), r.uri, None if r.type == "metadata" else bytes(r.payload).decode()) for r in got), key=repr)
    assert back == sorted(((None if i is None else str(i), u if u is None else u.replace("\r\n", "%0D%0A"), h) for i, u, h in rows), key=repr)
    assert all(r.digest_ok and r.error is None for r in got)


def test_warc_broken():
    one = warc.record_bytes(b"abc", "u", record_id="<r>")
    two = warc.record_bytes(b"def" * 1000, "v", record_id="<s>")
    assert [r["payload"] for r in warc.records_of(one + two)] == [b"abc", b"def" * 1000]
    assert warc.records_of(b"") == []
    cut = warc.records_of(one + two[:-20])
    assert cut[0]["payload"] == b"abc" and cut[-1]["error"]
    plain = gzip.decompress(one) + gzip.decompress(two)
    assert [r["payload"] for r in warc.records_of(plain)] == [b"abc", b"def" * 1000]
    bad = gzip.compress(gzip.decompress(one).replace(b"abc", b"abd"))
    assert warc.records_of(bad)[0]["digest_ok"] is False
    assert warc.records_of(b"garbage\r\n\r\n")[0]["error"] and warc.records_of(b"\x1f\x8bxx")[0]["error"]

    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(1)

    assert len(list(warc.read_records(Slow(one + two)))) == 2


def test_warc_goes_on_after_bad_records(spark, tmp_path):
    r = random.Random(5)
    many = [warc.record_bytes(f"page {i} ".encode() + r.randbytes(3000), f"u{i}", record_id=f"<{i}>") for i in range(8)]
    # inside a member that looks like one
    many[3] = warc.record_bytes(b"x" + b"\x1f\x8b\x08" * 3 + r.randbytes(500), "u3", record_id="<3>")

    def flipped(m, at):
        return m[:at] + bytes([m[at] ^ 0xFF]) + m[at + 1 :]

    def relength(m, to):
        return gzip.compress(re.sub(rb"Content-Length: \d+", b"Content-Length: %d" % to, gzip.decompress(m)))

    undigested = gzip.compress(re.sub(rb"WARC-Block-Digest: .*\r\n", b"", gzip.decompress(many[2])))
    cases = {
        "header": flipped(many[2], 0), "checksum": flipped(many[2], -6 % len(many[2])), "cut": many[2][:-900], "no record": gzip.compress(b"garbage " * 9),
        "long": relength(many[2], 7000), "long, no digest": relength(undigested, 7000), "no length": gzip.compress(gzip.decompress(many[2]).replace(b"Content-Length", b"Content-Longth")),
    }
    for name, bad in cases.items():
        got = warc.records_of(b"".join([*many[:2], bad, *many[3:5], bad, *many[6:]]))
        sound = [x["headers"]["warc-record-id"] for x in got if x["digest_ok"]]
        assert [x for x in sound if x not in ("<2>", "<5>")] == ["<0>", "<1>", "<3>", "<4>", "<6>", "<7>"], name
        assert sum(x["error"] is not None for x in got) == 2 and [x["record"] for x in got] == list(range(len(got))), name
    (tmp_path / "a.warc.gz").write_bytes(b"".join([*many[:2], cases["cut"], *many[3:]]))
    got = warc.read_warc(spark, f"file://{tmp_path}").collect()
    assert [x.uri for x in got if x.error is None] == ["u0", "u1", "u3", "u4", "u5", "u6", "u7"] and sum(x.error is not None for x in got) == 1
    # a record in two members
    whole = gzip.decompress(undigested)
    assert [x["error"] for x in warc.records_of(gzip.compress(whole[:600]) + gzip.compress(whole[600:]) + many[4])] == [None, None]


def test_warc_digests():
    """Each digest over its own bytes."""
    import base64
    import hashlib

    def sha(data):
        return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()

    body, chunked = b"<p>hello</p>", b"5\r\n<p>he\r\n7;x=1\r\nllo</p>\r\n0\r\n\r\n"
    http, more = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked

    def record(block, kind="response", content="application/http; msgtype=response", **digests):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", f"Content-Type: {content}", *(f"WARC-{k.rstrip('_').title()}-Digest: {v}" for k, v in digests.items()), f"Content-Length: {len(block)}", "", ""]
        return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n")

    cases = [
        (record(http, payload=sha(body)), True), (record(http, payload=sha(http)), False), (record(http, payload=sha(body), block_=sha(http)), True), (record(http, payload=sha(body), block_=sha(body)), False),
        (record(http, block_=sha(http), payload=sha(b"")), False), (record(more, payload=sha(body)), True), (record(more, payload=sha(chunked)), True), (record(b"HTTP/1.1 304\r\n\r\n", "revisit", payload=sha(body)), None),
        (record(body, "resource", "text/html", payload=sha(body)), True), (record(http), None), (record(b"HTTP/1.1 200", payload=sha(b"")), True),
    ]
    found = warc.records_of(b"".join(c for c, _ in cases))
    assert [r["error"] for r in found] == [None] * len(cases) and [r["digest_ok"] for r in found] == [ok for _, ok in cases]


def test_warc_clashing_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (2, "v", "")], "page_id long, url string, html string").selectExpr("*", "'z' AS n", "'z' AS id", "'z' AS payload")
    warc.write_warc(df, f"file://{tmp_path}/c")
    assert sorted((r.headers["x-row-id"], bytes(r.payload)) for r in warc.read_warc(spark, f"file://{tmp_path}/c").collect()) == [("1", b"a"), ("1", b"a"), ("2", b"")]


def test_warc_empty(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e")
    assert warc.read_warc(spark, f"file://{tmp_path}/e").count() == 0


# ---- 10 HTML


def test_best_region_is_best():
    r = random.Random(5)
    for _ in range(300):
        s = [r.choice([-3.0, -1.0, 0.5, 1.0, 2.0]) for _ in range(r.randrange(0, 14))]
        a, b = html_extract.best_region(s)
        best = max([0.0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])
        assert math.isclose(sum(s[a:b]), best)


def test_html_held_out():
    pages = [r[0] for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()]
    w = html_extract.learn(pages[:150])
    assert w[""] > 0 and all(v < 0 for k, v in w.items() if k)
    f = []
    for p in pages[150:]:
        parts = html_extract.stretches(p)
        f.append(html_extract.region_f1(parts, html_extract.best_region(html_extract.score(parts, w)), html_extract.label(parts)))
    assert sum(f) / len(f) > 0.95


def slow_stretches(html):
    """One regex match after the other from each '<', as the grammar says."""
    out, at, text = [], 0, ""
    while at < len(html):
        m = html_extract._TAG.match(html, at) if html[at] == "<" else None
        if m is None:
            text, at = text + html[at], at + 1
            continue
        out += [("", text)] if text and not text.isspace() else []
        name = (m[1] or m[2] or "!--").lower()
        out.append(("/" + name if m[0].startswith("</") else name, ""))
        text, at = "", m.end()
    return out + ([("", text)] if text and not text.isspace() else [])


def slow_extract(html, weights):
    """Content by trying all regions of single words and tags."""
    units = []
    for k, t in slow_stretches(html):
        units += [(k, "", 0.0 if k.strip("/") in ("article", "main") else weights.get(k.strip("/"), weights["?"]))] if k else [("", w, weights[""]) for w in t.split()]
    sums = [0.0, *itertools.accumulate(u[2] for u in units)]
    best, found = 1e-9, (0, 0)
    for i in range(len(units)):
        for j in range(i + 1, len(units) + 1):
            if sums[j] - sums[i] > best + 1e-9:
                best, found = sums[j] - sums[i], (i, j)
    return [html_extract._html.unescape(u[1]) for u in units[found[0] : found[1]] if u[0] == ""]


def test_html_brute_force():
    """Tokens, region and text against trying everything, on pages made of awkward pieces."""
    r = random.Random(12)
    some = ["<p>", "</p>", "<div class='x'>", "</div>", "word", "two words", " &amp; ", "<!-- c -->", "<!--", "<script>x</script>", "<script>", "<a ", "<", ">", "<1", "<style>", "</style>", "<unknown>", "<br/>", "<!doctype html>", "\n", "<main>", "<!-->"]
    weights = {"": 0.7, "?": -1.0, "p": -0.3, "div": -0.9, "a": -0.8, "!--": -0.2, "script": -1.5, "br": -0.1}
    for _ in range(400):
        page = " ".join(r.choice(some) for _ in range(r.randrange(0, 25)))
        assert html_extract.stretches(page) == slow_stretches(page), page
        text, n = html_extract.extract(page, weights)
        assert text.split() == [w for x in slow_extract(page, weights) for w in x.split()] and n == len(text.split()), page


def test_html_weights_brute_force():
    """Learned weights from counting tags and words inside and outside, page by page."""
    r = random.Random(13)
    pages = [f"<nav><a>menu {i}</a><a>x</a></nav><main><p>{'word ' * r.randrange(5, 30)}</p><p>more</p></main><div>foot <a>z</a></div>" for i in range(12)] + ["<p>no label</p>", "<main>a</main><main>b</main>", ""]
    got = html_extract.learn(pages)
    inside, outside = Counter(), Counter()
    for p in pages[:12]:
        before, _, rest = p.partition("<main>")
        content, _, after = rest.partition("</main>")
        for part, into in ((content, inside), (before + after, outside)):
            into.update(re.findall(r"</?(\w+)", part))
            into[""] += len(re.sub(r"<[^>]*>", " ", part).split())
    names = {x for x in inside | outside if x}
    a, b = sum(inside.values()) + len(names), sum(outside.values()) + len(names)
    for x in names:
        assert math.isclose(got[x], min(-0.01, math.log((inside[x] + 1) / a) - math.log((outside[x] + 1) / b)))


def test_html_long_input_is_linear():
    import time

    for page in ("<a " * 350_000, "<a " * 300_000 + ">", "<!--" * 250_000, "<script " * 120_000, "</script " * 100_000, "<p>" * 300_000, "<" * 1_000_000, "<!x" * 300_000):
        t = time.process_time()
        html_extract.extract(page, {"": 0.2, "?": -1.0})
        assert time.process_time() - t < 8


def test_html_awkward(spark):
    rows = [(1, None), (2, ""), (3, "plain words here"), (4, "<p>a &amp; b"), (5, "<script>x"), (None, "<b>t</b>"), (6, "<article>" + "<p>word word</p>" * 50_000 + "</article>"), (3, "plain words here")]
    df = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'z' AS text", "'z' AS n_words")
    got = sorted(((r.page_id, r.text, r.n_words) for r in html_extract.extract_content(df).collect()), key=repr)
    by = {g[0]: g[1:] for g in got}
    assert by[1] == (None, 0) and by[2] == ("", 0) and by[3] == ("plain words here", 3) and by[5] == ("", 0) and by[6][1] == 100_000 and len(got) == 8
    assert html_extract.extract_content(df.limit(0)).count() == 0
    assert html_extract.extract("<p>a &amp; b", {"": 1.0, "?": -1.0}) == ("a & b", 3)


# ---- 5 chat


def test_chat_layouts(spark):
    turns = [("system", "s"), ("user", "q"), ("assistant", "a")]
    cases = {
        '{"messages":[{"role":"system","content":"s"},{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}': turns,
        '{"id":"7","conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}],"system":"s"}': turns,
        '{"dialogue":{"turns":[{"speaker":" Human ","utterance":"q"},{"speaker":"BOT","utterance":"a"}]}}': turns[1:],
        '{"messages":[{"role":"user","content":[{"text":"q","type":"text"}]}]}': turns[1:2],
        '{"system":"s","history":[["q","a"]],"query":"q","response":"a"}': [*turns, *turns[1:]],
        '{"instruction":"q","input":"more","output":"a"}': [("user", "q\nmore"), ("assistant", "a")],
        '{"instruction":"q","input":"","output":"a"}': turns[1:],
        '{"prompt":"q","completion":"a"}': turns[1:],
        '{"question":"q","answer":"a","system":"s"}': turns,
        '{"messages":[]}': [],
        '{"messages":[{"role":null,"content":"q"},{"role":"narrator","content":""},{"role":"user","content":null}]}': [("unknown", "q"), ("narrator", "")],
        '{"other":1}': None, "no json": None, "": None, None: None,
    }
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "id int, raw string").selectExpr("*", "'z' AS turns", "'z' AS layout")
    got = {r.id: r for r in chat.canonical(df).collect()}
    for i, want in enumerate(cases.values()):
        turns_ = got[i].turns
        assert (None if turns_ is None else [tuple(t) for t in turns_]) == want, i
    assert got[11].layout is None and got[11].fingerprint is not None and got[12].fingerprint is None
    assert got[5].fingerprint == got[6].fingerprint != got[7].fingerprint
    assert chat.canonical(df.limit(0)).count() == 0


def test_chat_awkward_tables(spark):
    rows = [(1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, None, "x"), (2, None, "assistant", None), (None, 3, "user", ""), (3, 1, "tool", "t" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.canonical(chat.as_collected(df))
    n = {r.conv_id: r.turns for r in got.collect()}
    assert [tuple(t) for t in n[1]] == [("user", "q"), ("user", "q"), ("unknown", "x")] and n[2] == [] and n[None][0].text == "" and len(n[3][0].text) == 100_000
    with pytest.raises(ValueError):
        chat.mappings(spark, [*chat.LAYOUTS, chat.Layout("twin", {"prompt": "x", "completion": "x"}, "struct<prompt:string>", "array()")])


# ---- 1 decontamination


def slow_leaks(docs, items):
    toks = {i: split(t) for i, t in items if t is not None}
    toks = {i: t for i, t in toks.items() if t}
    df = Counter(w for t in toks.values() for w in set(t))
    n, mean, half = len(toks), sum(map(len, toks.values())) / len(toks), max(3, *(len(t) for t in toks.values()))
    share = {}
    for i, t in toks.items():
        raw = {w: round(10_000 * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(t) / mean))) for w, c in Counter(t).items()}
        share[i] = {w: v * 1_000_000 // max(1, sum(raw.values())) for w, v in raw.items()}

    def grams(t):
        m = min(3, len(t))
        return {tuple(t[k : k + m]) for k in range(len(t) - m + 1)} if t else set()

    out = {}
    for d, text in docs:
        w = split(text or "")
        for s in range(max(1, -(-len(w) // half) - 1)):
            p = w[s * half : (s + 2) * half]
            own, g = set(p), grams(p)
            for i, t in toks.items():
                score = sum(v for x, v in share[i].items() if x in own)
                q, a = grams(t[: (len(t) + 1) // 2]), grams(t[(len(t) + 1) // 2 :])
                if score >= 600_000 and len(q & g) >= 0.6 * len(q) and len(a & g) >= 0.6 * len(a):
                    out[d, i] = max(out.get((d, i), 0), score)
    return out


def test_decontamination_brute_force(spark, prose_of):
    r = random.Random(9)
    items = [(i, prose_of(r.randrange(8, 40), 100 + i)) for i in range(60)] + [(90, None), (91, ""), (92, "one"), (93, prose_of(20, 100))]
    docs = []
    for d in range(80):
        body = prose_of(r.randrange(0, 300), 500 + d).split()
        for _ in range(r.randrange(0, 3)):
            t = r.choice(items[:60])[1].split()
            t = [w if r.random() > 0.1 else "changed" for w in t]
            at = r.randrange(0, len(body) + 1)
            body[at:at] = t
        docs.append((d, " ".join(body)))
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    want = slow_leaks(docs, items)
    assert {(x.doc_id, x.item_id): x.score for x in got.collect()} == want and len(want) > 20


def test_wand_is_exhaustive(monkeypatch):
    """Every item of random indexes that reaches the threshold is found with its score, and most postings are skipped."""
    r = np.random.default_rng(8)
    monkeypatch.setattr(decontam, "CELLS", 64)
    for vocabulary, n in ((30, 7), (200, 60), (3000, 400)):
        words_ = r.integers(1, 2**62, vocabulary).astype(np.uint64)
        hashes = [words_[(r.random(r.integers(0, 40)) ** 2 * vocabulary).astype(int)] for _ in range(n)]
        stats = decontam.Statistics.empty()
        stats.add(hashes[: n // 2])
        stats.add(hashes[n // 2 :])
        index = decontam.build(list(range(n)), hashes, stats)
        queries = [np.unique(np.concatenate([hashes[r.integers(n)], hashes[r.integers(n)], words_[r.integers(0, vocabulary, 10)]])) for _ in range(40)]
        rows = [np.flatnonzero(np.isin(index.terms, q)) for q in queries]
        width = max(map(len, rows))
        there = np.array([[i < len(x) for i in range(width)] for x in rows])
        terms = np.array([[*x, *[0] * (width - len(x))] for x in rows])
        for need in (100_000, 600_000):
            want = {}
            for q, x in enumerate(rows):
                score = np.zeros(n, np.int64)
                for t in x:
                    score[index.items[index.bounds[t] : index.bounds[t + 1]]] += index.impacts[index.bounds[t] : index.bounds[t + 1]]
                want |= {(q, i): int(s) for i, s in enumerate(score) if s >= need}
            found = [(int(q), int(i), int(s)) for qs, is_, ss in decontam.wand(index, terms, there, need) for q, i, s in zip(qs, is_, ss, strict=True)]
            assert len(found) == len(want) and {(q, i): s for q, i, s in found} == want


def test_decontamination_awkward(spark, awkward, nothing, prose_of, monkeypatch):
    items = spark.createDataFrame([(1, prose_of(60, 2)), (2, None), (3, ""), (None, prose_of(50, 4))], "item_id long, text string")
    pairs = {(r.doc_id, r.item_id) for r in decontam.contaminated(awkward, items).collect()}
    assert pairs == {(1, 1), (2, 1), (8, None)}
    monkeypatch.setattr(decontam, "SHARD_ITEMS", 1)
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(awkward, items).collect()} == pairs
    kept = decontam.decontaminate(awkward, items)
    assert kept.columns == awkward.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted("3 4 None 5 6 7 9 10".split())
    assert decontam.contaminated(nothing, items).count() == 0 and decontam.contaminated(awkward, items.limit(0)).count() == 0


# ---- 4 Jaccard


def trigrams(t):
    w = split(t or "")
    n = min(3, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def slow_pairs(docs, threshold=0.5):
    sets = defaultdict(set)
    for d, t in docs:
        if d is not None and (s := trigrams(t)):
            sets[d].add(s)
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        for x in sets[a]:
            for y in sets[b]:
                if len(x & y) >= threshold * len(x | y):
                    out.add((a, b, round(len(x & y) / len(x | y), 6)))
    return out


def corpus(prose_of, seed, n=40):
    r = random.Random(seed)
    head = prose_of(12, 77)
    docs = []
    for base in range(n):
        text = prose_of(r.choice([4, 20, 60, 300]), seed * 1000 + base).split()
        for _ in range(r.choice([1, 1, 2, 5])):
            e = r.choice([0, 0.02, 0.05, 0.1])
            copy = [w if r.random() > e else f"edit{r.randrange(10**6)}" for w in text]
            docs.append((len(docs), (head + " " if r.random() < 0.3 else "") + " ".join(copy)))
    return docs


def test_jaccard_recall(spark, prose_of):
    got, want = set(), set()
    for seed in (1, 2, 3):
        docs = corpus(prose_of, seed)
        df = spark.createDataFrame([(d + seed * 10_000, t) for d, t in docs], "doc_id long, text string").repartition(3)
        got |= {tuple(r) for r in jaccard_join.similar_pairs(df).collect()}
        want |= {(a + seed * 10_000, b + seed * 10_000, j) for a, b, j in slow_pairs(docs)}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 100


def slow_classes(docs, threshold=0.5):
    """(doc_id, class_id, links) by comparing all documents."""
    near = {(a, b) for a, b, _ in slow_pairs(docs, threshold)}
    links = Counter(x for p in near for x in p)
    root = {x: x for x in links}
    while any(root[a] != root[b] for a, b in near):
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    return {(d, root[d], n) for d, n in links.items()}


def test_jaccard_large_groups(spark, prose_of, monkeypatch):
    """Many variants of one text and many texts with one long header, in groups far larger than a block."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4000)
    monkeypatch.setattr(jaccard_join, "ROWS", 16)
    monkeypatch.setattr(jaccard_join, "CELLS", 2000)
    base, head = prose_of(120, 5).split(), prose_of(30, 6)
    r = random.Random(3)
    docs = [(i, " ".join(w if r.random() > 0.04 else f"v{i}" for w in base)) for i in range(60)]
    docs += [(70 + i, docs[i][1]) for i in (3, 3, 9)] + [(80, docs[3][1])]
    docs += [(100 + i, head + " " + prose_of(r.choice([5, 10, 40]), 900 + i)) for i in range(40)]
    docs += [(200 + i, prose_of(100, 9) + " " + prose_of(90 * (i % 2), 950 + i)) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = slow_pairs(docs)
    got = [tuple(x) for x in jaccard_join.similar_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.98 * len(want) and len(want) > 1000
    near, classes = Counter(x for a, b, _ in got for x in (a, b)), {tuple(x) for x in jaccard_join.linked(df).collect()}
    assert {d: n for d, _, n in classes} == near
    assert {d: c for d, c, _ in classes} == {d: c for d, c, _ in slow_classes(docs)}


def test_jaccard_thresholds(spark, prose_of):
    for t in (0.3, 0.8, 1.0):
        docs = corpus(prose_of, 7, 12)
        want = slow_pairs(docs, t)
        got = {tuple(x) for x in jaccard_join.similar_pairs(spark.createDataFrame(docs, "doc_id long, text string"), t).collect()}
        assert got <= want and len(got) >= 0.98 * len(want)
    assert jaccard_join.needs(0.5)[:4] == [1, 1, 1, 1] and jaccard_join.needs(0.5)[47] == 13 and jaccard_join.needs(1.0)[9] == 10


def test_jaccard_small_sets(spark, prose_of):
    """Texts of a few words, which are sampled whole: no pair is missed."""
    words_ = prose_of(4, 8).split()
    r = random.Random(11)
    docs = [(i, " ".join(r.choice(words_) for _ in range(r.randrange(1, 9)))) for i in range(150)]
    got = {tuple(x) for x in jaccard_join.similar_pairs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == slow_pairs(docs) and len(got) > 50


def test_jaccard_no_pair_missed(spark, prose_of, low_hashed, monkeypatch):
    """Pairs whose lowest-hashed trigrams are those that they don't share, in one part and in many."""
    docs = []
    for i in range(4):
        base = " ".join(f"{w}{i}" for w in prose_of(150, 40 + i).split())
        docs += [(10 * i + k, low_hashed(base, n, 7 * i + k)) for k, n in enumerate((70, 70, 74, 60))]
        docs += [(10 * i + 7, docs[-1][1]), (10 * i + 8, prose_of(200, 90 + i))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = slow_pairs(docs)
    sample = lambda t: set(jaccard_join.gram_set(next(iter(words(pa.array([t]))))[2])[:48].tolist())
    text = dict(docs)
    assert sum(len(sample(text[a]) & sample(text[b])) < 13 for a, b, _ in want) >= 20
    for counted in (3_000_000, 500):
        monkeypatch.setattr(jaccard_join, "COUNTED", counted, raising=False)
        assert {tuple(x) for x in jaccard_join.similar_pairs(df).collect()} == want
        assert {tuple(x) for x in jaccard_join.linked(df).collect()} == slow_classes(docs)


def test_jaccard_without_broadcast(spark, prose_of, monkeypatch):
    monkeypatch.setattr(jaccard_join, "JOBS", 0)
    docs = corpus(prose_of, 4, 10)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(x) for x in jaccard_join.similar_pairs(df).collect()} == slow_pairs(docs)
    assert {tuple(x) for x in jaccard_join.linked(df).collect()} == slow_classes(docs)


def test_jaccard_awkward(spark, awkward, nothing):
    assert {tuple(r) for r in jaccard_join.similar_pairs(awkward).collect()} == {(1, 2, 1.0)}
    assert {tuple(r) for r in jaccard_join.linked(awkward).collect()} == {(1, 1, 1), (2, 1, 1)}
    kept = jaccard_join.one_of_each(awkward)
    assert kept.columns == awkward.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted("1 1 3 4 None 5 6 7 8 9 10".split())
    assert jaccard_join.similar_pairs(nothing).count() == 0 and jaccard_join.one_of_each(nothing).count() == 0 and jaccard_join.linked(nothing).count() == 0


def test_jaccard_id_with_two_texts(spark, prose_of):
    a, b = prose_of(40, 1), prose_of(40, 2)
    df = spark.createDataFrame([(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, b)], "doc_id long, text string")
    assert sorted(tuple(x) for x in jaccard_join.linked(df).collect()) == [(1, 1, 1), (1, 1, 2), (2, 1, 1), (3, 1, 2), (4, 1, 2)]


def test_components(spark):
    pairs = spark.createDataFrame([(i, i + 1, 1, 1) for i in range(1, 30)] + [(50, 51, 1, 1)], "a long, b long, shared long, total long")
    with Workspace() as w:
        assert {r.root for r in jaccard_join.components(pairs, w).collect()} == {1, 50}


# ---- 2 perplexity


def slow_kn(texts):
    """Log-probability of a byte 5-gram, from dictionaries."""
    c = {5: Counter(t[i : i + 5] for t in texts for i in range(len(t) - 4))}
    for n in (4, 3, 2, 1):
        c[n] = Counter(g[1:] for g in c[n + 1])
    d, tot, follow = {}, defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for n, cs in c.items():
        m = Counter(cs.values())
        y = m[1] / (m[1] + 2 * m[2]) if m[1] + 2 * m[2] else 0
        d[n] = [0.0] + [max(i / 10, min(float(i), i - (i + 1) * y * m[i + 1] / m[i])) if m[1] and m[i] else i / 2 for i in (1, 2, 3)]
        for g, v in cs.items():
            tot[n][g[:-1]] += v
            follow[n][g[:-1]][min(v, 3)] += 1

    def gamma(n, h):
        return sum(d[n][i] * follow[n][h][i] for i in (1, 2, 3)) / tot[n][h]

    def p(n, g):
        if n == 0:
            return 1 / 256
        h = g[:-1]
        low = p(n - 1, g[1:])
        if not tot[n][h]:
            return low
        v = c[n][g]
        return max(v - d[n][min(v, 3)], 0) / tot[n][h] + gamma(n, h) * low

    return lambda g: p(5, g)


def test_kneser_ney_brute_force(spark, prose_of, monkeypatch):
    texts = [prose_of(80, s) for s in range(6)] + ["ab", "", "abcde"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(50, None), (51, "QQ!! zz~~ " + texts[0]), (52, "é" * 9)], "doc_id long, text string")
    model = perplexity.kneser_ney(perplexity.count_grams(docs.where("doc_id < 9")))
    with Workspace() as w:
        got = {r.doc_id: (r["__lp"], r["__n"]) for r in perplexity.score(docs, model, w).collect()}
        monkeypatch.setattr(perplexity, "BLOCK_ROWS", 2)
        monkeypatch.setattr(perplexity, "HELD_GRAMS", 1)
        few = perplexity.score(w.written(docs.coalesce(1), "few"), model, w).collect()
        assert {r.doc_id: (r["__lp"], r["__n"]) for r in few} == got
    prob = slow_kn([t.encode() for t in texts])
    for d, t in docs.collect():
        b = (t or "").encode()
        grams = [b[i : i + 5] for i in range(len(b) - 4)]
        want = sum(math.log(prob(g)) for g in grams)
        assert got[d][1] == len(grams) and abs(got[d][0] / perplexity.SCALE - want) < 0.0003 * len(grams) + 1e-6
    # a distribution: the probabilities of all next bytes sum to 1
    for h in (b"lpha", b"zzzz"):
        assert abs(sum(prob(h + bytes([x])) for x in range(256)) - 1) < 1e-9


def test_gram_table():
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(0, 1 << 40, 5000))
    t = perplexity._Table(keys[::2], np.arange(len(keys[::2])))
    v, hit = t.find(keys)
    assert hit[::2].all() and not hit[1::2].any() and (v[::2] == np.arange(len(keys[::2]))).all() and (v[1::2] == 0).all()
    v, hit = perplexity._Table(keys[:0], keys[:0]).find(keys)
    assert not hit.any()


def test_quality_classifier(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r.keep for r in perplexity.judge(docs, labels).collect()}
    lab = labels.collect()
    good = [got[r.doc_id] for r in lab if r.quality == 1 and r.toxic == 0]
    bad = [got[r.doc_id] for r in lab if r.quality == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.05


def test_classifier_awkward(spark, awkward, labels, nothing):
    got = perplexity.judge(awkward, labels)
    assert got.count() == 12 and {r.keep for r in got.where("perplexity IS NULL").collect()} == {True}
    kept = perplexity.keep_good(awkward, labels)
    assert kept.columns == awkward.columns and {3, 4, None} <= {r.doc_id for r in kept.collect()}
    none = perplexity.judge(awkward, labels.limit(0))
    assert none.where("keep").count() == 12
    assert perplexity.judge(nothing, labels).count() == 0


# ---- 7 quality rules


def test_rules_held_out():
    b = "/root/testdata/sf0.1/"
    t = duckdb.sql(f"SELECT text, quality, toxic FROM '{b}documents.parquet' JOIN '{b}labels.parquet' USING (doc_id) ORDER BY md5(doc_id::VARCHAR) LIMIT 2400").to_arrow_table()
    texts, q, x = quality_rules.as_strings(t["text"]), t["quality"].to_numpy(), t["toxic"].to_numpy()
    cal = np.arange(1600) % 4 == 0
    heads = quality_rules.Heads([quality_rules.fit(texts.slice(0, 1600), y[:1600], cal) for y in (q, x)])
    pq, px = heads.probabilities(texts.slice(1600))
    assert ((pq >= 0.5) == q[1600:]).mean() > 0.97 and ((px >= 0.5) == x[1600:]).mean() > 0.94
    # calibrated: the mean probability is the rate
    assert abs(pq.mean() - q[1600:].mean()) < 0.03 and abs(px.mean() - x[1600:].mean()) < 0.04


def test_rules_brute_force():
    texts = quality_rules.as_strings(pa.array(["good words here again", "bad bad bad bad words", None, "", "é bad word", "x" * 5000 + " bad"] * 40))
    y = np.array([1, 0, 1, 1, 0, 0] * 40)
    head = quality_rules.fit(texts, y, np.arange(240) % 5 == 0)
    whole = head.probability(texts)
    one = np.concatenate([head.probability(texts.slice(i, 1)) for i in range(6)])
    assert np.allclose(whole[:6], one) and np.allclose(whole[:6], whole[6:12])
    assert whole[0] > 0.5 > whole[1]
    # features: presence of each word, pair and byte 4-gram, none across texts
    chosen = np.arange(1 << quality_rules.BITS, dtype=np.int32)
    r, c = quality_rules.presence(texts.slice(0, 2), chosen)
    for row, text in enumerate(["good words here again", "bad bad bad bad words"]):
        r1, c1 = quality_rules.presence(quality_rules.as_strings(pa.array([text])), chosen)
        assert set(c[r == row]) == set(c1)


def slow_features(text):
    """Buckets of all features of a text, one feature at a time."""
    from corpusmill.llm.tokens import combine

    one = lambda x: np.array([x], np.uint64)
    ws = [one(word_hash(w)) for w in split(text)]
    out = {int(quality_rules._bucket(w, "word")[0]) for w in ws}
    out |= {int(quality_rules._bucket(combine(a, b), "pair")[0]) for a, b in itertools.pairwise(ws)}
    out |= {int(quality_rules._bucket(one(0), "repeat")[0]) for i in range(len(ws) - 3) if ws[i] == ws[i + 1] == ws[i + 2] == ws[i + 3]}
    b = text.encode()
    for i in range(len(b) - 3):
        h = int.from_bytes(b[i : i + 4], "little") * 2654435761 % 2**32
        out.add((h ^ 0x5BD1E995) >> (32 - quality_rules.BITS))
    return out


def slow_head(texts, y, calibrates):
    """A head from sets and dense matrices; None with one class."""
    feats = [slow_features(t) for t in texts]
    tr = [i for i in range(len(y)) if not calibrates[i]]
    n1 = sum(y[i] for i in tr)
    n0 = len(tr) - n1
    w1, w0 = Counter(f for i in tr if y[i] for f in feats[i]), Counter(f for i in tr if not y[i] for f in feats[i])
    rate = {f: ((w1[f] + 0.5) / (n1 + 1), (w0[f] + 0.5) / (n0 + 1)) for f in w1 | w0 if w1[f] + w0[f] >= quality_rules.MIN_ROWS}
    p = {f: (w1[f] + w0[f] + 1) / (n1 + n0 + 2) for f in rate}
    best = sorted(f for f, (a, b) in rate.items() if abs(a - b) / math.sqrt(max(p[f] * (1 - p[f]), 1e-9) * (1 / n1 + 1 / n0)) >= quality_rules.MIN_Z)
    x = np.array([[math.log(rate[f][0] / rate[f][1]) * (f in s) for f in best] for s in feats])
    return best, x


def test_rules_against_brute_force(spark, prose_of):
    """The query's probabilities from features in sets, a regression held at its optimum, and calibration."""
    r = random.Random(21)
    docs = []
    for i in range(160):
        good, toxic = i % 3 != 0, i % 5 == 0
        body = prose_of(r.randrange(3, 25), i).split()
        body += ["idiot"] * toxic + (["junk"] * 5 + ["zz qq zz"] if not good else [])
        r.shuffle(body)
        docs.append((i, " ".join(body) + (" junk junk junk junk" if not good and i % 2 else ""), int(good), int(toxic)))
    docs[4] = (4, "", 1, 0)
    df = spark.createDataFrame(docs, "doc_id long, text string, quality int, toxic int").repartition(3)
    labels_ = df.select("doc_id", F.when(F.col("doc_id") != 7, F.col("quality")).alias("quality"), F.when(F.col("doc_id") != 9, F.col("toxic")).alias("toxic"))
    got = {x.doc_id: x for x in quality_rules.apply_rules(df, labels_).collect()}
    order = sorted(((int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16), d) for d, *_ in docs))
    head = dict(zip(("quality", "toxic"), quality_rules.train(df, labels_), strict=True))
    for k, (name, unknown) in enumerate((("quality", 7), ("toxic", 9))):
        some = [(h, d) for h, d in order if d != unknown]
        texts, y = [docs[d][1] for _, d in some], np.array([docs[d][2 + k] for _, d in some])
        cal = np.array([h % quality_rules.CALIBRATE == 0 for h, _ in some])
        best, x = slow_head(texts, y, cal)
        h = head[name]
        assert np.flatnonzero(h.chosen >= 0).tolist() == best and len(best) > 5
        ratio = np.array([math.log(a) for a in np.exp(np.abs(x).max(axis=0))]) * np.sign(x.sum(axis=0))
        u = h.weights / ratio
        logit = x @ u + h.bias
        g = (1 / (1 + np.exp(-logit[~cal])) - y[~cal]) / (~cal).sum()
        # within reach of the optimum
        assert np.abs(x[~cal].T @ g + 1e-3 * u).max() < 2e-3 and abs(g.sum()) < 1e-2
        n1, n0 = int(y[cal].sum()), int((1 - y[cal]).sum())
        t = np.where(y[cal] == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        q = 1 / (1 + np.exp(-(h.scale * logit[cal] + h.shift)))
        assert abs((q - t).sum()) < 1e-3 and abs(((q - t) * logit[cal]).sum() + 1e-3 * (h.scale - 1)) < 1e-2
        for d, text, *_ in docs:
            at = [best.index(f) for f in slow_features(text) if f in best]
            p = 1 / (1 + math.exp(-min(30, max(-30, h.scale * (h.bias + sum(h.weights[at])) + h.shift))))
            assert abs(got[d][name] - p) < 6e-5
    assert all(x.keep == (x.quality >= 0.5 and x.toxic <= 0.5) for x in got.values())


def test_rules_null_labels(spark):
    """A null label of one kind doesn't take the other from its head."""
    docs = spark.createDataFrame([(i, "good fine words" if i % 2 else "bad bad words") for i in range(200)], "doc_id long, text string")
    both = spark.createDataFrame([(i, i % 2, None) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.quality for r in quality_rules.apply_rules(docs, both).collect()}
    assert min(got[i] for i in range(1, 200, 2)) > 0.5 > max(got[i] for i in range(0, 200, 2))


def test_rules_awkward(spark, awkward, labels, nothing):
    got = quality_rules.apply_rules(awkward, labels)
    assert got.count() == 12 and got.where("quality BETWEEN 0 AND 1 AND toxic BETWEEN 0 AND 1").count() == 12
    assert quality_rules.apply_rules(awkward, labels.limit(0)).count() == 12
    assert quality_rules.apply_rules(nothing, labels).count() == 0


# ---- 8 PII


def test_messages_are_exact_on_trees():
    r = np.random.default_rng(2)
    n, k = 5, 3
    unary = r.normal(size=(n, k))
    edges = np.array([[0, 1], [1, 2], [1, 3], [3, 4]])
    pot = r.normal(size=(4, k, k))
    p = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        w = math.exp(sum(unary[i, x] for i, x in enumerate(labels)) + sum(pot[e, labels[a], labels[b]] for e, (a, b) in enumerate(edges)))
        for i, x in enumerate(labels):
            p[i, x] += w
    assert np.allclose(pii_crf.marginals(unary, edges, pot, rounds=60, damp=0.0), p / p.sum(axis=1, keepdims=True), atol=1e-6)


def slow_candidates(text):
    """Tokens by a split, those that may be entities by looking at each."""
    spans = [(m.start(), m.group()) for m in re.finditer(r"[^\t\n\x0b\x0c\r ]+", text)]
    name = r"(?:api[_-]?key|token|secret|password|passwd|pwd)[\"']?"
    all_ = []
    for i, (start, w) in enumerate(spans):
        core = re.sub(r"^[^0-9A-Za-z@+(]+|[^0-9A-Za-z@)]+$", "", w)
        at = start + (w.find(core) if core else 0)
        before, before2 = spans[i - 1][1] if i else "", spans[i - 2][1] if i > 1 else ""
        m = re.match(r"([A-Za-z_-]+[\"']?)([=:])[\"']?([^\s\"']{8,})", core, re.A)
        if m and re.search(name + "$", m[1], re.I):
            at, core, before, before2 = at + m.start(3), m[3], m[2], m[1]
        elif before[-1:] in ("=", ":") and before and re.search(name + "$", before[:-1], re.I):
            before, before2 = before[-1], before[:-1]
        all_.append(pii_crf.Token(i, at, core, before, before2, spans[i + 1][1] if i + 1 < len(spans) else ""))
    own = {i for i, (_, w) in enumerate(spans) if re.search("[0-9@]", w)}
    named = set()
    for m in re.finditer(f"{name}[ \t]*[=:]", text, re.I | re.A):
        end = m.end()
        named |= {next((i for i, (s, w) in enumerate(spans) if s + len(w) > end), len(spans) - 1)}
    same = lambda w: re.sub("[^0-9a-z]+", "", w.lower())
    keys = {same(all_[i].core) for i in named - own}
    own |= named | {i for i, (_, w) in enumerate(spans) if len(same(w)) >= 6 and same(w) in keys}
    return [all_[i] for i in sorted(own)]


def slow_labels(f, text):
    """Labels by passing messages one at a time between dictionaries, each sweep from those of the one before."""
    ts = slow_candidates(text)
    k = len(pii_crf.LABELS)
    unary = []
    for i, t in enumerate(ts):
        u = f.bias.copy()
        for x in pii_crf.observations(t):
            u = u + f.unary.get(x, np.zeros(k))
        if t.before and (i == 0 or ts[i - 1].index != t.index - 1):
            u = u + f.chain[0]
        if t.after and (i + 1 == len(ts) or ts[i + 1].index != t.index + 1):
            u = u + f.chain[:, 0]
        unary.append(u)
    key = lambda t: re.sub("[^0-9a-z]+", "", t.core.lower())
    group = {i: [j for j, o in enumerate(ts) if j != i and len(key(t)) >= 6 and key(o) == key(t)] for i, t in enumerate(ts)}
    chain = {(i, i + 1) for i in range(len(ts) - 1) if ts[i + 1].index == ts[i].index + 1}
    msg = {e: np.zeros(k) for a, b in chain for e in ((a, b), (b, a))}
    link = {i: np.zeros(k) for i, g in group.items() if g}
    send = lambda x: (lambda y: y - y.max())(np.array([np.logaddexp.reduce(x[:, j]) for j in range(k)]))
    for _ in range(400):
        total = [u + sum((m for (a, b), m in msg.items() if b == i), np.zeros(k)) + link.get(i, np.zeros(k)) for i, u in enumerate(unary)]
        new = {(a, b): 0.3 * m + 0.7 * send((total[a] - msg[b, a])[:, None] + (f.chain if a < b else f.chain.T)) for (a, b), m in msg.items()}
        own = {i: total[i] - link[i] for i in link}
        best = {i: max(group[i], key=lambda j: (np.logaddexp.reduce(own[j][1:]) - own[j][0], -j)) for i in link}
        link = {i: 0.3 * m + 0.7 * send(own[best[i]][:, None] + f.skip) for i, m in link.items()}
        msg = new
    total = [u + sum((m for (a, b), m in msg.items() if b == i), np.zeros(k)) + link.get(i, np.zeros(k)) for i, u in enumerate(unary)]
    return ts, [int(t.argmax()) for t in total]


def test_pii_brute_force(spark, field):
    """The query's entities and redacted texts against tokens by splitting, messages one by one and replacing from the end."""
    f, _ = field
    hexes = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    made = [
        f'so token = "{hexes}" and later {hexes}! and {hexes.upper()}', "password: kZx!vQmmRt then kZx!vQmmRt; and kzx-vqmmrt", "password: please call (743) 555-3824", "api_key=\n  Qq!wwEErrTt", "token   =", "=: token", "é token:é1é2é3é4é5é", "x" * 90 + "1",
        "ab.19@mail5.example.com, ab.19@mail5.example.com", "card 4111111111111111 4111-1111-1111-1111", "from 76.34.228.86 to 999.1.1.1", "pwd=abc", "secret:" + " " * 90 + "mmVVnn!!kk", "",
    ]
    real = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE strlen(text) < 6000 AND regexp_matches(text, '[0-9@]') ORDER BY doc_id").fetchall()]
    texts = made + real[:60]
    for t in texts:
        assert pii_crf.candidates(t) == slow_candidates(t), t
        assert pii_crf.label_batch(f, [slow_candidates(t)])[0].tolist() == slow_labels(f, t)[1], t
    # the query itself, with weights from the same documents
    own = pii_crf.train(sorted(t for t in texts if re.search(r"[0-9@]|(?i:api[_-]?key|token|secret|passw|pwd)", t)))
    want = {}
    for d, t in enumerate(texts):
        ts, labels = slow_labels(own, t)
        if found := pii_crf.entities(ts, np.array(labels)):
            masked = t
            for label, a, b in reversed(found):
                masked = f"{masked[:a]}[{label}]{masked[b:]}"
            want[d] = (len(found), masked)
    got = pii_crf.find_private(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert {r.doc_id: (r.n_entities, r.redacted) for r in got} == want and len(want) > 20


def test_pii_training_brute_force(field):
    """Potentials from counting each pair of neighbours and each pair of successive same tokens."""
    texts = field[1][:150]
    f = pii_crf.train(texts)
    k = len(pii_crf.LABELS)
    chain, skip = np.full((k, k), 0.5), np.full((k, k), 0.02) + 0.98 * np.eye(k)
    for t in texts:
        ts = slow_candidates(t)
        labels = pii_crf.strict_labels(ts)
        key = [re.sub("[^0-9a-z]+", "", x.core.lower()) for x in ts]
        for i, x in enumerate(key):
            others = Counter(labels[j] for j, y in enumerate(key) if y == x and len(x) >= 6 and labels[j])
            labels[i] = labels[i] or (min(others, key=lambda n: (-others[n], n)) if others else 0)
        by = {x.index: y for x, y in zip(ts, labels, strict=True)}
        for i, x in enumerate(ts):
            if x.index and x.index - 1 not in by and x.before:
                chain[0, by[x.index]] += 1
            if x.after:
                chain[by[x.index], by.get(x.index + 1, 0)] += 1
            same = [j for j in range(i) if key[j] == key[i] and len(key[i]) >= 6]
            if same and not (same[-1] == i - 1 and ts[i - 1].index == x.index - 1):
                skip[labels[same[-1]], labels[i]] += 1
                skip[labels[i], labels[same[-1]]] += 1
    for got, c in ((f.chain, chain), (f.skip, skip)):
        p = c / c.sum()
        assert np.allclose(got, np.clip(np.log(p / np.outer(p.sum(axis=1), p.sum(axis=0))), -3, 3))


def test_pii_regression_brute_force():
    """Weights against the same steps over a dense matrix, and near the optimum."""
    r = np.random.default_rng(4)
    x = (r.random((60, 7)) < 0.4).astype(float)
    y = (x[:, 0] + 2 * x[:, 1] * (r.random(60) < 0.8)).astype(int)
    rows, cols = np.nonzero(x)
    w, b = pii_crf._multinomial(rows, cols, y, 7, 4, rounds=4000)
    z = x @ w + b
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    g = x.T @ (p - np.eye(4)[y]) / 60
    assert np.abs(g / x.mean(axis=0)[:, None] + 1e-3 * w).max() < 1e-3 and np.abs((p - np.eye(4)[y]).mean(axis=0)).max() < 1e-3


def test_pii_many_tokens_are_linear():
    import time

    t = time.process_time()
    text = " ".join(f"a{100_000 + i % 50_000}b7" for i in range(100_000))
    ts = pii_crf.candidates(text)
    assert len(pii_crf.links(ts)[1]) == 50_000 and len(ts) == 100_000
    assert time.process_time() - t < 10


@pytest.fixture(scope="module")
def field():
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' WHERE regexp_matches(text, '[0-9@]') ORDER BY md5(doc_id::VARCHAR)").fetchall()]
    return pii_crf.train(texts[: len(texts) // 2]), texts[len(texts) // 2 :]


def test_pii_held_out(field):
    f, texts = field
    right = total = 0
    for t in texts:
        ts = pii_crf.candidates(t)
        got, want = pii_crf.label_batch(f, [ts])[0], pii_crf.strict_labels(ts)
        right += sum(int(a == b) for a, b in zip(got, want, strict=True))
        total += len(ts)
    assert right / total > 0.97


def test_links_make_labels_agree(field):
    f, _ = field
    s = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    half = "deploy-77xq"
    for t, secret in ((f'so token = "{s}" and later {s}!', s), (f"the password = {half}9931zz then, see {half}9931zz", half + "9931zz")):
        ts = pii_crf.candidates(t)
        labels = pii_crf.label_batch(f, [ts])[0]
        if labels[0]:
            assert len(set(labels.tolist())) == 1 and secret not in pii_crf.redact(t, pii_crf.entities(ts, labels))
    skip = pii_crf.links(pii_crf.candidates("abc123x q abc123x r ABC-123x"))[1]
    assert skip.tolist() == [[0, 1], [1, 2]]


@pytest.mark.parametrize("leaning", [1.4, 2.0])
@pytest.mark.parametrize("named_at", [0, 25, 50])
def test_named_once_found_everywhere(leaning, named_at):
    k = len(pii_crf.LABELS)
    skip = np.where(np.eye(k, dtype=bool), 3.0, -3.0)
    skip[0, 0] = 1.5
    bias, named = np.full(k, -9.0), np.zeros(k)
    bias[0], bias[5], named[5] = 0, -leaning, 8
    f = pii_crf.Field({"named": named}, bias, np.zeros((k, k)), skip)
    secret = "deploy-77xq9931zz"
    bare = [f"then see {secret} again"] * 50
    text = " ".join([*bare[:named_at], f"password = {secret}", *bare[named_at:]])
    other = " ".join(bare)
    docs = [pii_crf.candidates(t) for t in (other, text, other)]
    got = pii_crf.label_batch(f, docs)
    assert got[1].tolist() == [5] * 51 and secret not in pii_crf.redact(text, pii_crf.entities(docs[1], got[1]))
    assert not got[0].any() and not got[2].any()


def test_messages_reach_along_a_chain():
    """Evidence at one end of a long chain."""
    unary = np.zeros((40, 2))
    unary[0, 1] = 30
    edges = np.array([(i, i + 1) for i in range(39)])
    pot = np.broadcast_to(np.array([[3.0, -3.0], [-3.0, 3.0]]), (39, 2, 2))
    p = pii_crf.marginals(unary, edges, pot)
    want = 0.5 + 0.5 * math.tanh(3) ** 39
    assert abs(p[-1, 1] - want) < 1e-4


def test_pii_examples(field):
    f, _ = field
    text = "call +1 (743) 555-3824 or ab.19@mail5.example.com from 76.34.228.86, card 4111111111111111. Version 2.0, license 3. token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\""
    ts = pii_crf.candidates(text)
    es = pii_crf.entities(ts, pii_crf.label_batch(f, [ts])[0])
    assert [e[0] for e in es] == ["PHONE", "EMAIL", "IP", "CARD", "SECRET"]
    assert pii_crf.redact(text, es) == 'call [PHONE] or [EMAIL] from [IP], card [CARD]. Version 2.0, license 3. token = "[SECRET]"'


def test_pii_awkward(spark, awkward, nothing):
    private = "é write to ab.19@mail5.example.com now"
    df = spark.createDataFrame([(i, private) for i in (100, 100, None)] + [(i, f"filler {prose_free(i)} ab.{i:02d}@mail5.example.com x") for i in range(40)], "doc_id long, text string")
    all_ = awkward.unionByName(df, allowMissingColumns=True).selectExpr("*", "'z' AS n_entities", "'z' AS entities", "'z' AS redacted")
    got = pii_crf.find_private(all_).collect()
    assert len(got) == 43 and {r.doc_id for r in got} == {100, None, *range(40)}
    r = next(r for r in got if r.doc_id == 100)
    e = r.entities[0]
    assert private[e.start : e.end] == "ab.19@mail5.example.com" and r.redacted == "é write to [EMAIL] now"
    assert pii_crf.find_private(nothing).count() == 0


def prose_free(i):
    return "word " * (i % 5)
