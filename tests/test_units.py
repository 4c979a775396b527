"""Classification, sources, slimming, patches, packing and streaming on small inputs."""

from __future__ import annotations

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import classify as C
from corpusmill.operators import corpus as O
from corpusmill.operators import order
from corpusmill.operators import patch as P
from corpusmill.operators import slim as S
from corpusmill.plans.render import tree_lines
from corpusmill.sources import bytes as B
from corpusmill.sources import ignore as I
from corpusmill.sources import remote as RM
from corpusmill.sources import tree as R


def values(spark, column, rows):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, v string").orderBy("i").select(column).collect()]


def test_names(spark):
    rows = ["venv", "my_venv", "convenience", ".VENV", "site-packages2"]
    assert values(spark, C.is_venv("v"), rows) == [True, True, False, True, True]
    rows = ["a_merged.md", "a_merged.part1-of-2.xml", "a_merged.py", "merged.md", "x_merged.y_merged.txt"]
    assert values(spark, C.is_own_output("v"), rows) == [True, True, False, False, True]
    rows = [".env", ".env.example", "a.pem", "id_rsa.pub", ".npmrc", "my_passwords.csv", "password_reset.py"]
    assert [bool(x) for x in values(spark, C.sensitive_reason("v"), rows)] == [True, False, True, True, True, True, False]
    assert values(spark, T.extension("v"), [".gitignore", "a.B", "a", "a.tar.gz"]) == ["", "b", "", "gz"]


def test_first_rule_decides(spark):
    df = spark.createDataFrame([("package-lock.json", 1), ("a.min.js", 1), ("a.rs", 3_000_000), ("a.png", 9), ("Makefile", 600_000), ("x.zzz", 600_000), ("x.zzz", 5), ("notes", 5), (".gitignore", 5)], "name string, size long")
    got = [tuple(r.v) for r in df.select(C.name_verdict("name", "size").alias("v")).collect()]
    assert [g[0] for g in got] == ["skip", "binary", "skip", "binary", "text", "skip", "sniff", "sniff", "sniff"]
    assert got[2][1] == "too large (2929 KB)"


def test_scalars(spark):
    assert values(spark, T.fence("v"), ["", "a ``` b", "`````"]) == ["```", "````", "``````"]
    assert values(spark, T.anchor("v"), ["src/My File-1.rs"]) == ["srcmy-file-1rs"]
    assert values(spark, T.drop_blank_lines("v"), ["a\r\n\n \t\nb", "\n \n", ""]) == ["a\nb\n", "", ""]
    assert values(spark, T.match_newlines("v", F.lit("x\r\n")), ["a\nb"]) == ["a\r\nb"]
    assert values(spark, T.safe_relative("v"), ["../x", "a/./b", "/a", "c:\\x", "a\\b", ""]) == [None, "a/b", None, None, "a/b", None]
    assert values(spark, T.safe_file_name("v"), ["CON", "a/b:c", " .x. "]) == ["_CON", "abc", "x"]
    assert values(spark, T.clone_url("v"), ["https://g.org/a/b/tree/main/x", "git@h:o/r.git", "o/r", "./o/r", "a b", "https://g.org/a"]) == ["https://g.org/a/b.git", "git@h:o/r.git", "https://github.com/" + "o/r.git", None, None, None]
    assert values(spark, T.entry_rank("v"), ["README.md", "src/main.rs", "tests/a.rs", "docs/b.md"]) == [-100, -48, 22, 17]
    assert values(spark, T.entropy("v"), ["0123456789abcdef", "aa", ""]) == [4.0, 0.0, 0.0]


def test_order_by_components(spark):
    df = spark.createDataFrame([("a-b/c",), ("a/b",), ("a/a",)], "rel string")
    assert [r.rel for r in df.orderBy(*O.path_order()).collect()] == ["a/a", "a/b", "a-b/c"]
    a, b = ([r.rel for r in df.orderBy(*O.read_order(o)).collect()] for o in ("entry-first", "important-last"))
    assert a == b[::-1]


def test_packing(spark):
    df = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate([30, 30, 100, 10, 20])], "rel string, tokens long")
    assert [r.part for r in O.pack(df, 60, F.col("rel")).orderBy("rel").collect()] == [1, 1, 2, 3, 3]
    assert {r.part for r in O.pack(df, 1000, F.col("rel")).collect()} == {1}
    best = O.pack_best(df.withColumnRenamed("tokens", "cost"), 60, F.col("rel"))
    assert [r.rel for r in best.orderBy("rel").collect()] == ["f0", "f1"]


def folded(tokens, budget):
    used, part, out = 0, 1, []
    for t in tokens:
        if used > 0 and used + t > budget:
            used, part = 0, part + 1
        used += t
        out.append(part)
    return out


def test_packing_over_partitions(spark):
    """The fold carried over many ranges is the fold over all, with empty and oversized blocks among them."""
    r = random.Random(2)
    for budget, most in ((20, 9), (20, 30), (3, 2), (1000, 5)):
        tokens = [r.choice([0, 0, r.randrange(1, most)]) if r.random() < 0.5 else r.randrange(0, most) for _ in range(300)]
        df = spark.createDataFrame(list(enumerate(tokens)), "rel int, tokens int").repartition(5)
        got = {x.rel: x.part for x in O.pack(df, budget, F.col("rel")).collect()}
        assert [got[i] for i in range(300)] == folded(tokens, budget)
    assert O.pack(df.limit(0), 5, F.col("rel")).count() == 0
    runs = order._Run(np.array([0, 0, 7, 0, 30, 1]), 20)
    assert runs.starts(0) == [4, 5] and runs.starts(20) == [2, 4, 5] and runs.starts(25) == [0, 4, 5]


def test_numbered(spark):
    rows = [(i * 7 % 101, "x" * (i % 3)) for i in range(101)]
    df = spark.createDataFrame(rows, "k int, at string").repartition(6)
    got = O.numbered(df, F.col("k").desc(), into="n")
    assert got.columns == ["k", "at", "n"] and {x.k: x.n for x in got.collect()} == {k: 101 - k for k in range(101)}
    assert O.numbered(df.limit(0), F.col("k")).count() == 0


def test_pack_best_pages(spark, monkeypatch):
    monkeypatch.setattr(order, "PAGE", 7)
    r = random.Random(6)
    costs = [r.choice([0, 1, 5, 40, 90, 200, None]) for _ in range(200)]
    got = {x.i for x in O.pack_best(spark.createDataFrame(list(enumerate(costs)), "i int, cost int"), 300, F.col("i")).collect()}
    left, want = 300, set()
    for i, c in enumerate(costs):
        if c is not None and c <= left:
            left, want = left - c, want | {i}
    assert got == want


def test_ignore():
    lines = ["# c", "*.log", "!keep.log", "/build", "docs/**/tmp", "out/"]
    got = {p: R.ignored_by(p, lines) for p in ("a.log", "x/a.log", "keep.log", "build/a", "src/build/a", "docs/x/y/tmp", "out/a", "x/out/b")}
    assert got == {"a.log": True, "x/a.log": True, "keep.log": False, "build/a": True, "src/build/a": False, "docs/x/y/tmp": True, "out/a": True, "x/out/b": True}
    assert I.keep_globs("a/b.md", I.compile_lines(["*.md"]), I.compile_lines(["a/"])) is False


def test_bytes():
    assert B.is_binary(b"\x89PNG....") and B.is_binary(b"\0" * 10) and not B.is_binary(b"hello") and not B.is_binary(b"")
    assert B.sniffs_as_text(b"") and not B.sniffs_as_text(b"a" * 1001) and not B.sniffs_as_text("é".encode() * 100)
    assert B.decode(b"\xef\xbb\xbfhi")[0] == "hi" and B.decode("hi".encode("utf-16"))[0] == "hi" and B.decode(b"caf\xe9")[0] == "café" and B.decode("é".encode()) == ("é", None)
    assert B.fnv1a(b"") == 0xCBF29CE484222325 and B.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_tree(spark, tmp_path):
    files = {
        "src/main.rs": "fn main() {}", ".gitignore": "skipped/\n", "skipped/x.md": "x", "node_modules/a.js": "x", ".hidden": "x", ".env": "A=1", "src/__init__.py": "",
        ".github/ci.yml": "a: 1", "_x.md": "x", "venv/a.py": "x", "img.png": "x",
    }
    for k, v in files.items():
        (tmp_path / k).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / k).write_text(v)
    os.symlink(tmp_path / "_x.md", tmp_path / "link.md")
    rows = {r.rel: r.content for r in R.read_tree(spark, str(tmp_path)).collect()}
    assert set(rows) == {"src/main.rs", ".gitignore", ".env", "src/__init__.py", ".github/ci.yml", "_x.md", "img.png"}
    assert rows["img.png"] is None and bytes(rows["src/main.rs"]) == b"fn main() {}"
    for bad in ("/etc", "/", str(tmp_path / "none")):
        with pytest.raises(ValueError):
            R.check_root(bad)


def test_slim():
    py = "def f(a):\n    # c\n    x = '#no'  # d\n    return x\n\nclass A:\n    def g(self):\n        return 1\n"
    assert S.strip_comments("py", py) == "def f(a):\n    x = '#no'\n    return x\n\nclass A:\n    def g(self):\n        return 1\n"
    assert S.slim_text("py", py)[0] == "def f(a):\n    ...\n\nclass A:\n    def g(self):\n        ...\n"
    rs = "// c\npub fn f(x: &'a str) -> u8 { let s = \"}\"; 1 }\nstruct A { b: u8 }\n"
    assert S.slim_text("rs", rs) == ("pub fn f(x: &'a str) -> u8 { ... }\nstruct A { b: u8 }\n", True)
    js = "const f = (a) => { return 1 };\nif (a) { b(); }\nclass X { m(a) { return `}`; } }\n"
    assert S.compress("js", js) == "const f = (a) => { ... };\nif (a) { b(); }\nclass X { m(a) { ... } }\n"
    for ext, bad in (("py", "def ("), ("rs", "fn f( {"), ("md", "# x")):
        assert S.slim_text(ext, bad) == (bad, False)
    defs, refs = S.tags("py", "def helper(a):\n    return other(a)\n")
    assert defs == [("helper", "def helper(a)")] and "other" in refs
    assert [n for n, _ in S.tags("rs", "fn core() {}\nstruct Leaf { a: u8 }")[0]] == ["core", "Leaf"]


REPLY = "Sure.\n\n## `src/a.py`\n\nHere:\n\n```py\nx = 1\n```\n\n**src/b.md**\n````md\n```\nin\n```\n````\n\n```diff\n--- a/c.txt\n+++ b/c.txt\n@@ -1,2 +1,2 @@\n a\n-b\n+B\n```\n"


def test_script_regexes_and_keywords():
    code = "const r = /[/*]/; // gone\nfunction f(a) { return a / 2 / g(a); }\nz = x || /y'{/.test(z)\n"
    assert S.strip_comments("js", code) == code.replace(" // gone", "")
    assert S.compress("js", code).count("{ ... }") == 1
    defs, refs = S.tags("js", code)
    assert [n for n, _ in defs] == ["f"] and not {"function", "return", "const", "f"} & set(refs) and {"g", "x", "z", "test"} <= set(refs)


def test_source_resolution(tmp_path, spark):
    given = ["https://github.com/a/b/tree/main/x", "a/b", "git@host:a/b.git", "https://x.y/", "no such", "https://h.io/a/b.git/"]
    assert [RM.clone_url(g) for g in given] == values(spark, T.clone_url("v"), given)
    assert RM.resolve(str(tmp_path)) == (str(tmp_path), None)
    with pytest.raises(ValueError):
        RM.resolve("neither one")
    assert re.fullmatch(r"my_\d{8}_\d{6}_merged\.md", RM.output_name(str(tmp_path / "my"), "md"))


def test_previews(spark):
    """Apply-back over tables is apply-back on a tree."""
    hunk = P.parse_diff("--- a/m\n+++ b/m\n@@ -1,2 +1,2 @@\n-x\n+z\n y".split("\n"))[0].hunks
    cs = [("m", P.Change("m", "diff", None, hunk)), ("new/f", P.Change("new/f", "full", "a\n")), ("new/f", P.Change("new/f", "full", "b\n")), ("win", P.Change("win", "full", "q\nr")), ("gone", P.Change("gone", "delete")), ("../up", P.Change("../up", "full", "x")), ("bin", P.Change("bin", "full", "x")), ("d", P.Change("d", "full", "x")), ("same", P.Change("same", "full", "s\n"))]
    rows = [(p, i, c.kind, c.content, [(h.old_start, h.lines, h.no_eol) for h in c.hunks]) for i, (p, c) in enumerate(cs)]
    changes = spark.createDataFrame(rows, "path string, ord int, kind string, content string, hunks array<struct<old_start:int,lines:array<string>,no_eol:boolean>>")
    there = {"m": b"x\ny\n", "win": b"a\r\nb\r\n", "gone": b"g", "bin": b"\0\1\2\3" * 20, "same": b"s\n"}
    state = spark.createDataFrame([(p, d, False) for p, d in there.items()] + [("d", None, True)], "path string, content binary, folder boolean")
    got = {r.path: (r.action, r.ok, r.text, r.identical) for r in P.previews(changes, state).collect()}
    assert got == {
        "m": ("modify", True, "z\ny\n", False), "new/f": ("create", True, "b\n", False), "win": ("modify", True, "q\r\nr", False), "gone": ("delete", False, None, False), "../up": ("refuse", False, None, False),
        "bin": ("refuse", False, None, False), "d": ("refuse", False, None, False), "same": ("modify", True, "s\n", True),
    }


def test_change_stream(spark, tmp_path):
    """A change in a tree starts a batch; one in our own folders or outputs doesn't."""
    import time

    from corpusmill.streaming import watch as W

    root, told, runs = tmp_path / "t", [], []
    (root / "sub").mkdir(parents=True)
    (root / "sub/a.txt").write_text("1")
    progress = W.Progress(lambda *x: told.append(x))
    spark.streams.addListener(progress)
    q = W.watch(W.read_changes(spark, str(root)), lambda: runs.append(1), str(tmp_path / "c"))
    try:
        end = time.time() + 60
        while not told and time.time() < end:
            time.sleep(0.3)
        time.sleep(3)
        (root / "sub/b.txt").write_text("2")
        while len(runs) < 2 and time.time() < end:
            time.sleep(0.3)
        assert len(runs) >= 2
    finally:
        q.stop()
        spark.streams.removeListener(progress)
    poll = W._Poll(str(root))
    time.sleep(0.1)
    start = poll.initialOffset()
    (root / "sub/c.txt").write_text("3")
    assert not list(poll.read(start)[0])
    time.sleep(0.1)
    rows, now = poll.read(start)
    assert "sub/c.txt" in {r for r, _ in rows} and list(poll.readBetweenOffsets(start, now)) and not list(poll.readBetweenOffsets(now, now))
    (root / "sub/c.txt").unlink()
    time.sleep(0.1)
    assert {r for r, _ in poll.read(now)[0]} == {"sub"}


def test_replies():
    got = P.parse_reply(REPLY)
    assert [(c.path, c.kind) for c in got] == [("src/a.py", "full"), ("src/b.md", "full"), ("c.txt", "diff")]
    assert got[0].content == "x = 1\n" and got[1].content == "```\nin\n```\n" and got[2].hunks[0].lines == [" a", "-b", "+B"]
    assert P.parse_reply("<source>a/b.c</source>\n<document_contents>\nint x;\n</document_contents>")[0].content == "int x;\n"
    assert P.parse_reply("no files\n```py\nx\n```") == []


def test_hunks():
    h = P.parse_diff("--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n a\n-b\n+B".split("\n"))[0].hunks
    assert P.apply_hunks("a\nb\n", h) == ("a\nB\n", None)
    assert P.apply_hunks("z\nz\na  \r\nb\r\n", h) == ("z\r\nz\r\na  \r\nB\r\n", None)
    assert P.apply_hunks("q\n", h)[1] == "hunk 1 doesn't fit"
    assert [r[0] for r in P.diff_rows("a\nb", "a\nc")] == ["eq", "del", "ins"]


def test_apply_and_restore(tmp_path):
    (tmp_path / "c.txt").write_text("a\nb\n")
    ready = P.preview(str(tmp_path), P.parse_reply(REPLY) + [P.Change("../up", "full", "x"), P.Change("c.txt", "diff", None, [P.Hunk(1, [" a", "-B", "+C"])])])
    assert {p.path: p.ok for p in ready} == {"src/a.py": True, "src/b.md": True, "c.txt": True, "../up": False}
    assert dict(P.apply(str(tmp_path), ready))["c.txt"] == "written" and (tmp_path / "c.txt").read_text() == "a\nC\n"
    assert dict(P.apply(str(tmp_path), ready))["c.txt"] == "changed"
    P.restore(str(tmp_path))
    assert (tmp_path / "c.txt").read_text() == "a\nb\n" and not (tmp_path / "src/a.py").exists()


def test_tree_drawing():
    assert tree_lines(["a/b", "c", "a/d/e"]) == ["├── a/", "│   ├── d/", "│   │   └── e", "│   └── b", "└── c"]


def test_pagerank(spark):
    edges = spark.createDataFrame([("a", "core", 1.0), ("b", "core", 2.0), ("core", "leaf", 1.0)], "src string, dst string, w double")
    nodes = spark.createDataFrame([("a",), ("b",), ("core",), ("leaf",)], "path string")
    got = {r.path: r["rank"] for r in O.pagerank(nodes, edges).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and got["leaf"] > got["core"] > got["a"]


def test_stream(spark, tmp_path):
    from corpusmill.streaming.watch import sessions, watch

    spark.createDataFrame([("src/a.rs",), (".git/x",)], "rel string").write.parquet(str(tmp_path / "in"))
    runs = []
    q = watch(spark.readStream.schema("rel string").parquet(str(tmp_path / "in")), lambda: runs.append(1), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert len(runs) == 2
    ev = spark.readStream.format("rate").load().selectExpr("value % 3 AS user_id", "timestamp AS ts")
    q = sessions(ev, "5 minutes", "1 hour").writeStream.format("memory").queryName("sessions").outputMode("append").start()
    assert q.isActive
    q.stop()
