"""Whole merges of small trees: inclusion, masking, propagation, formats, parts and round trips."""

from __future__ import annotations

import json
import subprocess
import xml.dom.minidom
from dataclasses import replace

import pytest

from corpusmill.operators import patch
from corpusmill.plans.merge import PRESETS, MergeOptions, merge, repo_map, scan_report, skill, write_skill
from corpusmill.rpc import handle
from corpusmill.sources import remote

TOKEN = "ghp_" + "a1B2c3D4e5F6" * 3


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "my proj"
    files = {
        "src/main.rs": "// hi\nfn main() { helper(); core(); }\n", "src/core.rs": "pub fn core() -> u8 { 1 }\n", "README.md": "text\n```\ncode\n```\n", "src/config.py": f"T = '{TOKEN}'\n",
        ".env": "A=1\n", "logins.md": "me@a.test: Zx81kQ!p0\npassword = rN7vB2#mQ9\n", "CHANGELOG.md": "rotated rN7vB2#mQ9 today\n", "web/vendor.min.js": "x", "package-lock.json": "{}", "old_merged.md": "x", "assets/img.dat": "\x89PNG",
    }
    for k, v in files.items():
        (root / k).parent.mkdir(parents=True, exist_ok=True)
        (root / k).write_bytes(v.encode("latin-1"))
    return root


def test_merge(spark, tree, tmp_path):
    r = merge(spark, str(tree), str(tmp_path / "out_merged"))
    text = open(r.parts[0]).read()
    assert TOKEN not in text and "rN7vB2#mQ9" not in text and "Zx81kQ!p0" not in text and "````" in text
    skips = dict(r.skips)
    assert {".env", "logins.md", "web/vendor.min.js", "package-lock.json", "old_merged.md", "assets/img.dat"} == set(skips) and skips["logins.md"] == "credential-dense file"
    assert r.merged == 5 and r.files == r.merged + len(r.skips) and ("src/config.py", "GitHub Token", 1) in r.redactions
    assert skill(str(tree), r).startswith("---\nname: my-proj\n")


def test_ignored_credentials(spark, tmp_path):
    """Stores that the scan passes over: by an ignore file, in a hidden folder, above the size of merged files."""
    tokens = ["Qm2Zx9Rt-Lp8Wb3nY-c6dHf1gJ-2kL5mN8pR", "Rn3Ay8Su-Mq7Xc4oZ-d5eIg2hK-3lM6nO9qS", "So4Bz7Tv-Nr6Yd5pA-e4fJh3iL-4mN7oP8rT", "Tp5Ca6Uw-Os5Ze6qB-f3gKi4jM-5nO8pQ7sU"]
    root = tmp_path / "gi"
    files = {
        ".gitignore": "MASTER_CREDENTIALS_*.md\nprivate/\n", "MASTER_CREDENTIALS_2026-07-03T1950Z.md": f"# creds\n\nSUPABASE_ACCESS_TOKEN={tokens[0]}\n", ".hid/secrets.yml": f"access_token: {tokens[1]}\n",
        "credentials.json": f"ACCESS_TOKEN={tokens[2]}\n" + "# filler\n" * 300_000, "private/.env": f"ACCESS_TOKEN={tokens[3]}\n", "NOTES.md": "".join(f"Deploy used {t} last night\n" for t in tokens),
    }
    for k, v in files.items():
        (root / k).parent.mkdir(parents=True, exist_ok=True)
        (root / k).write_text(v)
    r = merge(spark, str(root), str(tmp_path / "gi_merged"))
    text = open(r.parts[0]).read()
    assert not [t for t in tokens if t in text] and text.count("Deploy used [REDACTED] last night") == 4
    assert "## MASTER_CREDENTIALS" not in text and r.merged == 2


def test_dense_code_and_counts(spark, tmp_path):
    """Code dense in credentials is left out as prose is, but its identifiers aren't harvested; each masked occurrence counts."""
    root = tmp_path / "dc"
    root.mkdir()
    (root / "seed.js").write_text("const p1 = { password: 'Zx81kQp0vv' };\nconst p2 = { password: 'Wq72mLs9bb' };\nconst helper_Name42 = 1;\n")
    (root / "app.py").write_text("import helper_Name42\n")
    (root / "keys.py").write_text("api_secret = 'rN7vB2mQ9xx'\n")
    (root / "NOTES.md").write_text("first rN7vB2mQ9xx then rN7vB2mQ9xx\n")
    r = merge(spark, str(root), str(tmp_path / "dc_merged"))
    text = open(r.parts[0]).read()
    assert dict(r.skips) == {"seed.js": "credential-dense file"} and "import helper_Name42" in text and "rN7vB2mQ9xx" not in text
    assert ("NOTES.md", "Propagated known secret", 2) in r.redactions


def test_reports(spark, tree, tmp_path):
    """What each format says about the merge; progress; the skill; and that nothing is left of one that fails."""
    (tree / "latin.txt").write_bytes("caf\xe9".encode("latin-1"))
    told = []
    r = merge(spark, str(tree), str(tmp_path / "m_merged"), progress=lambda what, n: told.append((what, n)))
    text = open(r.parts[0]).read()
    assert "### Decoding notes" in text and "latin.txt" in dict(r.notes) and f"### Skipped ({len(r.skips)})" in text and told == [("files", r.merged), ("part", 1)]
    assert "── latin.txt" in skill(str(tree), r) and r.parts[0] in skill(str(tree), r)
    assert open(write_skill(str(tree), r)).read().startswith("---\nname: my-proj\n")
    r = merge(spark, str(tree), str(tmp_path / "d_merged"), MergeOptions(format="documents"))
    text = open(r.parts[0]).read()
    assert text.startswith('<documents>\n<document index="1">\n<source>MERGE_INFO</source>') and f"{len(r.skips)} files skipped" in text and '<document index="2">' in text and text.count('index="1"') == 1
    assert "MERGE_INFO" not in {c.path for c in patch.parse_reply(text)}
    r = merge(spark, str(tree), str(tmp_path / "j_merged"), MergeOptions(format="json"))
    about = json.load(open(r.parts[0]))
    assert about["generator"] and about["source"].endswith("my proj") and about["secrets"] == r.secrets and about["note"] == ""

    def stop(what, n):
        if what == "part":
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        merge(spark, str(tree), str(tmp_path / "x_merged"), progress=stop)
    assert not list(tmp_path.glob("x_merged*"))
    report, total = scan_report(spark, str(tree))
    assert total.files == report.count() and {"src/main.rs", "README.md"} <= {x.rel for x in report.collect()}


@pytest.mark.parametrize("form", ["markdown", "documents"])
def test_round_trip(spark, tree, tmp_path, form):
    r = merge(spark, str(tree), str(tmp_path / "rt_merged"), MergeOptions(format=form, redact=False))
    got = {c.path: c.content for c in patch.parse_reply(open(r.parts[0], newline="").read())}
    for name in "src/core.rs README.md src/main.rs".split():
        assert got[name].rstrip("\n") == (tree / name).read_text().rstrip("\n")


def test_formats_and_parts(spark, tree, tmp_path):
    r = merge(spark, str(tree), str(tmp_path / "j_merged"), MergeOptions(format="json"))
    assert {f["path"] for f in json.load(open(r.parts[0]))["files"]} >= {"src/main.rs", "README.md"}
    r = merge(spark, str(tree), str(tmp_path / "x_merged"), MergeOptions(format="xml"))
    xml.dom.minidom.parse(r.parts[0])
    r = merge(spark, str(tree), str(tmp_path / "p_merged"), MergeOptions(format="plain", token_budget=20, ordering="important-last"))
    assert len(r.parts) > 1 and r.parts[0].endswith(f".part1-of-{len(r.parts)}.txt") and "===== README.md" in open(r.parts[-1]).read()
    r = merge(spark, str(tree), str(tmp_path / "l_merged"), replace(PRESETS["lean"], selection=("src/main.rs",), forced=("package-lock.json",)))
    text = open(r.parts[0]).read()
    assert "fn main() { ... }" in text and "// hi" not in text and r.merged == 2 and r.compressed == 1


def test_git_sections(spark, tree, tmp_path):
    """Uncommitted changes and commits at the end, masked like files."""
    wanted = MergeOptions(git_diff=True, git_log=3, ordering="important-last")
    r = merge(spark, str(tree), str(tmp_path / "g0_merged"), wanted)
    assert dict(r.skips)["GIT DIFF"] == dict(r.skips)["GIT LOG"] == "not a git repository" and r.merged == 5
    git = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "rotated rN7vB2#mQ9")
    other = "ghp_" + "z9Y8x7W6v5U4" * 3
    (tree / "src/core.rs").write_text(f"pub fn core() -> u8 {{ 2 }}\n// {other} rN7vB2#mQ9\n")
    r = merge(spark, str(tree), str(tmp_path / "g_merged"), wanted)
    text = open(r.parts[0]).read()
    assert other not in text and "rN7vB2#mQ9" not in text and "+pub fn core() -> u8 { 2 }" in text and r.merged == 7
    diff, log = text.index("\n## GIT DIFF (working tree vs HEAD)\n"), text.index("\n## GIT LOG (last 3 commits)\n")
    assert text.index("\n## README.md\n") < diff < log and text.index("\n## src/config.py\n") < diff and "rotated [REDACTED]" in text[log:]
    r = merge(spark, str(tree), str(tmp_path / "p_merged"), replace(wanted, token_budget=20))
    assert "GIT LOG" in open(r.parts[-1]).read()


def test_map(spark, tree):
    text = repo_map(spark, str(tree))
    assert "src/core.rs:\n│ pub fn core() -> u8" in text and text.index("src/core.rs") < text.index("src/main.rs")


def test_git_and_settings(tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    assert remote.git_diff(str(tmp_path / "x"))[1] == "not a git repository"
    (tmp_path / "a").write_text("1\n")
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "first")
    assert remote.git_diff(str(tmp_path))[1] == "no uncommitted changes" and "first" in remote.git_log(str(tmp_path), 5)[0]
    (tmp_path / "a").write_text("2\n")
    assert "+2" in remote.git_diff(str(tmp_path))[0]
    with remote.clone(str(tmp_path)) as c:
        assert open(f"{c}/a").read() == "1\n"
    (tmp_path / "corpusmill.toml").write_text('[extensions]\ninclude = ["foo"]\n[scanning]\nmax_file_size_mb = 1\n')
    o, w = remote.settings(str(tmp_path))
    assert o.text_extensions == ("foo",) and o.max_file_size == 1 << 20 and w is None
    (tmp_path / "corpusmill.toml").write_text("[broken")
    assert remote.settings(str(tmp_path))[1]


def test_rpc(tmp_path):
    calls = {"echo": lambda x: x, "fail": lambda: 1 / 0}
    assert handle("{", calls)["error"]["code"] == -32700 and handle('{"method":"x"}', calls) is None
    assert handle('{"id":1,"method":"x"}', calls)["error"]["code"] == -32601
    assert handle('{"id":1,"params":{"name":"echo","arguments":{"x":"a"}},"method":"tools/call"}', calls)["result"]["content"] == [{"type": "text", "text": "a"}]
    assert handle('{"id":1,"params":{"name":"fail"},"method":"tools/call"}', calls)["result"]["isError"]
    assert len(handle('{"id":1,"method":"tools/list"}', calls)["result"]["tools"]) == 4
