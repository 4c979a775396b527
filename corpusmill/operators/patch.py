"""Replies and diffs: parsing, line diffs, hunks, and applying changes to a tree under guard."""

from __future__ import annotations

import difflib
import hashlib
import json
import os
import re
import shutil
import time
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions.udf import vectorized
from corpusmill.sources.bytes import SNIFF, is_binary

MOST_LINES = 4000
CHANGE = "struct<path:string,kind:string,content:string,hunks:array<struct<old_start:int,lines:array<string>,no_eol:boolean>>,ord:int>"


@dataclass
class Hunk:
    """A hunk: its stated line and its lines, each with ' ', '-' or '+' before it."""

    old_start: int
    lines: list[str]
    no_eol: bool = False


@dataclass
class Change:
    """A proposed change: kind full, diff or delete."""

    path: str
    kind: str
    content: str | None = None
    hunks: list[Hunk] = field(default_factory=list)


_FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})([^`]*)$")
_HEADER = re.compile(r"^\s*(?:#{1,6}\s+)?(?:\*\*)?\s*(?:(?:file|path|filename):\s*)?(`[^`]+`|[^`*]+?)\s*(?:\*\*)?:?\s*$", re.I)
_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def header_path(line: str) -> str | None:
    """The path that a heading, bold or quoted line names, if it looks like one."""
    marked = bool(re.match(r"^\s*(#{1,6}\s|\*\*|`|(file|path|filename):)", line, re.I))
    m = _HEADER.match(line)
    if not marked or not m:
        return None
    quoted = m[1].startswith("`")
    path = m[1].strip("`").strip()
    if not path or len(path) > 300 or re.search(r'[<>"|?*]', path) or (not quoted and " " in path) or not re.search(r"[/.\\]", path):
        return None
    return path


def _diff_path(line: str) -> str | None:
    path = line[4:].split("\t")[0].strip()
    if path == "/dev/null":
        return None
    return path[2:] if path[:2] in ("a/", "b/") else path


def parse_diff(lines: list[str]) -> list[Change]:
    """The changes of a unified diff; hunk counts say how far a hunk goes."""
    out: list[Change] = []
    old: str | None = None
    i = 0
    while i < len(lines):
        line = lines[i]
        if line.startswith("--- ") and i + 1 < len(lines) and lines[i + 1].startswith("+++ "):
            old, new = _diff_path(line), _diff_path(lines[i + 1])
            out.append(Change(new or old or "", "delete" if new is None else "diff"))
            i += 2
        elif (m := _HUNK.match(line)) and out:
            left, right = int(m[2] or 1), int(m[4] or 1)
            hunk = Hunk(int(m[1]), [])
            i += 1
            while i < len(lines) and (left > 0 or right > 0 or lines[i].startswith("\\")):
                x = lines[i] if lines[i] else " "
                if x[0] == "\\":
                    hunk.no_eol = bool(hunk.lines) and hunk.lines[-1][0] != "-"
                elif x[0] in " -+":
                    left -= x[0] != "+"
                    right -= x[0] != "-"
                    hunk.lines.append(x)
                else:
                    break
                i += 1
            out[-1].hunks.append(hunk)
        else:
            i += 1
    return [c for c in out if c.path and (c.kind == "delete" or c.hunks)]


def parse_reply(text: str) -> list[Change]:
    """The changes that a reply proposes, in their order: fenced files under a heading with a path, diffs, and document elements."""
    if "\r\n" in text and text.count("\r\n") == text.count("\n"):
        text = text.replace("\r\n", "\n")
    lines = text.split("\n")
    out: list[Change] = []
    pending: str | None = None
    i = 0
    while i < len(lines):
        line = lines[i]
        if m := _FENCE.match(line):
            mark = m[1]
            close = re.compile(rf"^\s{{0,3}}{re.escape(mark[0])}{{{len(mark)},}}\s*$")
            j = next((k for k in range(i + 1, len(lines)) if close.match(lines[k])), len(lines))
            body = lines[i + 1 : j]
            if m[2].strip().lower() in ("diff", "patch") or (any(x.startswith("--- ") for x in body[:10]) and any(x.startswith("+++ ") for x in body[:10])):
                out += parse_diff(body)
            elif pending:
                out.append(Change(pending, "full", "\n".join(body) + ("\n" if body else "")))
            pending = None
            i = j + 1
        elif line.startswith("--- ") and i + 2 < len(lines) and lines[i + 1].startswith("+++ ") and lines[i + 2].startswith("@@"):
            j = next((k for k in range(i + 2, len(lines)) if _FENCE.match(lines[k])), len(lines))
            out += parse_diff(lines[i:j])
            i = j
        elif m := re.match(r"^\s*<source>(.*)</source>\s*$", line):
            path = m[1].strip()
            a = next((k for k in range(i + 1, min(i + 4, len(lines))) if lines[k].strip() == "<document_contents>"), None)
            b = next((k for k in range(a + 1, len(lines)) if lines[k].strip() == "</document_contents>"), None) if a is not None else None
            if b is not None:
                if path != "MERGE_INFO" and not path.startswith("GIT "):
                    out.append(Change(path, "full", "\n".join(lines[a + 1 : b]) + "\n"))
                i = b
            i += 1
        else:
            found = header_path(line)
            if found:
                pending = found
            elif line.strip() and not (pending and line.rstrip().endswith(":") and len(line) < 200):
                pending = None
            i += 1
    return out


def apply_hunks(old: str, hunks: list[Hunk]) -> tuple[str | None, str | None]:
    """(text, note): the hunks applied in order, each at its stated line or else at the first place after the last one; note says what didn't fit.

    Lines are compared without white space at their ends.  The text's line ends are kept.
    """
    crlf = "\r\n" in old
    plain = old.replace("\r\n", "\n")
    lines = plain.split("\n")
    ended = lines[-1] == ""
    if ended:
        lines.pop()
    out: list[str] = []
    at = 0
    touched_end = False
    for k, h in enumerate(hunks):
        want = [x[1:] for x in h.lines if x[0] != "+"]

        def fits(p: int, want: list[str] = want) -> bool:
            return 0 <= p and p + len(want) <= len(lines) and all(a.rstrip() == b.rstrip() for a, b in zip(lines[p : p + len(want)], want, strict=True))

        stated = max(at, min(h.old_start if not want else h.old_start - 1, len(lines)))
        if not want:
            p = stated
        elif h.old_start - 1 >= at and fits(h.old_start - 1):
            p = h.old_start - 1
        else:
            p = next((q for q in range(at, len(lines) - len(want) + 1) if fits(q)), -1)
        if p < 0:
            return None, f"hunk {k + 1} doesn't fit"
        out += lines[at:p]
        i = p
        for x in h.lines:
            if x[0] == " ":
                out.append(lines[i])
                i += 1
            elif x[0] == "-":
                i += 1
            else:
                out.append(x[1:])
        at = i
        touched_end = at >= len(lines)
    out += lines[at:]
    if touched_end:
        ended = not hunks[-1].no_eol
    text = "\n".join(out) + ("\n" if ended and out else "")
    return text.replace("\n", "\r\n") if crlf else text, None


def diff_rows(old: str, new: str) -> list[tuple[str, int | None, int | None, str]]:
    """(tag, old number, new number, text) of each line: eq, del or ins."""
    a, b = old.splitlines(), new.splitlines()
    rows: list[tuple[str, int | None, int | None, str]] = []
    for tag, i, i2, j, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag == "equal":
            rows += [("eq", i + k + 1, j + k + 1, a[i + k]) for k in range(i2 - i)]
        else:
            rows += [("del", k + 1, None, a[k]) for k in range(i, i2)]
            rows += [("ins", None, k + 1, b[k]) for k in range(j, j2)]
    return rows


def unified(old: str, new: str, path: str = "f") -> str:
    """A unified diff that ``apply_hunks`` takes back."""
    a, b = old.split("\n"), new.split("\n")
    ends = [x[-1] == "" for x in (a, b)]
    a, b = (x[:-1] if e else x for x, e in zip((a, b), ends, strict=True))
    body = list(difflib.unified_diff(a, b, f"a/{path}", f"b/{path}", lineterm=""))
    if not ends[1] and body:
        body.append("\\ No newline at end of file")
    return "\n".join(body)


@vectorized(f"array<{CHANGE}>")
def _parsed(reply: pd.Series) -> pd.Series:
    def rows(text: str | None) -> list[dict]:
        return [
            {"path": c.path, "kind": c.kind, "content": c.content, "hunks": [{"old_start": h.old_start, "lines": h.lines, "no_eol": h.no_eol} for h in c.hunks], "ord": i}
            for i, c in enumerate(parse_reply(text or ""))
        ]

    return reply.map(rows)


def parse_replies(replies: DataFrame, text: str) -> DataFrame:
    """``replies`` with ``change`` for each change that its text proposes."""
    return replies.withColumn("change", F.explode(_parsed(text)))


def diff_lines(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """``pairs`` with ``line`` (tag, old, new, text) for each line of their diff."""

    @vectorized("array<struct<tag:string,old:int,new:int,text:string>>")
    def rows(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("tag", "old", "new", "text"), r, strict=True)) for r in diff_rows(x or "", y or "")] for x, y in zip(a, b, strict=True)])

    return pairs.withColumn("line", F.explode(rows(old, new)))


def make_diffs(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """``pairs`` with ``diff``, a unified diff."""

    @vectorized("string")
    def made(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([unified(x or "", y or "") for x, y in zip(a, b, strict=True)])

    return pairs.withColumn("diff", made(old, new))


def apply_diffs(rows: DataFrame, old: str, diff: str) -> DataFrame:
    """``rows`` with ``applied`` (text, note): the diff's hunks applied."""

    @vectorized("struct<text:string,note:string>")
    def applied(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b, strict=True):
            changes = parse_diff((y or "").split("\n"))
            out.append(apply_hunks(x or "", changes[0].hunks) if changes else (x, None))
        return pd.DataFrame(out, columns=["text", "note"])

    return rows.withColumn("applied", applied(old, diff))


def revalidate(ready: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(key, state): what became of each file since its change was prepared, from (key, expected) and (key, hash)."""
    both = F.col("expected").isNotNull() & F.col("hash").isNotNull()
    state = F.when(both, F.when(F.col("expected") == F.col("hash"), "unchanged").otherwise("changed")).when(F.col("expected").isNotNull(), "disappeared").otherwise("appeared")
    return ready.join(now, key, "full_outer").select(key, state.alias("state"))


# ---- on a tree

BACKUPS = ".corpusmill/backups"


def safe_join(root: str, rel: str) -> str | None:
    """The path under the root, None if it would leave it."""
    rel = rel.replace("\\", "/")
    parts = [p for p in rel.split("/") if p not in ("", ".")]
    if not parts or rel.startswith("/") or ":" in rel or ".." in parts:
        return None
    return os.path.join(root, *parts)


@dataclass
class Preview:
    """What a file would become."""

    path: str
    action: str
    ok: bool
    note: str | None
    text: str | None
    base: str | None


def fold(path: str, data: bytes | None, folder: bool, changes: list[Change]) -> Preview:
    """What one file becomes by its changes in their order, each on what the one before left; deletions are shown and never done, binary files refused."""
    if safe_join("", path) is None:
        return Preview(path, "refuse", False, "path outside of the root", None, None)
    if folder:
        return Preview(path, "refuse", False, "is a folder", None, None)
    if data is not None and is_binary(data[:SNIFF]):
        return Preview(path, "refuse", False, "binary file", None, None)
    text = None if data is None else data.decode("utf-8", "replace")
    out = Preview(path, "create" if data is None else "modify", True, None, text, None if data is None else hashlib.sha256(data).hexdigest())
    for c in changes:
        if not out.ok:
            break
        if c.kind == "delete":
            out = Preview(path, "delete", False, "deletions are not carried out", None, out.base)
        elif c.kind == "full":
            new = (c.content or "").replace("\r\n", "\n")
            out.text = new.replace("\n", "\r\n") if out.text and "\r\n" in out.text else new
        else:
            made, note = apply_hunks(out.text or "", c.hunks)
            out = Preview(path, out.action, note is None, note, made, out.base)
    return out


def preview(root: str, changes: list[Change]) -> list[Preview]:
    """The changes folded by path, in the order in which the paths come."""
    by: dict[str, list[Change]] = {}
    for c in changes:
        by.setdefault(c.path, []).append(c)
    out = []
    for path, own in by.items():
        full = safe_join(root, path)
        data = open(full, "rb").read() if full and os.path.isfile(full) else None
        out.append(fold(path, data, bool(full) and os.path.isdir(full), own))
    return out


PREVIEW = "path string, action string, ok boolean, note string, text string, base string, identical boolean"


def previews(changes: DataFrame, state: DataFrame) -> DataFrame:
    """(path, action, ok, note, text, base, identical) of each path that is to be changed, from (path, ord, kind, content, hunks) and what is there: (path, content, folder).

    Proposals meet the files by a left join, and a path's changes are folded in their order; a path has few changes, so a group is small.
    """
    joined = changes.select("path", F.struct("ord", "kind", "content", "hunks").alias("change")).groupBy("path").agg(F.sort_array(F.collect_list("change")).alias("changes"))
    joined = joined.join(state.select("path", F.col("content").alias("data"), "folder"), "path", "left")

    @vectorized("struct<action:string,ok:boolean,note:string,text:string,base:string,identical:boolean>")
    def folded(path: pd.Series, data: pd.Series, folder: pd.Series, own: pd.Series) -> pd.DataFrame:
        rows = []
        for p, d, is_folder, cs in zip(path, data, folder, own, strict=True):
            made = [Change(p, c["kind"], c["content"], [Hunk(h["old_start"], list(h["lines"]), bool(h["no_eol"])) for h in (c["hunks"] if c["hunks"] is not None else [])]) for c in cs]
            held = None if d is None else bytes(d)
            r = fold(p, held, bool(is_folder) if is_folder is not None else False, made)
            same = r.ok and held is not None and r.text is not None and r.text.encode() == held
            rows.append((r.action, r.ok, r.note, r.text, r.base, same))
        return pd.DataFrame(rows, columns=["action", "ok", "note", "text", "base", "identical"])

    return joined.withColumn("p", folded("path", "data", "folder", "changes")).select("path", "p.*")


def accepted(pending: DataFrame, chosen: DataFrame, key: str = "path") -> DataFrame:
    """The pending changes that were accepted."""
    return pending.join(chosen.select(key).distinct(), key, "left_semi")


def paired(lines: DataFrame, *key: str, at: str = "at", tag: str = "tag") -> DataFrame:
    """``lines`` of diffs with ``run`` and ``pair``: in each run of changed lines the k-th deleted one stands beside the k-th inserted one; null for unchanged lines.

    A run is an island between unchanged lines, found by their running count.
    """
    w = Window.partitionBy(*key).orderBy(at)
    run = F.count_if(F.col(tag) == "eq").over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered = lines.withColumn("run", run)
    k = F.row_number().over(Window.partitionBy(*key, "run", tag).orderBy(at))
    changed = F.col(tag) != "eq"
    return numbered.withColumn("pair", F.when(changed, k)).withColumn("run", F.when(changed, F.col("run")))


def shown(lines: DataFrame, *key: str, at: str = "at", most: int = MOST_LINES) -> DataFrame:
    """The first ``most`` lines of each diff, with ``truncated``: whether it has more."""
    w = Window.partitionBy(*key)
    numbered = lines.withColumn("n_", F.row_number().over(w.orderBy(at))).withColumn("truncated", F.count(F.lit(1)).over(w) > most)
    return numbered.where(F.col("n_") <= most).drop("n_")


def apply(root: str, ready: list[Preview]) -> list[tuple[str, str]]:
    """(path, result) of each file: checked again, all backed up with a manifest, then written."""
    results, go = [], []
    for p in ready:
        full = safe_join(root, p.path)
        if not p.ok or full is None or p.text is None:
            results.append((p.path, p.note or "refused"))
            continue
        now = hashlib.sha256(open(full, "rb").read()).hexdigest() if os.path.exists(full) else None
        if now != p.base:
            results.append((p.path, "disappeared" if now is None else "appeared" if p.base is None else "changed"))
        else:
            go.append((p, full))
    if go:
        stamp = time.strftime("%Y%m%dT%H%M%S", time.gmtime()) + f"-{time.time_ns() % 10**9:09d}"
        store = os.path.join(root, BACKUPS, stamp)
        os.makedirs(store)
        for p, full in go:
            if p.base is not None:
                os.makedirs(os.path.dirname(to := os.path.join(store, "files", p.path)), exist_ok=True)
                shutil.copy2(full, to)
        with open(os.path.join(store, "manifest.json"), "w") as f:
            json.dump({"created_utc": stamp, "root": root, "entries": [{"path": p.path, "existed": p.base is not None} for p, _ in go]}, f)
        for p, full in go:
            try:
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "w", newline="") as f:
                    f.write(p.text)
                results.append((p.path, "written"))
            except OSError as e:
                results.append((p.path, f"failed: {e}"))
    return results


def restore(root: str) -> list[str]:
    """The paths put back from the newest backup, which stays."""
    store = os.path.join(root, BACKUPS)
    latest = os.path.join(store, max(os.listdir(store)))
    with open(os.path.join(latest, "manifest.json")) as f:
        entries = json.load(f)["entries"]
    for e in entries:
        full = safe_join(root, e["path"])
        if e["existed"]:
            shutil.copy2(os.path.join(latest, "files", e["path"]), full)
        elif os.path.exists(full):
            os.remove(full)
    return [e["path"] for e in entries]
