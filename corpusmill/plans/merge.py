"""A whole merge: a tree to parts of one rendered text with a report; and the repo map.

The only global steps are the secrets learned from all files, which every file is then searched for, and the packing, which
sees names and token counts alone.  Contents stay in the cluster until the parts are written.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from corpusmill.functions import names as N
from corpusmill.functions import text as T
from corpusmill.operators import corpus as O
from corpusmill.operators import redact as R
from corpusmill.operators import slim as S
from corpusmill.operators.classify import ScanOptions, name_verdict, sensitive_reason
from corpusmill.plans import render
from corpusmill.plans.storage import checkpoint
from corpusmill.sources import remote
from corpusmill.sources.bytes import decoded, text_like
from corpusmill.sources.tree import check_root, read_credentials, read_tree

GENERATOR = "corpusmill"
FORMATS = {"markdown": "md", "plain": "txt", "xml": "xml", "documents": "xml", "json": "json"}
MOST_SKIPS, MOST_SHOWN_DEFINITIONS, FALLBACK_PATHS = 1000, 40, 20
DENSE_REASON = "credential-dense file"
#: Reasons of ``sensitive_reason`` for files whose values may recur in text; keys and certificates don't.
HARVESTED = ("env file (may hold credentials)", "credential store", "credential/secret data file")


@dataclass(frozen=True)
class MergeOptions:
    """What a merge does with the files it takes in."""

    format: str = "markdown"
    ordering: str = "path"
    redact: bool = True
    comments: bool = True
    bodies: bool = True
    omit_base64: bool = False
    drop_blank_lines: bool = False
    token_budget: int | None = None
    selection: tuple[str, ...] | None = None
    forced: tuple[str, ...] = ()
    #: Sections of git at the end: the uncommitted changes, and so many of the last commits.
    git_diff: bool = False
    git_log: int = 0


PRESETS = {
    "lean": MergeOptions(comments=False, bodies=False, omit_base64=True, drop_blank_lines=True),
    "claude": MergeOptions(format="documents", ordering="important-last"),
    "archive": MergeOptions(redact=True),
    "docs": MergeOptions(ordering="entry-first", bodies=True),
}


@dataclass
class MergeResult:
    """Totals, the parts' paths, skips and what was masked."""

    files: int
    merged: int
    tokens: int
    secrets: int
    compressed: int
    parts: list[str] = field(default_factory=list)
    skips: list[tuple[str, str]] = field(default_factory=list)
    redactions: list[tuple[str, str, int]] = field(default_factory=list)
    #: (path, note) of texts that had to be decoded otherwise than from plain UTF-8, and the paths merged.
    notes: list[tuple[str, str]] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)


def scan(spark: SparkSession, root: str, scan_options: ScanOptions = ScanOptions()) -> DataFrame:
    """(rel, name, size, content, verdict, reason): every file of the tree, classified; bytes decide where names don't."""
    files = read_tree(spark, root, scan_options).withColumn("v", name_verdict("name", "size", scan_options))
    sniffed = text_like(F.when(F.col("v.verdict") == "sniff", F.col("content")))
    verdict = F.when(F.col("v.verdict") != "sniff", F.col("v.verdict")).when(F.col("content").isNull(), "unreadable").when(sniffed, "text").otherwise("binary")
    reason = F.when(F.col("v.verdict") != "sniff", F.col("v.reason")).when(F.col("content").isNull(), "unreadable").when(~sniffed, "binary content")
    return files.select("rel", "name", "size", "content", verdict.alias("verdict"), reason.alias("reason"))


def git_sections(root: str, options: MergeOptions) -> tuple[list[tuple[str, str, str]], list[tuple[str, str]]]:
    """(name, lang, text) of the sections of git asked for, and (name, reason) of those there is nothing for."""
    found, skips = [], []
    if options.git_diff:
        text, note = remote.git_diff(root)
        found += [("GIT DIFF (working tree vs HEAD)", "diff", text)] if text else []
        skips += [] if text else [("GIT DIFF", note)]
    if options.git_log > 0:
        text, note = remote.git_log(root, options.git_log)
        found += [(f"GIT LOG (last {options.git_log} commits)", "", text)] if text else []
        skips += [] if text else [("GIT LOG", note or "no commits")]
    return found, skips


def blocks(spark: SparkSession, root: str, options: MergeOptions = MergeOptions(), scan_options: ScanOptions = ScanOptions()) -> tuple[DataFrame, DataFrame]:
    """(blocks, skips): (rel, lang, text, tokens, note, events, compressed, git) of the files merged, and (rel, reason) of the rest.

    Sections of git are blocks as well, with ``git`` their number from 1, 0 for files; they are masked as files are.
    """
    scanned = scan(spark, root, scan_options)
    if options.selection is not None:
        chosen = spark.createDataFrame([(r,) for r in options.selection], "rel string")
        scanned = scanned.where("verdict <> 'text'").unionByName(O.select_files(scanned.where("verdict = 'text'"), chosen))
    if options.forced:
        forced = F.col("rel").isin(*options.forced) & F.col("content").isNotNull()
        scanned = scanned.withColumn("verdict", F.when(forced, "text").otherwise(F.col("verdict"))).withColumn("reason", F.when(~forced, F.col("reason")))
    scanned = checkpoint(scanned)
    text = scanned.where("verdict = 'text'").withColumn("d", decoded("content")).select("rel", "name", T.extension("name").alias("lang"), F.col("d.text").alias("raw"), F.col("d.note").alias("note"))
    text = checkpoint(text.withColumn("dense", R.density("raw") >= R.DENSE))
    kept = text.where("NOT dense")
    body = F.col("raw")
    slimmed = kept.withColumn("s", S.slim("lang", body)) if not (options.comments and options.bodies) else kept.withColumn("s", F.struct(body.alias("text"), F.lit(False).alias("compressed")))
    body = F.col("s.text")
    if options.omit_base64:
        body = T.omit_base64(body)
    if options.drop_blank_lines:
        body = T.drop_blank_lines(body)
    made = slimmed.select("rel", "lang", "note", body.alias("text"), F.col("s.compressed").alias("compressed"), F.lit(0).alias("git"))
    sections, missing = git_sections(root, options)
    if sections:
        rows = [(name, lang, None, t, False, i + 1) for i, (name, lang, t) in enumerate(sections)]
        made = made.unionByName(spark.createDataFrame(rows, "rel string, lang string, note string, text string, compressed boolean, git int"))
    if options.redact:
        made = made.withColumn("r", R.redacted(F.col("text"))).select("rel", "lang", "note", "compressed", "git", F.col("r.text").alias("text"), F.col("r.events").alias("events"))
        made = checkpoint(made)
        stores = scanned.where(sensitive_reason("name").isNotNull() & F.col("content").isNotNull()).select(decoded("content")["text"].alias("raw"))
        # those that the scan passes over, by ignore files, hidden folders or size, are never merged but learned from
        apart = read_credentials(spark, root).where(sensitive_reason("name").isin(*HARVESTED) & F.col("content").isNotNull())
        stores = checkpoint(stores.union(apart.select(decoded("content")["text"].alias("raw"))))
        everything = text.select("raw").union(stores)
        known = everything.select(F.explode(R.labelled_values("raw")).alias("token")).distinct()
        bare = text.where(F.col("dense") & F.col("lang").isin(*sorted(R.PROSE))).select("raw").union(stores).select(F.explode(R.dense_tokens("raw")).alias("token"))
        few = O.known_in_few(bare, made, known).select("token")
        before = [c for c in made.columns if c != "events"]
        made = O.propagate(made, known.union(few), hits="hits")
        event = F.array(F.struct(F.lit("Propagated known secret").alias("rule"), F.col("hits").alias("n")))
        made = made.select(*before, F.when(F.col("hits") > 0, F.concat("events", event)).otherwise(F.col("events")).alias("events"))
    else:
        made = made.withColumn("events", F.array().cast(R.EVENTS))
    made = checkpoint(made.withColumn("tokens", T.token_estimate("text")))
    skips = scanned.where("verdict <> 'text'").select("rel", "reason").union(text.where("dense").select("rel", F.lit(DENSE_REASON)))
    if missing:
        skips = skips.union(spark.createDataFrame(missing, "rel string, reason string"))
    return made, skips


def scan_report(spark: SparkSession, root: str, scan_options: ScanOptions = ScanOptions()) -> tuple[DataFrame, Row]:
    """((rel, size, tokens) of every file that a merge would take, by path; and a row with files, bytes and tokens in all)."""
    text = scan(spark, check_root(root), scan_options).where("verdict = 'text'")
    report = checkpoint(text.select("rel", "size", T.token_estimate(decoded("content")["text"]).alias("tokens")))
    total = report.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    return report.orderBy(*O.path_order()), total


def cancel(spark: SparkSession, tag: str) -> None:
    """Stops what runs under ``spark.addTag(tag)``; a merge that is stopped deletes the parts that it has written."""
    spark.interruptTag(tag)


def merge(
    spark: SparkSession, root: str, out: str, options: MergeOptions = MergeOptions(), scan_options: ScanOptions = ScanOptions(), progress: Callable[[str, int], None] | None = None
) -> MergeResult:
    """Writes the merge of a tree to ``out`` (a path without extension) and its parts, and returns its totals.

    ``progress`` is told of each step and how far it is: the files read, and each part's number.  If anything fails or the work is cancelled, the
    parts written so far are deleted.
    """
    written: list[str] = []
    try:
        return _merge(spark, check_root(root), out, options, scan_options, progress or (lambda what, n: None), written)
    except BaseException:
        for path in written:
            if os.path.exists(path):
                os.remove(path)
        raise


def _merge(spark: SparkSession, root: str, out: str, options: MergeOptions, scan_options: ScanOptions, progress: Callable[[str, int], None], written: list[str]) -> MergeResult:
    made, skips = blocks(spark, root, options, scan_options)
    order = [F.col("git"), *O.read_order(options.ordering)]
    packed = O.pack(made, options.token_budget or 1 << 60, *order).join(made.select("rel", "git"), "rel")
    ordered = made.join(packed.select("rel", "part"), "rel").withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    section = {
        "markdown": render.markdown_section("rel", "lang", "text"),
        "plain": render.plain_section("rel", "text"),
        "xml": render.xml_section("rel", "text"),
        # the first part begins with a document about the merge
        "documents": render.document_section(F.col("i") + F.when(F.col("part") == 1, 1).otherwise(0), "rel", "text"),
        "json": F.to_json(F.struct(F.col("rel").alias("path"), F.col("lang").alias("language"), "tokens", F.col("text").alias("content"))),
    }[options.format]
    n_events = F.aggregate("events", F.lit(0), lambda a, e: a + e["n"])
    total = made.agg(F.count(F.lit(1)).alias("merged"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(n_events), F.lit(0)).alias("secrets"), F.count_if("compressed").alias("compressed")).first()
    skipped = [tuple(r) for r in skips.orderBy("rel").collect()]
    events = [tuple(r) for r in made.select("rel", F.explode("events").alias("e")).select("rel", "e.rule", "e.n").orderBy("rel", "rule").collect()]
    notes = [tuple(r) for r in made.where("note IS NOT NULL").select("rel", "note").orderBy("rel").collect()]
    result = MergeResult(total.merged + len(skipped), total.merged, total.tokens, total.secrets, total.compressed, written, skipped, events, notes)
    progress("files", total.merged)
    n_parts = packed.agg(F.max("part")).first()[0] or 1
    name, ext = os.path.basename(root), FORMATS[options.format]
    os.makedirs(os.path.dirname(os.path.abspath(out)) or ".", exist_ok=True)
    result.paths = [r.rel for r in packed.orderBy("part", *order).select("rel").collect()]
    first = [r.rel for r in packed.where("part = 1").orderBy(*order).select("rel").collect()]
    # sorted by part and place once; each part is then a range of it
    ordered = checkpoint(ordered.select("part", "i", section.alias("section")).orderBy("part", "i"))
    for p in range(1, n_parts + 1):
        path = f"{out}.{ext}" if n_parts == 1 else f"{out}.part{p}-of-{n_parts}.{ext}"
        rows = (r[0] for r in ordered.where(F.col("part") == p).orderBy("i").select("section").toLocalIterator())
        written.append(path)
        progress("part", p)
        with open(path, "w", newline="") as f:
            f.write(_head(options.format, name, result, p, n_parts, first, root))
            for i, s in enumerate(rows):
                f.write((",\n" if options.format == "json" and i else "") + s + ("\n" if options.format in ("xml", "documents") else ""))
            f.write(_tail(options.format, result))
    return result


def _head(kind: str, name: str, r: MergeResult, p: int, n: int, first: list[str], root: str) -> str:
    part = f" — part {p} of {n}" if n > 1 else ""
    if kind == "markdown":
        top = f"# {name}{part}\n\n> files: {r.files} · merged: {r.merged} · tokens: ~{r.tokens}\n\n---\n\n"
        if p > 1:
            return top
        contents = "\n".join(f"- [{x}](#{''.join(c for c in x.lower().replace(' ', '-') if c.isascii() and (c.isalnum() or c == '-'))})" for x in first)
        drawing = "\n".join(render.tree_lines(first))
        return top + f"## Files\n\n```\n{drawing}\n```\n\n## Contents\n\n{contents}\n\n"
    if kind == "plain":
        return f"{name}{part}\nfiles: {r.files}, merged: {r.merged}, tokens: ~{r.tokens}\n\n"
    if kind == "xml":
        return f'<?xml version="1.0" encoding="UTF-8"?>\n<codebase name="{name}" part="{p}" parts="{n}">\n'
    if kind == "documents":
        if p > 1:
            return "<documents>\n"
        about = [f"{name}{part}", f"files: {r.files}, merged: {r.merged}, tokens: ~{r.tokens}", "", *render.tree_lines(first), *([f"{len(r.skips)} files skipped"] if r.skips else [])]
        return '<documents>\n<document index="1">\n<source>MERGE_INFO</source>\n<document_contents>\n' + "\n".join(about) + "\n</document_contents>\n</document>\n"
    about = {"generator": GENERATOR, "source": root, "note": part.strip(" —"), "secrets": r.secrets}
    return json.dumps(about | {"project": name, "part": p, "parts": n, "merged": r.merged, "tokens": r.tokens})[:-1] + ', "files": [\n'


def _tail(kind: str, r: MergeResult) -> str:
    shown = r.skips[:MOST_SKIPS]
    if kind == "documents":
        return "</documents>\n"
    if kind == "json":
        return '\n], "skipped": ' + json.dumps([{"path": a, "reason": b} for a, b in r.skips]) + "}\n"
    lines = [f"merged {r.merged} of {r.files} files, ~{r.tokens} tokens"] + [f"{n} {what}" for n, what in ((r.secrets, "secrets masked"), (r.compressed, "files compressed")) if n]
    if kind == "xml":
        from xml.sax.saxutils import escape, quoteattr

        return "<report>\n" + "".join(f"<line>{escape(x)}</line>\n" for x in lines) + "".join(f"<skip path={quoteattr(a)}>{escape(b or '')}</skip>\n" for a, b in shown) + "".join(f"<note path={quoteattr(a)}>{escape(b)}</note>\n" for a, b in r.notes) + "</report>\n</codebase>\n"
    out = "\n".join(("## Report", "", *(f"- {x}" for x in lines), "")) if kind == "markdown" else "\n".join(("===== report =====", *lines, ""))
    if r.skips:
        out += (f"\n### Skipped ({len(r.skips)})\n\n" if kind == "markdown" else f"\nskipped ({len(r.skips)}):\n") + "".join(f"- {a} — {b}\n" for a, b in shown)
        if len(r.skips) > MOST_SKIPS:
            out += f"- … and {len(r.skips) - MOST_SKIPS} more\n"
    if r.redactions:
        out += ("\n### Masked\n\n" if kind == "markdown" else "\nmasked:\n") + "".join(f"- {a}: {n} × {b}\n" for a, b, n in r.redactions)
    if r.notes:
        out += ("\n### Decoding notes\n\n" if kind == "markdown" else "\ndecoding notes:\n") + "".join(f"- {a} — {b}\n" for a, b in r.notes)
    return out


def repo_map(spark: SparkSession, root: str, budget: int = 1024, scan_options: ScanOptions = ScanOptions()) -> str:
    """The most referred-to files with their definitions' signatures, best first, as many as fit the tokens."""
    budget = max(budget, 64)
    files = scan(spark, check_root(root), scan_options).where("verdict = 'text'").withColumn("d", decoded("content")).where("d.note IS NULL")
    tagged = checkpoint(files.select(F.col("rel").alias("path"), S.tagged(T.extension("name"), "d.text").alias("t")))
    defs = tagged.select("path", F.explode("t.defs").alias("d")).select("path", "d.name")
    refs = tagged.select("path", F.explode("t.refs").alias("name"))
    ranks = O.pagerank(tagged.select("path"), O.reference_edges(defs, refs))
    shown = F.slice(F.transform("t.defs", lambda d: F.concat(F.lit("│ "), d["sig"])), 1, MOST_SHOWN_DEFINITIONS)
    entry = F.concat(F.col("path"), F.lit(":\n"), F.array_join(shown, "\n"), F.lit("\n"))
    entries = ranks.join(tagged.where(F.size("t.defs") > 0), "path").select("path", "rank", entry.alias("entry"), T.token_estimate(entry).alias("cost"))
    head = "# Map of " + os.path.basename(root) + "\n\n"
    best = [F.round("rank", 12).desc(), F.col("path")]
    taken = O.pack_best(entries, budget - len(head) // 4, *best)
    out = [r.entry for r in taken.orderBy(*best).collect()]
    beyond = entries.count() - len(out)
    if out and beyond:
        out.append(f"… {beyond} more files beyond the token budget\n")
    if not out:
        out = [r.path + "\n" for r in ranks.orderBy(*best).limit(FALLBACK_PATHS).collect()]
    return head + "\n".join(out)


def skill(root: str, result: MergeResult) -> str:
    """A skill file for a merge: front matter, totals, outputs, how to make them again, and the tree."""
    name = os.path.basename(os.path.realpath(root))
    slug = "".join(c if c.isascii() and c.isalnum() else "-" for c in name.lower()).strip("-") or "project"
    outputs = "\n".join(f"- `{p}`" for p in result.parts)
    drawing = "\n".join(render.tree_lines(sorted(result.paths)))
    return (
        f"---\nname: {slug}\ndescription: Context of {name}. Use when working on its code.\n---\n\n# {name}\n\n{result.merged} files, ~{result.tokens} tokens, made {time.strftime('%Y-%m-%d')}:\n\n{outputs}\n\n"
        f'Again: `python -m corpusmill merge "{root}"`. An overview: `python -m corpusmill map "{root}"`.\n\n## Structure\n\n```\n{drawing}\n```\n'
    )


def write_skill(root: str, result: MergeResult) -> str:
    """Writes ``skill`` into the tree's folder of skills and returns the path."""
    name = "".join(c for c in os.path.basename(os.path.realpath(root)) if c.isascii() and (c.isalnum() or c in "._- ")).strip(". ")[:64] or "project"
    folder = os.path.join(root, ".claude", "skills", name)
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "SKILL.md"), "w") as f:
        f.write(skill(root, result))
    return os.path.join(folder, "SKILL.md")


def watch_tree(spark: SparkSession, root: str, out: str, options: MergeOptions = MergeOptions(), scan_options: ScanOptions = ScanOptions(), interval: str = "300 milliseconds") -> StreamingQuery:
    """Keeps a merge fresh in the folder ``out``: one output of a name that stays, written over after each change in the tree."""
    from corpusmill.streaming.watch import read_changes, watch

    name = os.path.basename(os.path.realpath(root))
    target = os.path.join(out, f"{name}_watch_merged")
    return watch(read_changes(spark, root), lambda: merge(spark, root, target, options, scan_options), os.path.join(out, f".{name}_watch"), interval)
