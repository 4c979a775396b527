"""Main content of web pages as the maximum-scoring contiguous region (after Pasternack and Roth, 2009).

A page is a sequence of words and tags.  Words score positive, tags negative, with weights learned from labelled
pages; one linear scan finds the region of the highest sum.  All words between two tags have the same weight, so the
scan runs over the stretches of words and the tags, which gives the same region as a scan over single words.

Labelled pages are those with exactly one ``<article>`` or ``<main>`` element; its inside is the content.  These two tags
themselves carry no weight, neither in learning nor in extraction, so that pages without them are treated alike.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import hash60, map_arrow, per_batch, table

#: Labelled pages from which the weights are learned: about so many, those whose id hashes are lowest.
TRAIN_PAGES = 1500
LABEL_TAGS = ("article", "main")
WORD_WEIGHTS = (0.02, 0.05, 0.1, 0.2, 0.4, 0.8)
LEAST = 0.01

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|</?([A-Za-z][A-Za-z0-9:-]*)(?:\s[^>]*)?/?>", re.S | re.I)
_CLOSED = re.compile(r"</(script|style|noscript|template)\s*>\Z", re.I)
_BLOCK = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol br tr table section header footer nav blockquote pre title body article main aside td th dd dt dl form".split())


def stretches(html: str) -> list[tuple[str, str]]:
    """(kind, text) in order: kind '' for a stretch of words, else a tag's name, '/' before closing ones; comments are '!--'."""
    out: list[tuple[str, str]] = []
    at, end = 0, html.rfind(">") + 1
    # behind the last '>' no tag can end, so none is looked for; else each '<' there would be followed to the end
    for m in _TAG.finditer(html, 0, end):
        if m.start() > at and not (t := html[at : m.start()]).isspace():
            out.append(("", t))
        at = m.end()
        whole = m[0]
        name = (m[1] or m[2] or "!--").lower()
        out.append(("/" + name if whole.startswith("</") else name, ""))
        if at == end and (whole.startswith("<!--") and not (len(whole) > 6 and whole.endswith("-->")) or m[1] and not ((c := _CLOSED.search(whole)) and c[1].lower() == m[1].lower())):
            return out
    rest = html[at:]
    if (comment := rest.find("<!--")) >= 0:
        out += [("", rest[:comment])] if rest[:comment].strip() else []
        out.append(("!--", ""))
    elif rest and not rest.isspace():
        out.append(("", rest))
    return out


def label(parts: list[tuple[str, str]]) -> tuple[int, int] | None:
    """The range of parts inside the only labelling element, None if there isn't exactly one."""
    for tag in LABEL_TAGS:
        opens = [i for i, p in enumerate(parts) if p[0] == tag]
        closes = [i for i, p in enumerate(parts) if p[0] == "/" + tag]
        if len(opens) == 1 and len(closes) == 1 and opens[0] < closes[0]:
            return opens[0] + 1, closes[0]
    return None


def best_region(scores: list[float]) -> tuple[int, int]:
    """The range with the highest sum, by one scan; the first of equal ones, and of these the shortest; (0, 0) if none is positive."""
    best, found, run, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0.0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, found = run, (start, i + 1)
    return found


def score(parts: list[tuple[str, str]], weights: dict[str, float]) -> list[float]:
    """The score of each part; tags that weren't seen in learning get the weight '?'."""
    word, other = weights[""], weights["?"]
    return [word * len(t.split()) if k == "" else 0.0 if k.lstrip("/") in LABEL_TAGS else weights.get(k.lstrip("/"), other) for k, t in parts]


def learn(pages: list[str]) -> dict[str, float]:
    """Weights by tag name, '' for a word and '?' for unknown tags.

    A tag's weight is the log-odds of its share inside to its share outside of the content, at most -LEAST; the word
    weight is the one of WORD_WEIGHTS with the best mean F1 on the pages.  Without labelled pages all tags weigh -1 and words 0.2.
    """
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    labelled = []
    for page in pages:
        parts = stretches(page or "")
        if (r := label(parts)) is None:
            continue
        labelled.append((parts, r))
        for i, (k, t) in enumerate(parts):
            name = k.lstrip("/")
            if name not in LABEL_TAGS:
                (inside if r[0] <= i < r[1] else outside)[name] += len(t.split()) if k == "" else 1
    if not labelled:
        return {"": 0.2, "?": -1.0}
    names = {n for n in inside | outside if n}
    a, b = sum(inside.values()) + len(names), sum(outside.values()) + len(names)
    weights = {n: min(-LEAST, math.log((inside[n] + 1) / a) - math.log((outside[n] + 1) / b)) for n in sorted(names)}
    weights["?"] = min(-LEAST, math.log(1 / a) - math.log(1 / b), -1.0)
    best = (-1.0, 0.0)
    for w in WORD_WEIGHTS:
        f1 = sum(region_f1(p, best_region(score(p, weights | {"": w})), r) for p, r in labelled) / len(labelled)
        best = max(best, (f1, -w))
    return weights | {"": -best[1]}


def region_f1(parts: list[tuple[str, str]], got: tuple[int, int], want: tuple[int, int]) -> float:
    """F1 of the words in one range against those in another."""
    n = [len(t.split()) for _, t in parts]
    both = sum(n[max(got[0], want[0]) : max(max(got[0], want[0]), min(got[1], want[1]))])
    total = sum(n[got[0] : got[1]]) + sum(n[want[0] : want[1]])
    return 2 * both / total if total else 1.0


def extract(html: str | None, weights: dict[str, float]) -> tuple[str | None, int]:
    """(content, words): blocks on lines of their own, entities decoded, white space collapsed."""
    if html is None:
        return None, 0
    parts = stretches(html)
    a, b = best_region(score(parts, weights))
    lines: list[list[str]] = [[]]
    n = 0
    for k, t in parts[a:b]:
        if k == "":
            lines[-1] += (w := _html.unescape(t).split())
            n += len(w)
        elif k.lstrip("/") in _BLOCK and lines[-1]:
            lines.append([])
    return "\n".join(" ".join(x) for x in lines if x), n


def extract_content(pages: DataFrame, train_pages: int = TRAIN_PAGES, id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, text, n_words) for each row of ``pages``.

    The weights come from about ``train_pages`` labelled pages, those whose id hashes are lowest.  Null pages give null
    text and 0 words; pages in which no words outweigh the tags, empty ones among them, give the empty text.  Of regions with
    equal sums the first is taken, of these the shortest.  Repeated rows give repeated rows; pages are whole, however long, in time linear in
    their length; an empty table gives an empty result; other columns, whatever their names, are left out.
    """
    marked = pages.where(F.lower(html).rlike("<(article|main)[\\s>]"))
    n = marked.count()
    cut = int(min(1.0, train_pages / max(n, 1)) * (1 << 60))
    sample = sorted(r[0] for r in marked.where(hash60(id) < cut).select(html).collect())
    weights = learn(sample)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [extract(t, weights) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int32())], ["page_id", "text", "n_words"])

    kind = pages.schema[id].dataType.simpleString()
    return map_arrow(pages.select(F.col(id).alias("page_id"), F.col(html).cast("string").alias("html")), per_batch(run), f"page_id {kind}, text string, n_words int")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main content of every page."""
    return extract_content(table(spark, sf_dir, "pages"))
