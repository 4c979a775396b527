"""Ignore files and globs as a table of regexes of which the last match decides."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    """A compiled line: ``regex`` matches relative paths, those under a matched folder too."""

    regex: str
    negated: bool
    folders_only: bool


def compile_pattern(line: str) -> Pattern:
    """One line of an ignore file.

    A slash before the end anchors it to the file's folder; a slash at the end limits it to folders; ``*`` and ``?`` stop at slashes,
    ``**`` doesn't; ``!`` takes back what earlier lines ignored.
    """
    negated = line.startswith("!")
    p = line[negated:]
    if p.startswith("\\"):
        p = p[1:]
    folders = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i) and (i == 0 or p[i - 1] == "/"):
            out, i = out + "(.*/)?", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + "/.+", i + 3
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
            while i < len(p) and p[i] == "*":
                i += 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and (end := p.find("]", i + 2)) > 0:
            body = p[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return Pattern(("^" if anchored else "(^|/)") + out + ("/" if folders else "(/|$)"), negated, folders)


def compile_lines(lines: Iterable[str]) -> list[Pattern]:
    """The patterns of a file; blank lines and comments are left out."""
    return [compile_pattern(s) for line in lines if (s := line.rstrip("\r\n").rstrip(" ")) and not s.startswith("#")]


def is_ignored(rel: str, patterns: list[Pattern], folder: bool = False) -> bool:
    """Whether the last pattern that matches a path ignores it; a pattern for folders matches what is under them."""
    path = rel + "/" if folder else rel
    return next((not p.negated for p in reversed(patterns) if re.search(p.regex, path)), False)


def ignored(files: DataFrame, lines: Iterable[str], rel: str = "rel") -> DataFrame:
    """``files`` with ``ignored``: as a join with the rules on their regexes and the last match, all in the JVM."""
    rules = compile_lines(lines)
    out = F.lit(False)
    for r in rules:
        out = F.when(F.col(rel).rlike(r.regex), not r.negated).otherwise(out)
    return files.withColumn("ignored", out)


def keep_globs(rel: str, include: list[Pattern], exclude: list[Pattern]) -> bool:
    """Whether a file passes: some include must match, if there is any, and no exclude."""
    return (not include or is_ignored(rel, include)) and not is_ignored(rel, exclude)
