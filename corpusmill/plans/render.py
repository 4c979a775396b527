"""Sections of the output formats as columns, and whole outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import col, fence, xml_escape


def _ended(text: Column) -> Column:
    """The text with a newline at its end."""
    return F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def markdown_section(rel: Column | str, lang: Column | str, text: Column | str) -> Column:
    """A heading and the fenced text."""
    t = col(text)
    return F.concat(F.lit("## "), col(rel), F.lit("\n\n"), fence(t), col(lang), F.lit("\n"), _ended(t), fence(t), F.lit("\n\n"))


def plain_section(rel: Column | str, text: Column | str) -> Column:
    """A ruled heading and the text."""
    return F.concat(F.lit("===== "), col(rel), F.lit(" =====\n"), _ended(col(text)), F.lit("\n"))


def xml_section(rel: Column | str, text: Column | str) -> Column:
    """An element with the escaped text."""
    return F.concat(F.lit('<file path="'), xml_escape(rel), F.lit('">\n'), xml_escape(text), F.lit("\n</file>"))


def document_section(index: Column | str, rel: Column | str, text: Column | str) -> Column:
    """A numbered document element with the text as it is."""
    return F.concat(
        F.lit('<document index="'), col(index).cast("string"), F.lit('">\n<source>'), col(rel),
        F.lit("</source>\n<document_contents>\n"), col(text), F.lit("\n</document_contents>\n</document>"),
    )


def tree_lines(paths: list[str]) -> list[str]:
    """A drawing of the folders and files, folders first."""

    def level(items: list[list[str]], before: str) -> list[str]:
        folders: dict[str, list[list[str]]] = {}
        names = []
        for p in items:
            if len(p) > 1:
                folders.setdefault(p[0], []).append(p[1:])
            else:
                names.append(p[0])
        entries = [(n, folders[n]) for n in sorted(folders)] + [(n, None) for n in names]
        out = []
        for i, (name, inner) in enumerate(entries):
            last = i == len(entries) - 1
            out.append(f"{before}{'└── ' if last else '├── '}{name}{'/' if inner else ''}")
            if inner:
                out += level(inner, before + ("    " if last else "│   "))
        return out

    return level([p.split("/") for p in paths], "")
