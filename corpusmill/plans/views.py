"""The documents as a tree of files; the same text is SQL for Spark and for DuckDB."""

from __future__ import annotations

_NAMES = (
    "doc_{}.rs", "doc_{}.py", "readme_{}.md", "doc_{}.min.js", "doc_{}.lock", "img_{}.png", ".env.{}", "key_{}.pem", "id_rsa_{}", "vault_{}.csv",
    "doc_{}.unknown", "notes_{}", "doc_{}_merged.md", "Doc_{}.TXT", "doc_{}.tsx", "doc_{}.svg", "a.{}.bundle.js", "doc_{}_merged.part1-of-2.xml", "cfg_{}.toml", "passwords_{}.json",
)
_FIXED = {20: "package-lock.json", 21: "makefile", 22: ".gitignore", 23: "secrets.yaml", 24: "main.py"}

#: The name of a document's file.
FILE_NAME = (
    f"(CASE doc_id % {len(_NAMES) + len(_FIXED)} "
    + " ".join(f"WHEN {i} THEN '{a}' || CAST(doc_id AS VARCHAR(20)) || '{b}'" for i, (a, b) in enumerate(n.split("{}") for n in _NAMES))
    + " "
    + " ".join(f"WHEN {i} THEN '{n}'" for i, n in _FIXED.items())
    + " END)"
)
#: DuckDB: the relation ``files``.
FILES = f"files AS (SELECT doc_id, source || '/' || lang || '/' || {FILE_NAME} AS rel, {FILE_NAME} AS name, strlen(text)::BIGINT AS size, text FROM documents)"
