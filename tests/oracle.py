"""Holds a query's rows against DuckDB's."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df) -> list:
    return sorted(repr(_plain(tuple(r))) for r in df.select(sorted(df.columns)).collect())


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def expected(sql: str, folder: str | None = None, **tables) -> list:
    c = duckdb.connect()
    for t in TABLES if folder else ():
        p = f"{folder}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    for k, v in tables.items():
        c.register(k, v)
    r = c.sql(sql)
    return sorted(repr(_plain(x)) for x in r.select(*[f'"{k}"' for k in sorted(r.columns)]).fetchall())
