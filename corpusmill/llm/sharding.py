"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A key's shard comes from the key alone: no ring table is kept, built or broadcast.
When shards are appended, from ``n`` to ``m``, only the fraction ``(m - n) / m`` of the
keys moves, and each moved key moves to one of the new shards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import hash60, table

SHARDS, GROWN = 64, 72


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, for a whole array at once; about ln(shards) passes over the keys that still jump."""
    key = keys.astype(np.uint64)
    b = np.zeros(len(key), dtype=np.int64)
    j = np.zeros(len(key), dtype=np.int64)
    left = np.arange(len(key))
    while len(left):
        b[left] = j[left]
        k = key[left] * np.uint64(2862933555777941757) + np.uint64(1)
        key[left] = k
        j[left] = np.floor((b[left] + 1) * (2147483648.0 / ((k >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        left = left[j[left] < shards]
    return b.astype(np.int32)


def assign_shards(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, into: str = "shard") -> DataFrame:
    """``df`` with the column ``into``: the shard, 0 to ``shards - 1``, of the text of ``key``.

    Only hashes travel to Python; other columns, long texts among them, stay in the JVM and nothing is shuffled.
    Null keys count as the empty text and share its shard.  Rows with the same key share a shard.  An empty table
    stays empty.  A column that is already named ``into`` is replaced; other columns are kept.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("int")
    def shard_of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(), shards))

    return df.withColumn(into, shard_of(hash60(key)))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 64, its shard once 8 more are appended, and whether it moves."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    both = assign_shards(assign_shards(docs, shards=SHARDS), shards=GROWN, into="shard_grown")
    return both.withColumn("moved", F.col("shard") != F.col("shard_grown"))


def sql_jump(keys: str, shards: int, name: str) -> str:
    """DuckDB CTEs that leave (doc_id, n, shard) in ``name``, for a relation ``keys`` of (doc_id, n, k)."""
    return f"""{name}_j(k, key, b, j) AS (
  SELECT DISTINCT k, k::HUGEINT, 0::BIGINT, 0::BIGINT FROM {keys}
  UNION ALL
  SELECT k, nk, j, floor((j + 1) * (2147483648.0::DOUBLE / ((nk // 8589934592)::DOUBLE + 1.0::DOUBLE)))::BIGINT
  FROM (SELECT k, (key * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS nk, j FROM {name}_j WHERE j < {shards})
), {name} AS (SELECT k, max(b)::INTEGER AS shard FROM {name}_j WHERE j >= {shards} GROUP BY k)"""


OP3_SQL = f"""WITH RECURSIVE keyed AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k FROM documents),
{sql_jump('keyed', SHARDS, 'a')}, {sql_jump('keyed', GROWN, 'z')}
SELECT doc_id, a.shard AS shard, z.shard AS shard_grown, a.shard <> z.shard AS moved
FROM keyed JOIN a USING (k) JOIN z USING (k)"""
