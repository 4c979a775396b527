"""Mixing sources to target weights.

The tokens of each source are summed; a source's repetition rate is what brings its share of
the emitted tokens to its target weight.  A document is emitted ``floor(rate)`` times, and once
more with probability ``rate - floor(rate)``, decided by a hash of the seed and its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import checked_broadcast, fresh, hash60, table, written

#: Target weights are proportional to tokens ** TEMPER unless they are given.
TEMPER = 0.75
SEED = 17


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = TEMPER, total: float | None = None, text: str = "text", source: str = "source") -> DataFrame:
    """(source, tokens, rate), one row for each source that has tokens; null sources form one source of their own.

    ``weights``: target weights by source, in any unit; sources that aren't named get rate 0.  Without them a
    source's weight is its tokens to the power ``temper``.  ``total``: tokens to emit; without it the fewest for which no
    source with a weight has a rate under 1, so that no document is lost.  Rates are rounded to nine decimals.
    Texts that are null or without tokens count 0.
    """
    tokens = F.coalesce(F.regexp_count(F.col(text), F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("bigint")
    by = docs.select(F.col(source).cast("string").alias("source"), tokens.alias("tokens")).groupBy("source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    if weights is None:
        by = by.withColumn("weight", F.pow(F.col("tokens").cast("double"), F.lit(float(temper))))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        by = by.join(given, by.source.eqNullSafe(given.name), "left").select("source", "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    by = written(by, "mix-sources")
    sums = by.where("weight > 0").agg(F.max(F.col("tokens") / F.col("weight")).alias("scale"), F.sum("weight").alias("sum"))
    scale = F.col("scale") if total is None else F.lit(float(total)) / F.col("sum")
    return by.crossJoin(F.broadcast(sums)).select("source", "tokens", F.round(F.col("weight") * scale / F.col("tokens"), 9).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = TEMPER, total: float | None = None, seed: int = SEED, id: str = "doc_id", text: str = "text", source: str = "source", into: str = "copy") -> DataFrame:
    """``docs`` with each row emitted as often as its source's rate says; ``into`` numbers a row's copies from 1.

    Rows with the same id in one source share their fate.  Null ids count as the empty text.  Documents of a source
    without any token are emitted once: they weigh nothing.  A column that is already named ``into`` is replaced, all others are
    kept; an empty table stays empty; texts are counted whole; equal weights and repeated rows change nothing but the sums.
    The join with the rates moves no text while there are at most BROADCAST_ROWS sources; beyond that it shuffles.
    """
    name, rate_, n = fresh(docs, "mix_source"), fresh(docs, "mix_rate"), fresh(docs, "mix_copies")
    rates = written(source_rates(docs, weights, temper, total, text, source), "mix-rates").select(F.col("source").alias(name), F.col("rate").alias(rate_))
    joined = docs.join(checked_broadcast(rates), docs[source].cast("string").eqNullSafe(rates[name]), "left")
    rate = F.coalesce(F.col(rate_), F.lit(1.0))
    coin = hash60(F.lit(str(seed)), id).cast("double") / F.lit(float(1 << 60))
    copies = (F.floor(rate) + F.when(coin < rate - F.floor(rate), 1).otherwise(0)).cast("int")
    return joined.withColumn(n, copies).where(F.col(n) > 0).withColumn(into, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(name, rate_, n)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, copy) of every copy that the mixture emits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "copy")


def sql_mix(docs: str, name: str) -> str:
    """DuckDB CTEs that leave the columns of ``docs`` and ``copy`` in ``name``."""
    return f"""{name}_s AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')))::BIGINT AS tokens FROM {docs} GROUP BY source),
{name}_w AS (SELECT source, tokens, pow(tokens::DOUBLE, {TEMPER}::DOUBLE) AS weight FROM {name}_s WHERE tokens > 0),
{name}_r AS (SELECT source, round(weight * (SELECT max(tokens / weight) FROM {name}_w) / tokens, 9) AS rate FROM {name}_w),
{name}_n AS (SELECT d.*, coalesce(r.rate, 1.0) AS rate, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT::DOUBLE / 1152921504606846976.0::DOUBLE AS coin
  FROM {docs} d LEFT JOIN {name}_r r ON d.source IS NOT DISTINCT FROM r.source),
{name} AS (SELECT * EXCLUDE (rate, coin), unnest(range(1, 1 + (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT))::INTEGER AS copy FROM {name}_n)"""


OP6_SQL = f"WITH {sql_mix('documents', 'mixed')} SELECT doc_id, source, copy FROM mixed"
