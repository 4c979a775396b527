"""Arrow functions that are made when first called, so that modules can be imported before there is a session."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch: texts are large rows, and a batch is held several times over in the JVM and in Python.
BATCH_BYTES = 8 << 20
#: Bytes of the texts, all of a row's together, from which one batch of a result is made.
PIECE_BYTES = 1 << 20


def vectorized(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    """Makes a function of pandas series one of columns; ``returns`` is its type in SQL."""

    def wrap(f: Callable) -> Callable[..., Column]:
        def call(*columns: Column | str) -> Column:
            bounded()
            return F.pandas_udf(f, returns)(*columns)

        call.__name__, call.__doc__ = f.__name__, f.__doc__
        return call

    return wrap


def arrow(returns: str, once: bool = False) -> Callable[[Callable], Callable[..., Column]]:
    """Makes a function of Arrow arrays one of columns; with ``once`` the plan keeps to one evaluation where a result is used several times."""

    def wrap(f: Callable) -> Callable[..., Column]:
        def call(*columns: Column | str) -> Column:
            bounded()
            made = F.arrow_udf(f, returns)
            return (made.asNondeterministic() if once else made)(*columns)

        call.__name__, call.__doc__ = f.__name__, f.__doc__
        return call

    return wrap


def bounded(spark: SparkSession | None = None) -> None:
    """Limits the session's Arrow batches to BATCH_BYTES; a lower limit that it has stays."""
    spark = spark or SparkSession.getActiveSession()
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark is not None:
        now = spark.conf.get(name).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
            spark.conf.set(name, str(BATCH_BYTES))
