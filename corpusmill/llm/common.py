"""What the operators share: tables, the shared folder, checked broadcasts, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch: documents are large rows, and each batch is held several times over in the JVM and in Python.
BATCH_BYTES = 8 << 20
#: Rows up to which the small side of a join is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it has fewer partitions than there are: a small table in one file can't be split by the scan."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df._jdf.queryExecution().toRdd().getNumPartitions() < n else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or in local mode a temporary one that is then set."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir isn't set; on a cluster it must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="corpusmill-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of tables that results may still read; they go when the driver ends.
_LEFT: set[str] = set()


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: lineage ends there and a lost executor loses nothing.

    The shuffle files that went into it are freed at once.  The table goes when the driver ends; one that is needed for a
    shorter time is made by a Workspace.
    """
    path = scratch(df.sparkSession, name)
    _LEFT.add(path)
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(path: str) -> None:
    fs, at = filesystem(path)
    try:
        fs.delete_dir(at)
    except OSError:
        pass
    _LEFT.discard(path)


@atexit.register
def _remove_all() -> None:
    for path in list(_LEFT):
        _remove(path)


class Workspace:
    """Intermediate tables: ``written`` ones are deleted where the ``with`` block ends, ``kept`` ones stay for the result."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            _remove(path)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        before = set(_LEFT)
        out = written(df, name)
        self.paths += _LEFT - before
        return out

    @staticmethod
    def kept(df: DataFrame, name: str) -> DataFrame:
        return written(df, name)

    def drop(self, *names: str) -> None:
        """Deletes the tables of these names that are no longer read."""
        gone = [p for p in self.paths if p.rsplit("/", 1)[-1].rpartition("-")[0] in names]
        self.paths = [p for p in self.paths if p not in gone]
        for p in gone:
            _remove(p)


def checked_broadcast(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else as it is: the join then shuffles."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= most else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name beginning with ``name`` that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, id: str = "doc_id", rows: int | None = None) -> DataFrame:
    """``docs`` without the rows whose ``id`` is in the only column of ``gone``; null ids stay, and columns may have any names."""
    name = fresh(docs, "gone")
    return docs.join(checked_broadcast(gone.toDF(name), rows), F.col(name) == docs[id], "left_anti")


def hash60(*parts: Column | str) -> Column:
    """A stable non-negative 60-bit hash of the parts' text, nulls as empty; in SQL the first 15 hex digits of the md5 of the parts joined by '|'."""
    text = F.concat_ws("|", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI or plain path."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def _release() -> None:
    """Gives the memory that a finished task has freed back to the system: workers live on, and else hold it beside the next task's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass  # another C library


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches of at most BATCH_BYTES, a lower limit that the session has stays; a task's memory is freed at its end."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(name).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            _release()

    return df.mapInArrow(run, schema)


def group_arrow(df: DataFrame, by: str, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``df.groupBy(by).applyInArrow`` for groups of many MB; a group's memory is freed at its end."""

    def run(group: pa.Table) -> pa.Table:
        try:
            return f(group)
        finally:
            _release()

    return df.groupBy(by).applyInArrow(run, schema)


def per_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow from one for a batch; empty results are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None and out.num_rows:
                yield out

    return run
