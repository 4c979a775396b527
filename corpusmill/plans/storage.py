"""Written tables in the folder that the cluster names: lineage ends there, and a lost executor loses nothing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: list[str] = []


@atexit.register
def _remove() -> None:
    for path in _OWN:
        shutil.rmtree(path, ignore_errors=True)


def shared_dir(df: DataFrame) -> str:
    """``spark.checkpoint.dir``; in local mode without one, a temporary folder that goes when the driver ends."""
    own = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    if not df.sparkSession.sparkContext.master.startswith("local[") and df.sparkSession.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir isn't set")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="corpusmill-"))
    return "file://" + _OWN[0]


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again; the shuffle files that went into it are freed at once."""
    path = f"{shared_dir(df)}/{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
