"""Keeping an output fresh: a stream of changes, debounced by its trigger, each batch redoing the merge."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from corpusmill.functions.text import col, file_name


def relevant(rel: Column | str) -> Column:
    """Whether a change matters: nothing of version control, our own folder or outputs, or the desktop's."""
    r = col(rel)
    return ~(r.rlike(r"(^|/)(\.git|\.corpusmill)(/|$)") | r.endswith(".DS_Store") | F.contains(file_name(r), F.lit("_merged.")))


#: Nanoseconds.
SETTLED = 50_000_000


class Changes(DataSource):
    """``spark.readStream.format("changes").load(root)``: (rel, at) of the files written or removed since the last look, folders that are never entered left out."""

    @classmethod
    def name(cls) -> str:
        return "changes"

    def schema(self) -> str:
        return "rel string, at long"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Poll(self.options["path"])


class _Poll(SimpleDataSourceStreamReader):
    """Looks at the tree's times of change; the offset is the latest time seen.

    A file that is removed changes its folder's time, which is then the change; so an offset says enough to find a batch again.
    What is younger than SETTLED is left for the next look, as more may happen at the same tick of the clock.
    """

    def __init__(self, root: str) -> None:
        self.root = root

    def _seen(self) -> Iterator[tuple[str, int]]:
        from corpusmill.operators.classify import ScanOptions
        from corpusmill.sources.tree import skips_folder

        for here, folders, names in os.walk(self.root):
            folders[:] = [f for f in folders if not skips_folder(f, ScanOptions())]
            for name in ("", *names):
                path = os.path.join(here, name) if name else here
                try:
                    at = os.lstat(path).st_mtime_ns
                except OSError:
                    continue
                if at <= time.time_ns() - SETTLED:
                    yield os.path.relpath(path, self.root), at

    def initialOffset(self) -> dict:
        return {"at": max((at for _, at in self._seen()), default=0)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found = sorted((rel, at) for rel, at in self._seen() if at > start["at"])
        return iter(found), {"at": max((at for _, at in found), default=start["at"])}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(sorted((rel, at) for rel, at in self._seen() if start["at"] < at <= end["at"]))


def read_changes(spark: SparkSession, root: str) -> DataFrame:
    """The stream of changes of a tree."""
    spark.dataSource.register(Changes)
    return spark.readStream.format("changes").load(root)


class Progress(StreamingQueryListener):
    """Tells a function of a watch's events: ('started'), ('batch', its number and rows), ('error', what) or ('ended')."""

    def __init__(self, tell: Callable[..., None]) -> None:
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell("started")

    def onQueryProgress(self, event) -> None:
        self.tell("batch", event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.tell("error", event.exception) if event.exception else self.tell("ended")


def watch(changes: DataFrame, redo: Callable[[], None], checkpoint: str, interval: str = "300 milliseconds", rel: str = "rel") -> StreamingQuery:
    """Runs ``redo`` for each micro-batch with a relevant change; batches are serial, so no two runs overlap.

    The first run comes before the stream starts.
    """
    redo()

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            redo()

    return changes.where(relevant(rel)).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def sessions(events: DataFrame, gap: str, late: str, ts: str = "ts", key: str = "user_id") -> DataFrame:
    """Runs of events of a stream without a pause of ``gap``, with events up to ``late`` behind still counted."""
    from corpusmill.operators.corpus import debounced

    return debounced(events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late), gap, ts, key)
