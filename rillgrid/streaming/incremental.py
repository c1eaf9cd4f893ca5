"""Files that arrive over time, worked through in batches that survive a restart (CTL-5, CTL-6)."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Tells of one query's batches while it runs: each as (batch, rows, seconds, rows a second), to report and in batches."""

    def __init__(self, name: str, report: Callable[[dict], None] | None = None):
        self.name, self.report = name, report
        self.batches: list[dict] = []
        self.run: str | None = None
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if event.name == self.name:
            self.run = str(event.runId)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if str(p.runId) == self.run and p.numInputRows:
            seconds = p.batchDuration / 1000
            told = {"batch": p.batchId, "rows": p.numInputRows, "seconds": seconds, "rate": p.numInputRows / max(seconds, 0.001)}
            self.batches.append(told)
            if self.report:
                self.report(told)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if str(event.runId) == self.run:
            self.ended.set()


def follow(spark: SparkSession, folder: str, schema: str, path: str, state: str, work: Callable[[DataFrame], DataFrame] = lambda rows: rows, key: str | None = None, files: int = 100, report: Callable[[dict], None] | None = None, name: str = "follow") -> list[dict]:
    """CTL-5, 6: work over all Parquet files of folder that no earlier run has finished, appended to the table at path; the batches of this run.

    A batch is at most so many files. The folder ``state``, shared like the table, keeps which files belong to
    which batch, the table's own log which files of it belong to finished batches: a run that is killed, in
    a batch or between two, is taken up by the next one, and no row is there twice or missing. work sees
    the rows of a batch and may do what a stream can; a failure in it ends the run after the batches before.
    Files are taken by their path: they must not change once they are there, but for one that could not be
    read. A folder without new files gives no batch; nulls pass; key partitions the table.
    """
    told = Progress(name, report)
    spark.streams.addListener(told)
    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
        sink = work(rows).writeStream.queryName(name).format("parquet").option("path", path).option("checkpointLocation", state)
        run = (sink.partitionBy(key) if key else sink).trigger(availableNow=True).outputMode("append").start()
        try:
            run.awaitTermination()
        finally:
            told.ended.wait(30)  # events come after the run, in order
    finally:
        spark.streams.removeListener(told)
    return told.batches
