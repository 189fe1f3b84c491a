"""Sinks that watch a stream: its rows on the console, and a timing row for each of its batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery


def debug(stream: DataFrame, rows: int = 20) -> StreamingQuery:
    """Prints each batch's first rows; for people who watch, so it prints no more than `rows`."""
    return stream.writeStream.format("console").option("numRows", rows).option("truncate", False).outputMode("append").start()


class Metrics(StreamingQueryListener):
    """Keeps (query, batch, rows, milliseconds) of the last `keep` batches of all queries of a session.

    Register it with `spark.streams.addListener`.
    """

    def __init__(self, keep: int = 1000):
        self.keep, self.rows = keep, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows = [*self.rows, (p.name or str(p.id), p.batchId, p.numInputRows, p.batchDuration)][-self.keep :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
