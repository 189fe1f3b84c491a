"""Rows that live for a tick: cleared, snapshotted or double-buffered; and state from down and up events.

The batch forms take a frame with a tick column and say what a reader sees at each tick. The streaming forms do the same
over micro-batches, a tick being a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

TICK = "tick"


def cleared(rows: DataFrame, tick: str = TICK) -> DataFrame:
    """A reader at a tick sees the rows of that tick."""
    return rows.withColumn("reader_tick", F.col(tick))


def double_buffered(rows: DataFrame, ticks: DataFrame, tick: str = TICK) -> DataFrame:
    """A reader at a tick sees exactly the rows of the tick before; `ticks` has the ticks there are."""
    known = ticks.select(F.col(tick).alias("reader_tick"))
    return rows.withColumn("reader_tick", F.col(tick) + 1).join(known, "reader_tick", "left_semi")


def snapshot(rows: DataFrame, at: int, tick: str = TICK) -> DataFrame:
    """What the reader of tick `at` sees of rows that accumulate: all of earlier ticks."""
    return rows.where(F.col(tick) < at).withColumn("reader_tick", F.lit(at))


@dataclass(frozen=True)
class PerTick:
    """Declares how a relation's rows live over ticks: 'clear', 'snapshot' or 'buffer' (the tick before, then cleared)."""

    rows: DataFrame
    kind: str
    tick: str = TICK

    def __post_init__(self):
        if self.kind not in ("clear", "snapshot", "buffer"):
            raise ValueError(f"no way of ticking named {self.kind}")

    def read(self, at: int) -> DataFrame:
        """The rows that a reader at tick `at` sees."""
        if self.kind == "snapshot":
            return snapshot(self.rows, at, self.tick)
        return self.rows.where(F.col(self.tick) == at - (self.kind == "buffer")).withColumn("reader_tick", F.lit(at))


def snapshot_counts(rows: DataFrame, tick: str = TICK) -> DataFrame:
    """tick, n_new, n_seen: rows put at each tick, and rows that its reader sees: all of earlier ticks.

    Rows are counted by tick first, so the running sum is over ticks only.
    """
    counts = rows.groupBy(tick).agg(F.count("*").alias("n_new"))
    return counts.withColumn("n_seen", F.expr(f"coalesce(sum(n_new) over (order by {tick} rows between unbounded preceding and 1 preceding), 0)"))


def latest_state(events: DataFrame, key: Sequence[str], order: Sequence[str], down: Column) -> DataFrame:
    """Keys whose last event is a `down` one."""
    last = events.groupBy(*key).agg(F.max_by(F.struct(down.alias("down")), F.struct(*order)).alias("last"))
    return last.where("last.down").select(*key)


def due(rows: DataFrame, deadline: str, now: Column) -> DataFrame:
    """Rows whose deadline has passed, the earliest first."""
    return rows.where(F.col(deadline) < now).orderBy(deadline)


class DoubleBuffer:
    """A foreachBatch sink that hands each batch's rows to `read` at the next batch, and nothing at the first.

    What was read is kept as a frame of the previous batch's own files, under `folder`, so a restart goes on from it.
    """

    def __init__(self, folder: str, read: Callable[[DataFrame, int], None]):
        self.folder, self.read = folder, read

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{self.folder}/{number}")
        if number:
            self.read(spark.read.schema(batch.schema).parquet(f"{self.folder}/{number - 1}"), number)


class PressedKeys(StatefulProcessor):
    """Holds for each key whether its last event was a down one; gives (key, down) whenever it is touched."""

    def init(self, handle) -> None:
        self._last = handle.getValueState("last", T.StructType([T.StructField("order", T.LongType()), T.StructField("down", T.BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        best = self._last.get() if self._last.exists() else None
        for part in rows:
            top = part.sort_values("order").iloc[-1]
            if best is None or int(top["order"]) > best[0]:
                best = (int(top["order"]), bool(top["down"]))
        self._last.update(best)
        yield pd.DataFrame({"key": [key[0]], "down": [best[1]]})

    def close(self) -> None:
        pass


def pressed_keys(events: DataFrame) -> DataFrame:
    """A stream of (key long, down boolean) changes from a stream of (key long, order long, down boolean).

    It needs the RocksDB state store provider.
    """
    return events.groupBy("key").transformWithStateInPandas(PressedKeys(), "key bigint, down boolean", "Update", "None")
