"""Frames written to the shared folder and read back, and what the planner knows of a frame's size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`. Only a single machine makes a temporary folder where that is unset; a cluster raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """`df` written once and read back, so that what was computed stays the same and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{purpose}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def planned_bytes(df: DataFrame) -> int:
    """The planner's estimate of a frame's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(spark: SparkSession) -> int:
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def hinted(left: DataFrame, right: DataFrame, hint: str) -> DataFrame:
    """`right` with a join hint where both sides are too large to broadcast; else the planner chooses."""
    return right.hint(hint) if min(planned_bytes(left), planned_bytes(right)) > broadcast_limit(left.sparkSession) else right


def spread(df: DataFrame) -> int:
    """Partitions for rows that give many more rows each: their bytes, by which the planner merges and splits, don't tell the work."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def all_pairs(left: DataFrame, right: DataFrame, key: list[str], hint: str) -> DataFrame:
    """Inner join where both sides may repeat a key. A side that the planner would broadcast, at most its limit, meets the other dealt
    over all tasks: a file of a few blocks would leave the pairs, many times its rows, to as many tasks. Else the hint holds.
    """
    sizes = planned_bytes(left), planned_bytes(right)
    if min(sizes) > broadcast_limit(left.sparkSession):
        return left.join(right.hint(hint), key, "inner")
    if sizes[0] > sizes[1]:
        return left.repartition(spread(left)).join(right.hint("broadcast"), key, "inner")
    return left.hint("broadcast").join(right.repartition(spread(right)), key, "inner")
