"""Documents staged in blocks: rows of a few megabytes that hold many texts.

What belongs to a block (bit masks, wanted rows) is small and moves to the block; the texts stay where they were
written. The table is bucketed by block, so such a join shuffles the small side only. A task numbers its blocks so that
runs of them fall into one bucket: it writes a file for each run, not for each block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch_table, shared_dir, text_or_empty

#: Bytes of text in a block, except for a single text that is longer; blocks in a run; bytes in a bucket, about.
BLOCK_BYTES, RUN, BUCKET_BYTES = 4 << 20, 8, 64 << 20
#: Spark's own bound on buckets.
MOST_BUCKETS = 100_000
#: Bits of a row's number in its block, and of a block's number in its task.
_IDX_BITS, _BLOCK_BITS = 16, 24


def _bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that Spark's writer puts longs into: Murmur3 with 32 bits and seed 42, modulo the number of buckets."""
    u = np.uint32
    turn = lambda v, by: (v << u(by)) | (v >> u(32 - by))
    h = np.full(len(x), 42, u)
    for part in ((x & 0xFFFFFFFF).astype(u), (x >> 32).astype(u)):
        h = turn(h ^ (turn(part * u(0xCC9E2D51), 15) * u(0x1B873593)), 13) * u(5) + u(0xE6546B64)
    h ^= u(8)
    for by, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> u(by))) * u(factor)
    return (h ^ (h >> u(16))).view(np.int32).astype(np.int64) % buckets


def _numbers(partition: int, bucket: int, buckets: int) -> Iterator[int]:
    """Block numbers of a task that fall into one bucket."""
    step = 16 * buckets
    for start in range(0, 1 << _BLOCK_BITS, step):
        ids = (partition << _BLOCK_BITS) + np.arange(start, min(start + step, 1 << _BLOCK_BITS), dtype=np.int64)
        yield from ids[_bucket_of(ids, buckets) == bucket].tolist()


def _buckets(docs: DataFrame) -> int:
    """A number of buckets from the planner's estimate of the input's size; it changes the layout only."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_BUCKETS, max(least, -(-size // BUCKET_BYTES) if size < 1 << 60 else 0))


def stage_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """block long, bytes long (of text), keys array, texts array<string> (null: empty), written to the shared folder and read back.

    A block's number tells the partition that wrote it; it is fixed once the table is written.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    buckets = _buckets(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, done = TaskContext.get().partitionId(), 0
        numbers: dict[int, Iterator[int]] = {}
        for batch in batches:
            sizes = np.cumsum(pa.compute.binary_length(batch.column(1)).to_numpy().astype(np.int64))
            start = 0
            while start < batch.num_rows:
                base = sizes[start - 1] if start else 0
                end = min(max(start + 1, int(np.searchsorted(sizes, base + BLOCK_BYTES, "right"))), start + (1 << _IDX_BITS))
                keys, texts = batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start)
                offsets = pa.array([0, end - start], pa.int32())
                bucket = (partition + done // RUN * 7919) % buckets
                if bucket not in numbers:
                    numbers[bucket] = _numbers(partition, bucket, buckets)
                block = pa.array([next(numbers[bucket])], pa.int64())
                lists = [pa.ListArray.from_arrays(offsets, keys), pa.ListArray.from_arrays(offsets, texts)]
                held = pa.array([int(sizes[end - 1] - base)], pa.int64())
                yield pa.RecordBatch.from_arrays([block, held, *lists], names=["block", "bytes", "keys", "texts"])
                done, start = done + 1, end

    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    kinds = {"block": T.LongType(), "bytes": T.LongType(), "keys": T.ArrayType(kind), "texts": T.ArrayType(T.StringType())}
    cuts = rows.mapInArrow(cut, T.StructType([T.StructField(n, k) for n, k in kinds.items()]))
    name, path = f"tessera_blocks_{uuid.uuid4().hex}", shared_dir(spark, "blocks")
    cuts.write.option("path", path).option("compression", "zstd").bucketBy(buckets, "block").saveAsTable(name)
    scratch_table(path, name)
    out = spark.table(name)
    out.staged_at = path
    return out


def rows_of(blocks: DataFrame) -> DataFrame:
    """uid, key, text of each row; uid is a number of its own."""
    rows = blocks.select("block", F.posexplode(F.arrays_zip(F.col("keys").alias("key"), F.col("texts").alias("text"))).alias("i", "row"))
    return rows.select((F.shiftleft("block", _IDX_BITS) + F.col("i")).alias("uid"), "row.key", "row.text")


def fetch(blocks: DataFrame, wanted: DataFrame, with_keys: bool = False) -> DataFrame:
    """uid, text (and key) of the rows whose `uid` is in `wanted` (distinct). Only those rows leave their block."""
    lists = wanted.groupBy(F.shiftright("uid", _IDX_BITS).alias("block")).agg(F.collect_list("uid").alias("uids"))

    def row(uid: Column) -> Column:
        at = uid.bitwiseAND((1 << _IDX_BITS) - 1).cast("int")
        fields = [uid.alias("uid"), F.get("texts", at).alias("text")]
        return F.struct(*fields, F.get("keys", at).alias("key")) if with_keys else F.struct(*fields)

    found = blocks.join(lists, "block").select(F.explode(F.transform("uids", row)).alias("row"))
    return found.select("row.*")
