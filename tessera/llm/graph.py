"""Connected components over staged tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Edges up to which one task finds the components (16 bytes each); more are found by stars over the whole cluster.
LOCAL = 1_000_000


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for each node of `edges` (a long, b long).

    Up to LOCAL edges go to one task. Beyond it, alternating large and small stars: each round joins every node to the
    smallest node near it, until only stars remain. Rounds grow with the logarithm of the longest chain. Minima are
    aggregated before the shuffle and staged, so that a node with very many neighbours is a skewed join, which can be
    split, and never one task's group.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if now.count() <= LOCAL:
        return stage(now.coalesce(1).mapInArrow(_in_one_task, "node bigint, component bigint"), "components")
    while not _only_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large")
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        now = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def _only_stars(edges: DataFrame) -> bool:
    """Whether each u has one v and no v is a u."""
    one = edges.groupBy("u").agg(F.count("*").alias("n"), F.lit(False).alias("end"))
    ends = edges.select(F.col("v").alias("u")).distinct().select("u", F.lit(0).cast("long").alias("n"), F.lit(True).alias("end"))
    wrong = one.unionByName(ends).groupBy("u").agg(F.max("n").alias("n"), F.max("end").alias("end")).where("n > 1 or n > 0 and end")
    return wrong.isEmpty()


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest labels along edges, then along labels, until nothing changes."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    ends = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.int64)
    nodes, places = np.unique(ends, return_inverse=True)
    u, v = places.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)  # the roots too, so that trees hook onto trees
        np.minimum.at(label, label[v], low)
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[label] if len(nodes) else nodes, pa.int64())], names=["node", "component"])
