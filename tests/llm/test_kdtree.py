from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import kdtree


def brute(rows, k):
    """(id, vector) rows -> sorted (query_id, rank, vec_id, score) rows; queries have ids divisible by 5."""
    good = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, x) in enumerate(good):
        if q is not None and q % 5 == 0:
            scored = [(-sum(a * b for a, b in zip(x, y)), i is None, i or 0, i) for m, (i, y) in enumerate(good) if m != n and len(y) == len(x)]
            out += [(q, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard, block, leaf", [(16_384, 1024, 64), (40, 7, 4)])
def test_brute_force(spark, monkeypatch, shard, block, leaf):
    for name, value in (("SHARD", shard), ("BLOCK", block), ("LEAF", leaf)):
        monkeypatch.setattr(kdtree, name, value)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(150)]
    rows += [(i, [0.5] * 6) for i in range(150, 220)] + [(7, [0.5] * 6), (300, [0.5] * 6), (300, [0.5] * 6)]  # ties and repeated rows
    rows += [(400, None), (405, []), (410, [1.0, None]), (415, [float("nan")] * 6), (420, [float("inf")] * 6), (None, [0.5] * 6), (425, [1.0, 2.0]), (426, [3.0, -1.0]), (430, [1.0, 2.0, 3.0])]
    rows += [(440, [3e6, 1e6, -2e6, 1.5, 0.1, 7.0])]  # beyond what sums of doubles hold exactly
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4).withColumn("score", F.lit("clash"))
    got = kdtree.top_k(df, F.col("vec_id") % 5 == 0, 4)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == brute(rows, 4)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    v, q = np.floor(rng.normal(size=(500, 5)) * 100), np.floor(rng.normal(size=(20, 5)) * 100)
    tree = kdtree.KdTree(v, 8)
    bounds, scores = tree.bounds(q), q @ tree.vectors.T
    for node, (a, b) in enumerate(tree.spans):
        assert (scores[:, a:b].max(axis=1) <= bounds[:, node]).all()


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert kdtree.top_k(df, F.col("vec_id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(100, [1.0])], "vec_id bigint, embedding array<float>")
    assert kdtree.top_k(one, F.col("vec_id") % 100 == 0).count() == 0


def test_sql(spark):
    import duckdb

    from tessera.llm import queries

    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view embeddings as select * from '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, queries.op6_kdtree_top_k(spark, sf).collect())) == sorted(duckdb.sql(queries.OP6).fetchall())
