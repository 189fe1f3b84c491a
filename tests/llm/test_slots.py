from __future__ import annotations

import random
import zlib

import numpy as np

from tessera.llm import slots
from tessera.llm.slots import SlotMap


def test_query_law(spark):
    from tessera.llm import queries

    sf = "/root/testdata/sf0.01"
    got = queries.op10_sharding(spark, sf).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.size == len(docs[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(24)) and all(sorted(x.slot for x in v) == list(range(len(v))) for v in by.values())
    sizes = [sum(x.size for x in v) for v in by.values()]
    assert max(sizes) <= 1.02 * min(sizes) and {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)


def test_edits(tmp_path):
    size = np.random.default_rng(1).pareto(1.5, slots.SLOTS) * 1000
    one = SlotMap.initial(24)
    two = one.rebalanced(size)
    load = two.loads(size)
    assert two.version == 2 and load.max() <= max(1.001 * load.mean(), size.max()) + load.mean() * 0.001
    three = two.grown(size)
    changed = np.array(three.shards) != np.array(two.shards)
    assert set(np.array(three.shards)[changed]) == {24} and abs(three.loads(size)[24] / (size.sum() / 25) - 1) < 0.01
    assert two.rebalanced(size).moved == 0
    assert SlotMap.read(two.write(f"file://{tmp_path}")).shards == two.shards


def test_edges(spark, tmp_path):
    rng = random.Random(4)
    rows = [(None, None)] * 50 + [(7, "same")] * 70 + [(i, "x" * rng.randrange(3000)) for i in range(300)] + [(8, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'c' as shard", "1 as part", "2 as size")
    got = slots.shard(df, 5).collect()
    assert len(got) == len(rows)
    for k in range(5):
        mine = sorted(r.slot for r in got if r.shard == k)
        assert mine == list(range(len(mine)))
    assert slots.shard(df.limit(0), 5).count() == 0
