from __future__ import annotations

import gzip
import hashlib
import random

from pyspark.sql import functions as F

from tessera.llm import warc
from tessera.llm.common import file_system


def pages(spark, seed=1):
    rng = random.Random(seed)
    same = ["<p>" + "é%d " % k * 400 for k in range(3)]
    rows = [(i * 37 % 1001, f"http://x/{i} ü\n", rng.choice(same) if i % 3 == 0 else "".join(rng.choices("ab<>\r\n", k=rng.randrange(2500)))) for i in range(300)]
    rows += [(2000, None, None), (2001, "u", ""), (2002, "u", "short"), (2003, "u", "short"), (None, "u", same[0]), (2004, "u", "z" * 3_000_000)]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)


def want(rows):
    last = {}
    for k, _, t in rows:
        if k is not None:
            last[t or ""] = max(last.get(t or "", k), k)
    out = []
    for k, _, t in rows:
        p = (t or "").encode()
        again = len(p) >= 1000 and k != last[t or ""]
        out.append((k, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", last[t or ""] if again else None))
    return sorted(out, key=str)


def contents(manifest):
    out = {}
    for r in manifest.collect():
        system, base = file_system(r.folder)
        with system.open_input_stream(f"{base}/{r.name}", compression=None) as f:
            out[r.name] = f.read()
        assert len(out[r.name]) == r.bytes
    return out


def test_round_trip(spark):
    rows, df = pages(spark)
    made = warc.write(df, shard_bytes=100_000, file_bytes=20_000)
    back = warc.read(made)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in back.select(columns).collect()), key=str) == want(rows)
    texts = {k: t or "" for k, _, t in rows}
    assert all(r.payload == texts[r.page_id] for r in back.where("record_type = 'response'").collect())
    files = contents(made)
    assert len(files) > 10 and all(gzip.decompress(b).startswith(b"WARC/1.1\r\n") for b in files.values())
    # Equal rows give equal files, however they are dealt.
    assert contents(warc.write(df.repartition(7), shard_bytes=100_000, file_bytes=20_000)) == files
    # Files follow the key's order.
    keys = [r.page_id for name in sorted(files) for r in warc.read(made.where(F.col("name") == name)).collect()]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])


def test_edges(spark):
    rows, df = pages(spark)
    assert warc.read(warc.write(df.limit(0))).count() == 0
    twice = spark.createDataFrame([(1, "a", "x" * 2000), (1, "b", "x" * 2000), (0, "c", "x" * 2000), (None, "d", "y" * 2000)], "page_id bigint, url string, html string").withColumn("digest", F.lit(1))
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read(warc.write(twice)).where("page_id is not null").collect())
    assert got == [(0, "revisit", 1), (1, "response", None), (1, "response", None)]


def test_sql(spark):
    import duckdb

    from tessera.llm import queries

    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view pages as select * from '{sf}/pages.parquet'")
    assert sorted(map(tuple, queries.op1_warc(spark, sf).collect())) == sorted(duckdb.sql(queries.OP1).fetchall())
