from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import minhash, substring, toxicity

from . import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, function in corpus_pipeline.STAGES:
        out.append(function(spark, out[-1], SF).cache())
    return out


def test_columns(stages):
    docs = stages[0]
    for s in stages[1:-1]:
        assert s.schema.simpleString() == docs.schema.simpleString()


def test_toxicity(spark, stages):
    model = toxicity.train(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    a = model.automaton()
    want = {r.doc_id for r in stages[0].collect() if model.score(model.measure(r.text or "", a)) < 0.5}
    assert {r.doc_id for r in stages[1].collect()} == want


def test_near_duplicates(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = {k for k, _, _, kept in brute.near(rows, 5, 80) if kept}
    assert {r.doc_id for r in stages[2].collect()} == want
    assert sorted(stages[2].collect()) == sorted(r for r in stages[1].collect() if r.doc_id in want)


def test_substring(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    want = {k: (n, gone, digest) for k, n, gone, digest in brute.substring(rows) if not n or gone < n}
    got = {r.doc_id: r for r in stages[3].collect()}
    assert set(got) == set(want)
    before = {r.doc_id: r for r in stages[2].collect()}
    for k, (_, gone, digest) in want.items():
        if gone:
            assert hashlib.sha256(got[k].text.encode()).hexdigest() == digest and got[k].n_chars == len(got[k].text)
        else:
            assert got[k] == before[k]


def test_decontamination(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = stages[3].collect()
    bad = {d for d, _ in brute.contaminated([(r.doc_id, r.text) for r in rows], items)}
    assert bad and sorted(stages[4].collect()) == sorted(r for r in rows if r.doc_id not in bad)


def test_last_stage(stages):
    ids = {r.doc_id for r in stages[5].where(F.col("decoded_sha256").isNotNull()).collect()}
    assert ids == {r.doc_id for r in stages[4].collect()}
    text = {r.doc_id: r.text or "" for r in stages[4].collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in stages[5].collect())


def test_run(spark, stages):
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(stages[-1].collect())


def test_edges_keep_columns(spark):
    df = spark.createDataFrame([(None, "a b c d e f", 1, "k"), (3, "a b c d e f", 2, "r"), (3, "a b c d e f", 2, "r"), (4, None, 3, "t"), (5, None, 3, "t")], "doc_id bigint, text string, uid int, root string")
    got = minhash.without_near_duplicates(df)
    assert got.columns == df.columns and sorted((r.doc_id, r.uid) for r in got.collect()) == [(3, 2), (4, 3), (5, 3)]
    got = substring.without_repeats(df, window=21)
    assert got.columns == df.columns and got.count() == 5
    empty = df.limit(0)
    assert minhash.without_near_duplicates(empty).count() == 0 and substring.without_repeats(empty).count() == 0
