from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import graph, minhash

from . import brute


def check(spark, rows, width=3, percent=85):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = minhash.near_duplicates(df, width, percent).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(brute.near(rows, width, percent))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice(([], ["new%d" % rng.randrange(10**6)], [words[at], "more%d" % rng.randrange(10**6)]))
    return words


@pytest.mark.parametrize(("few", "piece"), [(8, 128), (2, 3)])
def test_families(spark, monkeypatch, few, piece):
    """Families around the threshold, in which many pairs are linked only through others."""
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(minhash, "PIECE", piece)
    rng = random.Random(3)
    rows = []
    for family in range(8):
        base = ["w%d" % rng.randrange(10**6) for _ in range(rng.choice((30, 90, 200)))]
        for _ in range(rng.choice((2, 5, 60))):
            if rng.random() < 0.3:
                base = edited(rng, base, 1)
            rows.append((len(rows) * 7 % 1009 + 1009 * family, " ".join(edited(rng, base, rng.randrange(0, 1 + len(base) // 18))).upper() if family % 2 else " ".join(edited(rng, base, rng.randrange(0, 1 + len(base) // 18)))))
    rows += [(90_001, None), (90_002, ""), (90_003, " \t"), (90_004, "a b"), (90_005, "A\nB"), (90_006, "a"), (90_007, "b a"), (90_008, "x " * 5000), (90_009, "X " * 9000)]
    check(spark, rows)


def test_templates_do_not_meet(spark, monkeypatch):
    """Documents of one template, none similar enough: hardly a pair is compared on full sets; a few links among them are found."""
    rng, met = random.Random(9), []
    template = ["t%d" % i for i in range(100)]
    rows = [(i, " ".join([*template, *("o%d" % rng.randrange(10**9) for _ in range(15))])) for i in range(1500)]
    rows += [(2000 + i, rows[i][1] + " more") for i in range(0, 1500, 50)]
    linked = minhash._linked
    monkeypatch.setattr(minhash, "_linked", lambda pairs, *rest: met.append(pairs.count()) or linked(pairs, *rest))
    check(spark, rows)
    assert met[0] <= 30 * len(rows) and sum(met[1:]) <= len(rows)


def test_sample_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    check(spark, [tuple(r) for r in docs.collect()])


def test_equal_and_null_keys(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, None), (7, "q r s t"), (None, "m n o p")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in got.collect()), key=str)
    assert got == sorted([(None, 5, False), (5, 5, True), (5, 5, True), (None, None, True), (7, 7, True), (None, None, True)], key=str)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, node bigint, kept boolean, uid string")
    assert minhash.near_duplicates(df).count() == 0


@pytest.mark.parametrize("local", [1_000_000, 0])
def test_components_of_chains(spark, monkeypatch, local):
    monkeypatch.setattr(graph, "LOCAL", local)
    rng = random.Random(1)
    ids = list(range(400))
    rng.shuffle(ids)
    edges = [(ids[i], ids[i + 1]) for i in range(250)] + [(ids[300], ids[i]) for i in range(301, 350)] + [(9, 9)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {**dict.fromkeys(ids[:251], min(ids[:251])), **dict.fromkeys(ids[300:350], min(ids[300:350]))}
    assert got == want
    assert graph.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_least_matches():
    assert minhash.least_matches(32, 0.85) == 12 and minhash.least_matches(128, 0.8) == 73
