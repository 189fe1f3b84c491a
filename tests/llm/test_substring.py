from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import substring

from . import brute


def check(spark, rows, window=35, **more):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = substring.digests(substring.remove_repeats(df, window, **more)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute.substring(rows, window), key=repr)


def test_planted(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 5)))
    text = lambda n: [word() for _ in range(n)]
    shared = [text(n) for n in (34, 35, 36, 60, 200)]
    rows = []
    for i in range(120):
        w = text(rng.choice((0, 3, 34, 35, 80, 400)))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(shared)
        rows.append((i, rng.choice((" ", "\n", " \t ")).join(w)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, rows[5][1]), (904, "x " * 80), (904, "x " * 34), (None, "x " * 35), (905, "y" * 100_000)]
    check(spark, rows)


@pytest.mark.parametrize("window, period, cover", [(13, 13, (0, 1, 3, 9)), (8, 7, (0, 1, 3)), (5, 3, (0, 1))])
def test_periods(spark, window, period, cover):
    rng = random.Random(window)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    check(spark, rows, window, period=period, cover=cover)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, kept string, block bigint")
    assert substring.remove_repeats(df).count() == 0
    df = spark.createDataFrame([(1, "a b", "k")], "doc_id bigint, text string, kept string")
    assert substring.remove_repeats(df).collect()[0].kept == "a b"


def test_no_cover(spark):
    with pytest.raises(ValueError):
        substring.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string"), cover=(0, 1))


def test_sample_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("text"))
    check(spark, [tuple(r) for r in docs.collect()])
