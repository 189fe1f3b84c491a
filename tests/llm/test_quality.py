from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality


def graded(n, seed):
    """Texts whose grade 0-3 is the number of quarters of good words."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = rng.randrange(4)
        rows.append((i, " ".join(f"good{rng.randrange(40)}" if rng.random() < g / 3 * 0.9 + 0.05 else f"bad{rng.randrange(40)}!!" for _ in range(rng.randint(30, 90))), g))
    return rows


def test_ordered_grades(spark):
    rows = graded(1500, 1)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    model = quality.train(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 3
    got = quality.grade(docs.where(quality.held_out(F.col("doc_id"))), model).join(docs, "doc_id").toPandas()
    assert np.abs(got.expected_grade - got.quality).mean() < 0.35
    assert (got.selected == (got.quality >= 2)).mean() > 0.95
    tail = docs.select(quality.score(model, F.col("text"), 1).tail_probability.alias("a"), quality.score(model, F.col("text"), 3).tail_probability.alias("b"))
    assert tail.where("a < b").count() == 0


def test_gradient():
    rng = np.random.default_rng(0)
    f = [rng.integers(0, 50, 10) for _ in range(400)]
    w = np.linspace(-3, 3, 50)
    s = np.array([w[x].mean() for x in f])
    y = np.searchsorted(np.quantile(s, [0.3, 0.6]), s)
    theta, got = quality.fit_rows(f, [np.full(10, 0.1)] * 400, y, 3, rounds=1500, ridge=0.0)
    value = np.array([got[x].mean() for x in f])
    assert (np.searchsorted(theta, value) == y).mean() > 0.95


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    got = quality.grade(docs, model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).toPandas()
    assert (got.selected == (got.quality == 1)).mean() > 0.93


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "a " * 50_000), (2, "\n \t")], "doc_id bigint, text string").withColumn("selected", F.lit("clash"))
    none = quality.train(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert quality.grade(docs, none).count() == 4
    one = quality.train(docs, spark.createDataFrame([(1, 3)], "doc_id bigint, quality int"))
    assert {r.expected_grade for r in quality.grade(docs, one).collect()} == {3.0}
    assert quality.grade(docs.limit(0), one).count() == 0


def test_all_grades_are_learnt(spark):
    rows = [(i, "good " * (i % 101) + "bad " * (100 - i % 101), i % 101) for i in range(404)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    kept = {r.quality for r in docs.where(~quality.held_out(F.col("doc_id"))).select("quality").distinct().collect()}
    assert len(kept) > 64 and quality.train(docs.select("doc_id", "text"), docs.select("doc_id", "quality")).grades == sorted(kept)
    with pytest.raises(ValueError, match="grades"):
        quality.train(docs, docs.withColumn("quality", F.col("doc_id").cast("int")))


def test_scores_against_the_formula(spark):
    """expected grade and tail probability from every feature of a text, one by one."""
    rng = np.random.default_rng(5)
    model = quality.Model([0, 2, 5], np.array([-0.5, 0.75]), rng.normal(size=quality.DIM))
    texts = ["", None, " \n ", "One two  two\nthree", "A" * 5000 + " b", "ünï CODE 42 x-y_z\tq\n\nq\n", "w " * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    for r in quality.grade(df, model).collect():
        text = texts[r.doc_id] or ""
        words = text.split()
        value = sum(model.weights[f] for f in quality.text_features(text, words))
        for w in words:
            value += sum(model.weights[f] for f in quality.word_features(w)) / len(words)
        below = [1 / (1 + math.exp(-(t - value))) for t in model.thresholds]
        mass = [below[0], below[1] - below[0], 1 - below[1]]
        assert abs(r.expected_grade - sum(g * m for g, m in zip(model.grades, mass, strict=True))) < 1e-9
        assert abs(r.tail_probability - (mass[1] + mass[2])) < 1e-9 and r.selected == (r.tail_probability >= 0.5)


def test_fit_is_a_minimum():
    """No small change of thresholds or weights makes the fitted sample likelier."""
    rng = np.random.default_rng(8)
    index = [rng.choice(40, 6, replace=False) for _ in range(80)]
    shares, y = [np.ones(6) / 6 for _ in index], rng.integers(0, 3, 80)
    thresholds, w = quality.fit_rows(index, shares, y, 3, rounds=3000, rate=0.02, ridge=1e-2)

    def loss(thresholds, w):
        edge = np.r_[-np.inf, thresholds, np.inf]
        score = np.array([(w[i] * s).sum() for i, s in zip(index, shares, strict=True)])
        sure = lambda x: 1 / (1 + np.exp(-np.clip(x, -700, 700)))
        weight = (1 / np.bincount(y))[y] / 3
        return -(weight * np.log(sure(edge[y + 1] - score) - sure(edge[y] - score))).sum() + 0.5e-2 * (w**2).sum()

    best = loss(thresholds, w)
    assert thresholds[0] < thresholds[1]
    for _ in range(200):
        step = np.zeros(quality.DIM)
        step[:40] = rng.normal(size=40) * 0.05
        assert loss(thresholds + rng.normal(size=2) * 0.02, w + step) >= best - 1e-6
