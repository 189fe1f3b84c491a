from __future__ import annotations

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity
from tessera.llm.toxicity import Model


def score(model, text):
    return model.score(model.measure(text, model.automaton()))


def test_folding_and_borders():
    m = Model({("idiot", True): 7.0, ("iowei", False): 6.0}, frozenset({("ciever", "idiot")}), 2.0, -3.0)
    for t in ["you IDIOT", "1d10t", "іdiоt", "ｉｄｉｏｔ!!", "id​iot", "ìdíot", "x idiot$$$", "loweischaft", "so |owe1x"]:
        assert score(m, t) > 0.9, t
    for t in ["", "idiots", "myidiot", "slowei", "a clever idiot", "İ" * 50, "clean"]:
        assert score(m, t) < 0.1, t
    assert score(m, "idiot " * 2 + "word " * 30_000) < score(m, "idiot " * 2)


def brute_measure(model, text):
    """Hits by looking at every position, exceptions by looking at the words around each, words by the contract's white space."""
    low = toxicity.lowered(text)
    folded = low.translate(toxicity.FOLD)
    raw = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", low)]
    words = []
    for start, end in raw:
        solid = [i for i in range(start, end) if low[i].isalpha() or low[i].isdigit()]
        if solid and any(low[i].isalpha() for i in solid):
            words.append((start, end, folded[solid[0] : solid[-1] + 1]))
    best = {}
    for (entry, whole), weight in model.entries.items():
        for i in range(len(low) - len(entry) + 1):
            end = i + len(entry)
            if folded.startswith(entry, i) and not (i and low[i - 1].isalpha()) and not (whole and end < len(low) and low[end].isalpha()):
                best[i] = max(best.get(i, 0), weight)
    total = 0.0
    for i, weight in best.items():
        mine = [k for k, (start, _, _) in enumerate(words) if start <= i]
        k = mine[-1] if mine else -1
        beside = [(k - 1, k), (k, k + 1)]
        if not any(0 <= x and y < len(words) and k >= 0 and (words[x][2], words[y][2]) in model.exceptions for x, y in beside):
            total += weight
    return total / (1 + math.log1p(len(raw) / 50))


@pytest.mark.parametrize("excepted", [False, True])
def test_against_every_position(excepted):
    rng = random.Random(2)
    term = lambda: "".join(rng.choice("abo") for _ in range(rng.randint(1, 4)))
    m = Model({(term(), rng.random() < 0.5): rng.random() for _ in range(25)}, frozenset((term(), term()) for _ in range(60 * excepted)))
    for _ in range(400):
        t = "".join(rng.choice("abo0@ .é\t\n") for _ in range(rng.randint(0, 60)))
        assert abs(m.measure(t, m.automaton()) - brute_measure(m, t)) < 1e-9


def test_exceptions_hold_for_their_own_words_only():
    m = Model({("moron", True): 7.0, ("idiot", True): 7.0}, frozenset({("ciever", "idiot")}), 2.0, -3.0)
    assert score(m, "moron clever idiot") > 0.9 and score(m, "clever\tidiot\tfoo\tbar\tmoron") > 0.9
    assert score(m, "a clever idiot") < 0.1 and score(m, "a\nclever\nidiot") < 0.1 and score(m, "idiot clever") > 0.9
    assert score(m, "moron" + " " * 100_000) == score(m, "moron") > score(m, "moron" + "\nword" * 1000)


def test_long_texts_take_linear_time():
    m = Model({("idiot", True): 7.0}, frozenset({("ciever", "idiot")}), 2.0, -3.0)
    a, took = m.automaton(), []
    for n in (10_000, 80_000):
        began = time.process_time()
        assert m.measure("idiot\t" * n, a) > 0
        took.append(time.process_time() - began)
    assert took[1] < 40 * took[0] + 1


def test_rows_of_one_key_are_one(spark):
    docs = spark.createDataFrame([(1, "b scum"), (1, "a scum"), (1, "c scum")], "doc_id bigint, text string")
    seen, fit = [], toxicity.fit
    toxicity.fit = lambda known, *columns: seen.extend(r._text for r in known.collect()) or fit(known, *columns)
    try:
        toxicity.train(docs, spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int"))
    finally:
        toxicity.fit = fit
    assert seen == ["a scum"]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = docs.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("toxic", toxicity.score(model, F.col("text")).alias("s")).toPandas()
    right = ((got.s >= 0.5) == (got.toxic == 1)).mean()
    assert right > 0.97 and (got.s[got.toxic == 1] >= 0.5).mean() > 0.85


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "fool fool"), (3, "fool " * 40_000), (3, "fine")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("toxic", F.lit("clash"))
    empty = toxicity.train(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert docs.select(toxicity.score(empty, F.col("text")).alias("s")).where("s < 0.5").count() == 5
    m = Model({("fooi", True): 8.0}, frozenset(), 2.0, -3.0)
    left = toxicity.without_toxic(docs, m)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 3]
    assert toxicity.without_toxic(docs.limit(0), m).count() == 0


def test_few_labels(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = docs.join(labels, "doc_id").where("text is not null").select("text", "toxic", toxicity.score(model, F.col("text")).alias("s")).toPandas()
    assert (got.s[got.toxic == 0] < 0.5).all() and (got.s[got.toxic == 1] >= 0.5).mean() > 0.5
    assert {t for t, _ in model.entries} >= {"scum", "moron", "trash", "disgusting"}
    assert toxicity.without_toxic(docs, model).count() > 0.8 * docs.count()


def test_nothing_to_learn(spark):
    rows = [(f"word{i} other{i}", int(i % 5 == 0)) for i in range(60)]
    for some in (rows, [(" ", 0), ("?!", 1)], [("fine", 0), ("scum", 1)]):
        df = spark.createDataFrame(some, "text string, toxic int")
        model = toxicity.fit(df)
        assert not model.entries and toxicity.without_toxic(df, model).count() == len(some)
