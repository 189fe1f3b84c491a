from __future__ import annotations

import random
import re
import time

import pytest

from tessera.llm import decontam

from . import brute as plain

ITEM = "Maria walks from London to Oxford at 5 km per hour and John rides 20 miles further, so Maria needs 3 hours while John needs 7 hours."
ITEMS = [
    (1, ITEM),
    (2, "la suma de los ángulos interiores es igual a dos rectos en cada triángulo plano que se dibuja"),
    (3, "how many legs has it"),
    (4, "it is"),
    (5, None),
    (None, "an item without any number whose words are long enough to be matched as they stand in other texts"),
]


def brute(docs, items):
    """Pairs of ids of texts that repeat whole items up to consistent changes of placeholders, or in other case."""

    def parse(t):
        t = re.sub(r"(?<=\d)[.,](?=\d)", "", (t or "").replace("@", " "))
        t = re.sub(r"(\d)([^\W\d_])", r"\1 \2", t)
        t = re.sub(r"(?<=[^\W_,] )([A-ZÁÉ][a-záéíóúñ]+)|(?<=, )([A-ZÁÉ][a-záéíóúñ]+)", lambda m: "@" + m[0], t)
        return [w for w in re.split(r"[^\w@]+|_", t.lower()) if w]

    def kinds(words):
        out = []
        for w, before in zip(words, ["", *words], strict=False):
            number = w[0].isdigit() or w in decontam.NUMBER_WORDS
            out.append("#" if number else "@" if w[0] == "@" else "%" if w in decontam.UNITS and before[:1].isdigit() else w)
        return out

    plain = lambda words: [w.lstrip("@") for w in words]
    unnamed = lambda words: kinds(plain(words))
    bare = lambda ks: all(k in "#@%" for k in ks)
    out = set()
    for d, t in docs:
        x = parse(t)
        kx = kinds(x)
        for i, q in items:
            readings = [(y, kinds(y)) for y in [parse(q)]] + [(y[1:], kinds(y)[1:]) for y in [parse("1 " + (q or ""))]]
            n = len(readings[0][0])
            if n < decontam.LEAST:
                continue
            need, w, places = min(n, decontam.RUN), min(n, decontam.WIDTH), set()
            ax, read = unnamed(x), [(y, ky, unnamed(y) if len(y) == len(parse(q)) and y == parse(q) else kinds(plain(parse("1 " + q)))[1:]) for y, ky in readings]
            for shift in range(-n, len(x)):
                pairs, loose = set(), set()
                for p in range(n - w + 1):
                    if not (0 <= p + shift and p + shift + w <= len(x)):
                        continue
                    xs, ks = x[p + shift : p + shift + w], kx[p + shift : p + shift + w]
                    for y, ky, by in read:
                        ys, ls, a, b = y[p : p + w], ky[p : p + w], ax[p + shift : p + shift + w], by[p : p + w]
                        same = plain(xs) == plain(ys) if bare(b) else a == b
                        if same or ("@" in ls and not bare(ls) and ks == ls):
                            if plain(xs) == plain(ys):
                                places.add(p)
                            else:
                                loose.add(p)
                                pairs |= {(v, u) for v, u, k in zip(plain(ys), plain(xs), ls, strict=True) if k in "#@" or u != v}
                if len({a for a, _ in pairs}) == len(pairs):
                    places |= loose
            if len(places) >= need - w + 1:
                out.add((d, i))
    return out


CHANGED = ITEM.replace("Maria", "Paula").replace("John", "Peter").replace("20", "35").replace("London", "Cambridge")
DOCS = [
    (10, "Something first. " + ITEM + " Something after."),
    (11, "nothing of it here at all, only plain words that go on and on"),
    (12, CHANGED),
    (13, CHANGED.replace("while Peter", "while Anna")),
    (14, "LA SUMA DE LOS ÁNGULOS INTERIORES ES IGUAL A DOS RECTOS EN CADA TRIÁNGULO PLANO QUE SE DIBUJA"),
    (15, "well how many legs has it then"),
    (16, "it is it is it is"),
    (17, None),
    (18, ""),
    (None, "x " * 3000 + ITEMS[5][1]),
    (19, "la suma de los ángulos interiores es igual a dos"),
    (20, "la suma de los ángulos interiores es igual a dos rectos en cada y nada"),
    (21, ITEM.replace("5 km", "3,000.5 miles").replace("3 hours", "9 hours")),
    (22, ITEM.lower()),
    (23, ITEM.upper()),
    (24, ITEM.title()),
    (25, ITEM.replace("Maria", "Paula")),
    (26, ITEM[:95] + " and then all of it goes on in quite another way."),
    (27, CHANGED.lower()),
    (28, ITEM.replace("John needs", "Peter needs")),
]


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_templates(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", limit)
    docs = spark.createDataFrame([*DOCS, DOCS[0]], "doc_id bigint, text string").withColumn("item_id", __import__("pyspark").sql.functions.lit("clash"))
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = [(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()]
    want = brute(DOCS, ITEMS)
    assert sorted(got, key=str) == sorted(want, key=str) and plain.contaminated(DOCS, ITEMS) == want
    assert {(10, 1), (12, 1), (14, 2), (15, 3), (None, None), (20, 2), (21, 1)} <= want and not {(13, 1), (19, 2), (27, 1)} & want
    assert {(k, 1) for k in (22, 23, 24, 25, 26, 28)} <= want
    left = decontam.without_contaminated(docs, items)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {d for d, _ in DOCS} - {d for d, _ in want}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert decontam.contaminated(none, items).count() == 0
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    assert decontam.contaminated(docs, items.limit(0)).count() == 0
    assert decontam.without_contaminated(docs, items.limit(0)).count() == len(DOCS)


def found(spark, docs, items):
    docs, items = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    return {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, items).collect()}


def test_first_word_inside_a_sentence(spark):
    items = [(1, "Natalia sold clips to 48 of her friends in April"), (2, "Seven dwarfs dig"), (3, "days pass slowly in this old town by the sea")]
    docs = [(1, "please answer this Natalia sold clips to 48 of her friends in April"), (2, "here you go, Natalia sold clips to 48 of her friends in April."), (3, items[0][1]), (4, "after 12 days pass slowly in this old town by the sea"), (5, "ask Sophie sold clips to 50 of her friends in April"), (6, "ask Sophie sold clocks to 50 of her friends in April")]
    got = found(spark, docs, items)
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 3), (5, 1)}
    assert {got[k].n_windows for k in ((1, 1), (2, 1), (3, 1), (5, 1))} == {3} and got[1, 1].n_changed == 0 and got[5, 1].n_changed == 2


def test_short_items(spark):
    items = [(1, "Seven dwarfs dig"), (2, "Why?"), (3, "..."), (4, "")]
    got = found(spark, [(1, "seven  dwarfs dig!"), (2, "the seven dwarfs dig"), (3, "Eight dwarfs dig"), (4, "why"), (5, "why so"), (6, "..."), (7, "")], items)
    assert set(got) == {(1, 1), (4, 2)}


def test_word_for_word_in_spite_of_one_conflict(spark):
    item = "a clerk has to pay 12 dollars for every box that he sends by boat and nobody in the old harbour town knows why the price is so high when the whole trip takes no more than 12 hours"
    docs = [(1, item), (2, item.replace("12 hours", "13 hours")), (3, item.replace("12 dollars", "14 dollars").replace("12 hours", "13 hours")), (4, "clerk pay 14 dollars for every box and trip takes no more than 13 hours")]
    got = found(spark, docs, [(1, item)])
    assert {k for k, _ in got} == {1, 2, 3} and got[1, 1].n_windows == got[2, 1].n_windows > got[3, 1].n_windows >= 6
    short = "Anna has 12 red and Anna sold 12 blue hats"
    assert set(found(spark, [(1, short.replace("sold 12", "sold 13")), (2, short.replace("12", "13")), (3, short)], [(1, short)])) == {(2, 1), (3, 1)}


def test_number_tables(spark):
    """Windows of numbers alone go by their values, so a table does not meet all of another one."""
    rng = random.Random(4)
    numbers = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    item = numbers(60)
    docs = [(1, numbers(20_000)), (2, numbers(500) + " " + item + " " + numbers(500)), (3, "total " + item[:200] + " x")]
    got = found(spark, docs, [(1, item)])
    assert set(got) == {(2, 1), (3, 1)} and got[2, 1].n_windows == 53 and got[2, 1].n_changed == 0


def test_long_texts_take_linear_time(spark):
    rng, took = random.Random(6), []
    for n in (20_000, 160_000):
        docs = [(1, " ".join("w%d" % rng.randrange(5000) for _ in range(n)) + " " + ITEM)]
        began = time.time()
        assert set(found(spark, docs, ITEMS)) == {(1, 1)}
        took.append(time.time() - began)
    assert took[1] < 6 * took[0] + 5
