"""Multiplicities of the joins, rules for nulls, changes and inverses, vectors, the paced loop, parsing, streams."""

from __future__ import annotations

from collections import Counter
from itertools import product

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import scalars, vectors
from tessera.operators import fixpoint, moving, spatial
from tessera.operators.natural import Default, natural
from tessera.operators.query import from_
from tessera.operators.relation import Relation, erase_at, insert_at, monotone, new_ids, numbered
from tessera.operators.slotmap import SlotMap
from tessera.operators.universe import Universe
from tessera.streaming import ticks

PAIRS = list(product(range(4), range(4)))


@pytest.fixture(scope="module")
def sides(spark):
    """Key 4m + n has m left and n right rows; a null key is on both sides."""
    left = [(4 * m + n, i) for m, n in PAIRS for i in range(m)] + [(None, 0)]
    right = [(4 * m + n, 10 + i) for m, n in PAIRS for i in range(n)] + [(None, 10)]
    return Relation(spark.createDataFrame(left, "k int, a int"), "l", ("k",), unique=False), Relation(spark.createDataFrame(right, "k int, b int"), "r", ("k",), unique=False)


RULES = {
    ("join", "merge"): lambda m, n: min(m, n),
    ("outer_join", "merge"): lambda m, n: m,
    ("anti_join", "merge"): lambda m, n: max(m - n, 0),
    ("join", "find"): lambda m, n: m if n else 0,
    ("outer_join", "find"): lambda m, n: m,
    ("anti_join", "find"): lambda m, n: 0 if n else m,
}


@pytest.mark.parametrize("kind, form", RULES)
def test_multiplicity(sides, kind, form):
    left, right = sides
    rows = getattr(getattr(from_(left), kind)(right), form)().df.collect()
    count = Counter(r.l.k for r in rows)
    assert count.pop(None, 0) == (0 if kind == "join" else 1)
    assert count == Counter({4 * m + n: c for m, n in PAIRS if (c := RULES[kind, form](m, n))})
    if kind == "outer_join":
        assert all((r.r is None) == (r.l.k is None or r.l.k % 4 == 0) for r in rows)
    if (kind, form) != ("join", "merge") and kind != "anti_join":
        assert all(r.r is None or r.r.b == 10 for r in rows)  # the first
    if (kind, form) == ("join", "merge"):
        assert all(r.l.a == r.r.b - 10 for r in rows)  # paired by place


def test_natural_multiplicity(sides):
    left, right = sides
    q = natural(left.df)
    assert Counter(r.k for r in q.join(right).select().collect()) == Counter({4 * m + n: m * n for m, n in PAIRS if m * n})
    amended = q.join(Default({"b": -1})).amend(right).select().collect()
    assert len(amended) == left.df.count() and all(r.b == (10 if r.k is not None and r.k % 4 else -1) for r in amended)
    assert Counter(r.k for r in q.subtract(right).select().collect()) == Counter({**{4 * m: m for m in range(1, 4)}, None: 1})


def test_amend_with_null_overrides(spark):
    left = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int")
    right = Relation(spark.createDataFrame([(1, None)], "k int, v int"), "r", ("k",))
    assert sorted(natural(left).amend(right).select().collect()) == [(1, None), (2, 6)]
    with pytest.raises(ValueError):
        natural(left).join(Relation(right.df.withColumnRenamed("k", "x"), "r", ("x",)))


def test_lookup_reaches_both_scans(spark, tmp_path):
    spark.range(100).selectExpr("id as k", "id * 2 as v").write.parquet(str(tmp_path / "a"))
    a = spark.read.parquet(str(tmp_path / "a"))
    plan = natural(a).join(Relation(a.selectExpr("k", "v as w"), "b", ("k",))).lookup(k=5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(k,5)") == 2


def test_key_changes(spark, sides):
    left, right = sides
    with pytest.raises(ValueError):
        from_(left).join(left).find()
    with pytest.raises(ValueError):
        from_(left).on("nobody")
    with pytest.raises(ValueError):
        left.assert_unique()
    same = from_(left).join(right.keyed_by(lambda c: c("k") + 0, unique=False)).find().df
    assert same.count() == from_(left).join(right).find().df.count()


def test_changes(spark):
    base = Relation(spark.range(20).selectExpr("id as k", "id * 10 as v"), "t", ("k",))
    more = spark.createDataFrame([(25, 1), (26, 2)], "k bigint, v bigint")
    assert sorted(base.insert(more).erase(more).df.collect()) == sorted(base.df.collect())
    with base.inserter() as batch:
        batch.add(more)
        batch.add(more.withColumn("k", F.col("k") + 5))
    assert batch.result.df.count() == 24
    up = base.upsert(spark.createDataFrame([(3, 1), (3, 7), (99, 5)], "k bigint, v bigint")).df
    assert up.count() == 21 and up.where("k = 3").first().v == 7
    rest, gone = base.erase_all(more.limit(0).unionByName(spark.createDataFrame([(3, 0), (3, 1), (77, 0)], "k bigint, v bigint")))
    assert rest.df.count() == 19 and gone.first().erased == 1
    bag = Relation(spark.createDataFrame([(1, i) for i in range(5)], "k bigint, v bigint"), "t", ("k",), unique=False)
    assert sorted(r.v for r in bag.erase(spark.createDataFrame([(1,), (1,)], "k bigint")).df.collect()) == [2, 3, 4]
    assert base.find(4).first().v == 40 and bag.find(1).first().v == 0
    with pytest.raises(ValueError):
        monotone(base.df, base.df, "k")
    with pytest.raises(OverflowError):
        new_ids(more.select("v"), base.df, "k", ["v"], limit=20)


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 30), st.integers(0, 5))
def test_positions(spark, pos, n):
    df = numbered(spark.range(30).selectExpr("id * 7 % 31 as x"), ["x"])
    rows = spark.range(n).selectExpr("-id - 1 as x", "id as pos")
    grown = insert_at(df, pos, rows)
    order = [r.x for r in sorted(grown.collect(), key=lambda r: r.pos)]
    want = sorted(i * 7 % 31 for i in range(30))
    want[pos:pos] = [-i - 1 for i in range(n)]
    assert order == want
    back = erase_at(grown, pos, pos + n)
    assert sorted(back.collect()) == sorted(df.collect())


def test_universe(spark):
    frame = lambda ids: spark.createDataFrame([(i, i * 2) for i in ids], "id bigint, v bigint")
    u = Universe({"a": frame(range(10)), "b": frame(range(5, 15)), "c": frame([1, 7])}, "id")
    ids = lambda q: sorted(r.a.id for r in q.df.collect())
    assert ids(u.require("a", "b")) == [5, 6, 7, 8, 9] and ids(u.require_all()) == [7]
    assert ids(u.require("a").exclude("b", "c")) == [0, 2, 3, 4]
    assert ids(u.require("a").include("c")) == list(range(10))
    assert {r.a.id for r in u.require("a").include("c").df.where("c is not null").collect()} == {1, 7}
    assert ids(u.erase(frame([7, 8])).require("a", "b")) == [5, 6, 9]
    assert [r.id for r in u.new_ids(frame([0, 1]).select("v"), ["v"]).orderBy("id").collect()] == [15, 16]


def test_slots(spark):
    s = SlotMap.of(spark.createDataFrame([("x",), ("y",)], "n string"), ["n"])
    s = s.erase(s.df.where("n = 'x'")).put(spark.createDataFrame([("z",)], "n string"), ["n"])
    assert sorted((r.n, r.handle) for r in s.scan().collect()) == [("y", 1), ("z", 2)]
    s = s.update(spark.createDataFrame([("w", 2), ("v", 9)], "n string, handle bigint"))
    refs = spark.createDataFrame([(2, "p"), (0, "q"), (None, "r")], "h bigint, who string")
    assert [(r.who, r.n) for r in s.lookup(refs, "h").collect()] == [("p", "w")]
    with pytest.raises(TypeError):
        SlotMap(s.df, scannable=False).scan()


def ring(values, whole, before):
    buffer, at, out = [0] * 7, 0, []
    for v in values:
        if before:
            out.append(buffer[:])
        buffer[at], at = v, (at + 1) % 7
        if not before:
            out.append(buffer[:])
    total = [sum(b) - min(b) - max(b) for b in out]
    return [int(abs(x) // 5) * (1 if x >= 0 else -1) if whole else x / 5 for x in total]


@pytest.mark.parametrize("whole, before", product((True, False), (True, False)))
def test_ring(spark, whole, before):
    values = [((i * 7919) % 1001 - 400) * (1 if whole else 0.25) for i in range(40)]
    df = spark.createDataFrame([(i, int(v) if whole else v) for i, v in enumerate(values)], f"i int, v {'bigint' if whole else 'double'}").withColumn("k", F.lit(1))
    f = moving.trimmed_prediction if before else moving.trimmed_average
    got = [r.e for r in df.withColumn("e", f("v", ["k"], ["i"], whole=whole)).orderBy("i").collect()]
    assert got == pytest.approx(ring([int(v) if whole else v for v in values], whole, before))
    with pytest.raises(ValueError):
        moving.trimmed_average("v", ["k"], ["i"], size=2)


def test_scalars(spark):
    df = spark.createDataFrame([("12ab",), (" -7 x",), ("+3",), ("x1",), ("",), ("99999999999999999999",)], "s string")
    assert [r[0] for r in df.select(scalars.leading_int(F.col("s"))).collect()] == [12, -7, 3, 0, 0, 0]
    paths = spark.createDataFrame([("a/b/c.tar.gz",), ("c",), ("/x/.hid",), ("u/",)], "s string")
    assert [r[0] for r in paths.select(scalars.path_stem(F.col("s"))).collect()] == ["c.tar", "c", "", ""]
    edits = spark.createDataFrame([("ab", "\b"), ("", "\b"), ("a", "é")], "s string, k string")
    assert [r[0] for r in edits.select(scalars.edited(F.col("s"), F.col("k"))).collect()] == ["a", "", "aé"]

    def step(p, d, top=10_000_000, low=2_000_000):
        if p >= top:
            return top
        n = d // (top - p) + 1
        return max(low, min(top, top if n > 10 else (d + p * n) // n))

    cases = [(p, d) for p in (0, 1, 5_000_000, 9_999_999, 10_000_000, 12_000_000) for d in (0, 1, 3_000_000, 10_000_000, 99_000_000)]
    got = spark.createDataFrame(cases, "p bigint, d bigint").select(scalars.step(F.col("p"), F.col("d"))).collect()
    assert [r[0] for r in got] == [step(*c) for c in cases]
    v = spark.range(1).select(vectors.normalize(vectors.zero()).alias("z"), vectors.length(vectors.vec(F.lit(3.0), F.lit(4.0))).alias("l"), vectors.cardinal("y").alias("y"), vectors.random(1).alias("r")).first()
    assert v.z == (None, None) and v.l == 5.0 and v.y == (0.0, 1.0) and 0 <= v.r.x < 1


def test_parser(spark):
    g = fixpoint.Grammar([("S", ("a", "S", "b"), 1.0), ("S", (), 0.5), ("S", ("T",), 3.0), ("T", ("a",), 0.0)])
    tok = lambda s: [{c: 0.0} for c in s]
    assert g.parse(tok("ab"), "S") == (1.5, "(S (a) (b))") and g.parse(tok("aabb"), "S")[0] == 2.5
    assert g.parse(tok("a"), "S") == (3.0, "(S (T (a)))") and g.parse([], "S") == (0.5, "(S)") and g.parse(tok("ba"), "S") is None
    assert g.parse([{"a": 1.0, "b": 0.0}, {"b": 2.0}], "S")[0] == 4.5


def test_closure(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(20, 18), (50, 50)], "a int, b int")
    got = {tuple(r) for r in fixpoint.transitive_closure(edges).collect()}
    assert {(0, 20), (18, 18), (19, 18), (50, 50)} <= got and (18, 0) not in got and len(got) == sum(1 for i in range(21) for j in range(21) if j > i or i >= 18 <= j) + 1


def test_closure_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a int, b int")
    got = [tuple(r) for r in fixpoint.transitive_closure(edges).collect()]
    assert sorted(got) == [(i, j) for i in range(41) for j in range(i + 1, 41)]


def test_boxes(spark):
    import random

    rng = random.Random(1)
    rows = [(i, x, y, x + rng.random() * 3, y + rng.random() * 3) for i in range(120) for x, y in [(rng.uniform(-20, 20), rng.uniform(-20, 20))]] + [(500, 0.0, 0.0, 2.0, 2.0), (501, 2.0, 2.0, 4.0, 4.0)]
    df = spark.createDataFrame(rows, "id int, lo_x double, lo_y double, hi_x double, hi_y double")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]}
    for cell in (0.7, 2.0, 50.0):
        got = [tuple(r) for r in spatial.overlapping_pairs(df, cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_boxes_of_a_dense_cell(spark, monkeypatch):
    """Rows that occur twice, borders that touch, boxes that end before they begin, and nulls, over several chunks and blocks."""
    import random

    monkeypatch.setattr(spatial, "CHUNK", 7)
    monkeypatch.setattr(spatial, "BLOCK", 11)
    rng = random.Random(2)
    at = lambda: rng.randrange(-8, 9) / 4
    rows = [(i, x, y, x + rng.randrange(-1, 4) / 4, y + rng.randrange(-1, 4) / 4) for i in range(90) for x, y in [(at(), at())]]
    rows += rows[:9] + [(5, 0.0, 0.0, 1.0, 1.0), (None, 0.0, 0.0, 1.0, 1.0), (200, None, 0.0, 1.0, 1.0), (201, 0.0, 0.0, 1.0, None)]
    df = spark.createDataFrame(rows, "id int, lo_x double, lo_y double, hi_x double, hi_y double")
    df.createOrReplaceTempView("boxes")
    touch = "a.lo_x <= b.hi_x and b.lo_x <= a.hi_x and a.lo_y <= b.hi_y and b.lo_y <= a.hi_y"
    for cell in (0.5, 3.0):
        for found, where in ((spatial.overlapping(df, df, cell), touch), (spatial.overlapping_pairs(df, cell), f"a.id < b.id and {touch}")):
            want = spark.sql(f"select a.id as a_id, b.id as b_id from boxes a join boxes b on {where}")
            assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))


def test_boxes_of_one_cell_are_dealt(spark, monkeypatch):
    """One file of boxes of one cell: its pairs come from many tasks, and each task holds what one block reaches."""
    monkeypatch.setattr(spatial, "BLOCK", 50, raising=False)
    df = spark.range(0, 1000, 1, 1).selectExpr("id", "0d as lo_x", "id / 1000 as lo_y", "1d as hi_x", "(id + 9.5) / 1000 as hi_y")
    parts = spatial.overlapping_pairs(df, 2.0).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 8 and sum(r[1] for r in parts) == sum(min(9, 999 - i) for i in range(1000)) and max(r[1] for r in parts) < 2500


def test_streams(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    for n in range(3):
        spark.createDataFrame([(n, i) for i in range(n + 1)], "n int, i int").coalesce(1).write.mode("append").parquet(source)
    sink = ticks.DoubleBuffer(str(tmp_path / "buffer"), lambda df, n: seen.append((n, df.count())))
    stream = spark.readStream.schema("n int, i int").option("maxFilesPerTrigger", 1).parquet(source)
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [n for n, _ in seen] == [1, 2] and sum(c for _, c in seen) < 6


def test_pressed_keys(spark, tmp_path):
    from pyspark.sql import Row  # noqa: F401

    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = pd.DataFrame({"key": [1, 2, 1, 3, 2], "order": [1, 2, 3, 4, 5], "down": [True, True, False, True, True]})
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key bigint, order bigint, down boolean").parquet(str(tmp_path / "in"))
    q = ticks.pressed_keys(stream).writeStream.format("memory").queryName("pressed").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    streamed = {r.key for r in spark.table("pressed").where("down").collect()}
    batch = {r.key for r in ticks.latest_state(spark.createDataFrame(rows), ["key"], ["order"], F.col("down")).collect()}
    assert streamed == batch == {2, 3}


def test_closure_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)], "a bigint, b bigint")
    assert fixpoint.transitive_closure(chain).count() == 5050


def test_positions_of_any_type(spark):
    rows = [(None, 1), ("b", 2), ("a", 3), ("", 4), *(("same", k) for k in range(50))]
    got = numbered(spark.createDataFrame(rows, "s string, n int").repartition(5), ["s", "n"], start=7).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [(r.s, r.n) for r in sorted(got, key=lambda r: r.pos)] == want and sorted(r.pos for r in got) == list(range(7, 61))
    assert numbered(spark.createDataFrame([], "s string"), ["s"]).count() == 0


def test_cleared_and_sorted(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "id int, x string")
    r = Relation(df, "r", ("id",))
    assert r.clear().df.count() == 0 and r.clear().df.columns == df.columns
    assert [x.r.id for x in from_(r).join(r.aliased("s")).merge().sorted().df.collect()] == [1, 2, 3]
