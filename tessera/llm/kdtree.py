"""Exact top-k by integer inner product: a KD-tree for each shard, searched best first.

1. Vectors are dealt to shards by space: median splits of a bounded sample (SAMPLE) say where; each vector is dealt. A
   shard that would hold more than SHARD vectors, of equal ones for instance, is cut by a hash.
2. Each shard's tree is built once and stored: median splits of the widest component, with tight boxes.
3. The inner product of a query with anything in a box is at most the sum of the larger of q*low and q*high over the
   components. A query is searched first in the shard whose box has the largest bound; its kth score there goes along to
   the others, and shards whose bound is below it are not searched.
4. In a tree nodes are visited in the order of their bounds until these fall below the kth score.

Queries travel to a shard in blocks of bounded size. Equal scores go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Vectors in a shard, queries in a block, vectors in a leaf, boxes of shards that are compared with a block at a time.
SHARD, BLOCK, LEAF, BOXES = 16_384, 1_024, 64, 1_024
#: Vectors of each length that the shards' borders are found on, and shards that they tell apart at most.
SAMPLE, SPACES = 8_192, 512
_LAST = np.iinfo(np.int64).max


class KdTree:
    """Vectors are rows of integers in a float64 array, or of Python integers where float64 might round."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        n = len(vectors)
        self.order = np.arange(n)
        low_high, spans, children = [], [], []
        work = [(0, n, -1)]
        while work:
            start, end, parent = work.pop()
            mine = self.order[start:end]
            rows = vectors[mine]
            low, high = rows.min(axis=0), rows.max(axis=0)
            node = len(spans)
            low_high.append((low, high))
            spans.append((start, end))
            children.append([-1, -1])
            if parent >= 0:
                children[parent][children[parent][0] >= 0] = node
            wide = int(np.argmax(high - low))
            if end - start > leaf and high[wide] > low[wide]:  # else all are equal, and any box is tight
                half = (end - start) // 2
                self.order[start:end] = mine[np.argpartition(rows[:, wide].astype(float), half)]
                work += [(start, start + half, node), (start + half, end, node)]
        self.vectors = vectors[self.order]
        self.low, self.high = (np.array([b[k] for b in low_high]) for k in (0, 1))
        self.spans, self.children = np.array(spans, np.int64), np.array(children, np.int64)

    def stored(self) -> dict[str, bytes]:
        """The tree as bytes, for vectors in float64."""
        return {
            "vectors": self.vectors.astype("<f8").tobytes(),
            "boxes": np.concatenate([self.low, self.high]).astype("<f8").tobytes(),
            "shape": np.concatenate([self.spans, self.children]).astype("<i8").tobytes(),
        }

    @staticmethod
    def restored(dim: int, vectors: bytes, boxes: bytes, shape: bytes, whole: bool) -> KdTree:
        """A stored tree; `whole`: with Python integers. `order` is the order of the stored vectors."""
        tree = KdTree.__new__(KdTree)
        tree.vectors = _whole(_matrix(vectors, dim)) if whole else _matrix(vectors, dim)
        tree.low, tree.high = (_whole(x) if whole else x for x in np.split(_matrix(boxes, dim), 2))
        tree.spans, tree.children = np.split(np.frombuffer(shape, "<i8").reshape(-1, 2), 2)
        tree.order = np.arange(len(tree.vectors))
        return tree

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product of each query with each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, bounds: np.ndarray, k: int, ids: np.ndarray, skip: int, least: int | None) -> list[tuple[int, int]]:
        """Up to k (score, row) by falling score, then rising `ids`; row `skip` is left out, scores below `least` too.

        `ids` are in the order of `order`.
        """
        best: list[tuple[int, int, int]] = []  # a heap: the worst first, as (score, -id, row)
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            floor = best[0][0] if len(best) == k else least
            if floor is not None and -bound < floor:
                break
            if self.children[node][0] >= 0:
                for c in self.children[node]:
                    heapq.heappush(heap, (-bounds[c], c))
                continue
            start, end = self.spans[node]
            scores = self.vectors[start:end] @ query
            at = np.arange(start, end)
            keep = self.order[start:end] != skip
            if floor is not None:
                keep &= scores >= floor
            at = at[keep]
            if not len(at):
                continue
            scores = scores[keep].astype(np.int64)
            if len(at) > k:
                first = np.lexsort([ids[at], -scores])[:k]
                at, scores = at[first], scores[first]
            for s, i, row in zip(scores.tolist(), ids[at].tolist(), self.order[at].tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (s, -i, row))
                elif (s, -i) > best[0][:2]:
                    heapq.heapreplace(best, (s, -i, row))
        return [(s, row) for s, _, row in sorted(best, key=lambda b: (-b[0], -b[1]))]


def _matrix(binary: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(binary, "<f8").reshape(-1, dim)


def _whole(vectors: np.ndarray) -> np.ndarray:
    """As Python integers, whose products do not round."""
    return np.array([[int(x) for x in row] for row in vectors], object).reshape(vectors.shape)


def _rounds(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether sums of products of rows might reach what float64 cannot hold."""
    return bool(a.size and b.size and a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) >= 2**52)


def _borders(sample: np.ndarray, leaves: int) -> tuple | int:
    """Nested median splits (component, value, below, from there on) with about `leaves` ends, which are 0."""
    spread = sample.max(axis=0) - sample.min(axis=0) if len(sample) > 1 else np.zeros(1)
    if leaves < 2 or not spread.max() > 0:
        return 0
    wide = int(spread.argmax())
    value = float(np.median(sample[:, wide]))
    below = sample[:, wide] < value
    if not below.any():
        value = float(sample[:, wide][sample[:, wide] > value].min())
        below = sample[:, wide] < value
    return wide, value, _borders(sample[below], leaves // 2), _borders(sample[~below], leaves - leaves // 2)


def _spaces(tree: tuple | int, vectors: np.ndarray) -> np.ndarray:
    """The number of the end of the splits that each vector comes to."""
    out = np.zeros(len(vectors), np.int64)
    work = [(tree, np.arange(len(vectors)), 1)]
    while work:
        node, rows, number = work.pop()
        if not node or not len(rows):
            out[rows] = number
            continue
        wide, value, left, right = node
        below = vectors[rows, wide] < value
        work += [(left, rows[below], 2 * number), (right, rows[~below], 2 * number + 1)]
    return out


def _bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """At least the largest inner product of each query with anything in each box, whatever float64 rounds."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    slack = np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T
    return up @ high.T + down @ low.T + 1e-12 * slack


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score, query_row: for each query row its k best other rows (all, if fewer).

    Components are floor(scale * x), x as double; the score is their inner product as a long. Ties go to the smaller
    `key`; rows without a key come last among ties. Vectors that are null or hold null or non-finite components take no
    part; vectors are compared with those of their own length only, and empty ones with none. `is_query` is a condition
    on `key`. Rows are told apart by where they were staged: a repeated row is a candidate for its twin, and a repeated
    query gives as many results, with the same query_id and different query_row. Other columns are not read.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(key).alias("id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(finite(x), F.lit(False))))
    rows = rows.select("id", "q", F.size("v").alias("dim"), F.transform("v", lambda x: F.rint(F.floor(x * F.lit(float(scale)).cast("double")).cast("double"))).alias("v"))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")

    counts = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    borders: dict[int, tuple | int] = {}
    for dim, n in counts.items():
        if n > SHARD:
            sample = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("row")).limit(SAMPLE).select("v").collect()
            borders[dim] = _borders(np.array([r.v for r in sample]), min(SPACES, -(-n // SHARD)))

    @F.pandas_udf("long")
    def space(dims: pd.Series, vs: pd.Series) -> pd.Series:
        out = np.ones(len(dims), np.int64)
        for dim in set(dims) & set(borders):
            mine = np.flatnonzero(dims.to_numpy() == dim)
            out[mine] = _spaces(borders[dim], np.stack(vs.iloc[mine].to_list()))
        return pd.Series(out)

    rows = rows.withColumn("space", space("dim", "v")) if borders else rows.withColumn("space", F.lit(1).cast("long"))
    sizes = stage(rows.groupBy("dim", "space").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("cuts")), "sizes")
    dealt = rows.join(F.broadcast(sizes), ["dim", "space"]).withColumn("cut", F.pmod(F.xxhash64("row"), "cuts").cast("int"))  # SPACES rows a length

    def built(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        tree = KdTree(np.concatenate([np.asarray(c.flatten()) for c in table.column("v").chunks]).reshape(-1, dim))
        names, places = (table.column(c).fill_null(_LAST).to_numpy()[tree.order].astype("<i8").tobytes() for c in ("id", "row"))
        binary = {"ids": names, "rows": places, "root": np.stack([tree.low[0], tree.high[0]]).astype("<f8").tobytes()} | tree.stored()
        one = {c: table.column(c)[:1] for c in ("dim", "space", "cut")} | {c: pa.array([x], pa.binary()) for c, x in binary.items()}
        return pa.table(one)

    kind = "dim int, space bigint, cut int, ids binary, rows binary, root binary, vectors binary, boxes binary, shape binary"
    columns = ["dim", "space", "cut", "v", F.col("id").cast("long").alias("id"), "row"]
    trees = stage(dealt.select(columns).groupBy("dim", "space", "cut").applyInArrow(built, kind), "trees")

    # Boxes in tables of bounded size meet blocks of the stated queries: (queries / BLOCK) * (shards / BOXES) rows.
    part = F.struct("space", "cut", "root")
    boxes = trees.select("dim", part.alias("box"), (F.floor(F.monotonically_increasing_id() / BOXES)).alias("t")).groupBy("dim", "t").agg(F.collect_list("box").alias("b"))
    asked = rows.where("q").select("dim", "v", F.col("id").cast("long").alias("id"), "row")
    asked = stage(asked.withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK)), "queries")
    blocks = asked.groupBy("dim", "block").agg(F.collect_list(F.struct("row", "id", "v")).alias("q"))

    def bounded(floors: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, queries, table in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                    q, b = queries.values, table.values
                    matrix = q.field("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    roots = np.stack([_matrix(x, dim) for x in b.field("root").to_pylist()])
                    bound = _bounds(matrix, roots[:, 0], roots[:, 1])
                    if floors:  # all shards but the first one that may hold a score as good as the kth
                        least = q.field("floor").to_numpy(zero_copy_only=False)
                        home = [b.field(c).to_numpy()[None, :] == q.field("h" + c).to_numpy(zero_copy_only=False)[:, None] for c in ("space", "cut")]
                        x, y = np.nonzero((bound >= least[:, None]) & ~(home[0] & home[1]))
                    else:
                        x, y = np.arange(len(matrix)), bound.argmax(axis=1)
                    picked = [q.field("row").take(pa.array(x)), b.field("space").take(pa.array(y)), b.field("cut").take(pa.array(y))]
                    yield pa.RecordBatch.from_arrays([*picked, pa.array(bound[x, y])], names=["query_row", "space", "cut", "bound"])

        return run

    place = "query_row bigint, space bigint, cut int, bound double"
    met = lambda b, floors: b.join(boxes, "dim").select("dim", "q", "b").mapInArrow(bounded(floors), place)
    home = met(blocks, False).groupBy("query_row").agg(F.max(F.struct("bound", "space", "cut")).alias("h")).select("query_row", "h.space", "h.cut")
    home = stage(home.withColumn("floor", F.lit(None).cast("double")), "home")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, dim in enumerate(batch.column(0).to_pylist()):
                q, stored = batch.column(1)[i].values, [batch.column(c)[i].as_py() for c in range(2, 7)]
                names, places = (np.frombuffer(x, "<i8") for x in stored[:2])
                queries = q.field("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                whole = _rounds(queries, _matrix(stored[3], dim))
                tree = KdTree.restored(dim, *stored[2:], whole)
                queries = _whole(queries) if whole else queries
                at, bounds = {r: i for i, r in enumerate(places.tolist())}, tree.bounds(queries)
                out: list[list] = [[], [], [], []]
                facts = zip(q.field("row").to_pylist(), q.field("id").to_pylist(), q.field("floor").to_pylist(), strict=True)
                for j, (row, name, floor) in enumerate(facts):
                    for score, r in tree.search(queries[j], bounds[j], k, names, at.get(row, -1), floor):
                        for o, x in zip(out, (row, _LAST if name is None else name, int(names[r]), score), strict=True):
                            o.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["query_row", "query_id", "vec_id", "score"])

    def ask(pairs: DataFrame) -> DataFrame:
        """Each query's best in its shard; `pairs`: query_row, space, cut, floor (a score that is needed, or null)."""
        full = pairs.join(asked.withColumnRenamed("row", "query_row"), "query_row")
        one = F.struct(F.col("query_row").alias("row"), "id", "v", F.col("floor").cast("long").alias("floor"))
        share = F.pmod(F.xxhash64("query_row"), F.ceil(F.col("n") / BLOCK)).cast("int")
        many = pairs.groupBy("space", "cut").agg(F.count("*").alias("n"))
        packs = full.join(many, ["space", "cut"]).groupBy("dim", "space", "cut", share.alias("share")).agg(F.collect_list(one).alias("q"))
        held = packs.join(trees.drop("root"), ["dim", "space", "cut"]).select("dim", "q", "ids", "rows", "vectors", "boxes", "shape")
        return held.mapInArrow(search, "query_row bigint, query_id bigint, vec_id bigint, score bigint")

    first = stage(ask(home), "first")
    kth = first.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") == k).select("query_row", "s")
    known = home.drop("floor").join(kth, "query_row", "left").withColumn("floor", F.coalesce(F.col("s").cast("double"), F.lit(float("-inf"))))
    known = stage(known.select(F.col("query_row").alias("row"), "floor", F.col("space").alias("hspace"), F.col("cut").alias("hcut"), "s"), "floors")
    again = asked.join(known, "row").groupBy("dim", "block").agg(F.collect_list(F.struct("row", "v", "floor", "hspace", "hcut")).alias("q"))
    more = met(again, True).select("query_row", "space", "cut").join(known.select(F.col("row").alias("query_row"), F.col("s").alias("floor")), "query_row")
    every = first.unionByName(ask(stage(more, "more")))
    ranked = every.withColumn("rank", F.expr("cast(row_number() over (partition by query_row order by score desc, vec_id) as int)")).where(F.col("rank") <= k)
    id_of = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    return ranked.select(id_of("query_id").alias("query_id"), "rank", id_of("vec_id").alias("vec_id"), "score", "query_row")
