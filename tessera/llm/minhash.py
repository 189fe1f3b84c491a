"""Near-duplicates by an inverted join of MinHash signature coordinates.

1. Each document gets a signature: for each coordinate the member of its shingle set that a random order puts first.
   Documents of equal sets are one node from here on.
2. Each node is posted under its (coordinate, value) pairs. Two nodes of similarity s agree in each coordinate with
   probability s, so nodes at the threshold or above agree in at least `least` of the `posted` coordinates but for a
   chance of 1e-9. Values are ordered from rare to common: nodes that agree in `least` values share one of the
   posted - least + 1 rarest (prefix). Values of one node alone are skipped, and with them nodes with too few others.
3. Candidate pairs of a posting whose sizes fit are counted over the longer signature; pairs below the match threshold
   drop out, the rest is confirmed on the full shingle sets.

A posting of more than FEW nodes is hot. It is not expanded into pairs: its nodes are compared with a few of them (the
same ones in most postings that they share). Where all its nodes are then connected, nothing in it can change the
components. Nodes of the others are posted once more under the longest signature there is, in which each shingle is a
coordinate: pairs at the threshold must share a shingle of the shorter one's rarest size - overlap + 1 (and of the
longer one's rarest size - share + 1), at places that leave room for the overlap, and their parity maps must not differ
in more bits than the sets may differ in shingles. Documents made from one template,
but not similar enough, share common shingles only, so they do not meet at all. Only postings that still hold several
components give pairs, and only pairs that could join two components: those of rare shingles first, then those of ever
larger postings that are still open, in pieces of bounded size. So no link is lost that could join two components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import fetch, rows_of, stage_blocks
from .common import discard, joined, mix64, shingle_set, stage, utf8, word_hashes, words_of
from .graph import connected_components

POSTED, COORDINATES = 32, 128
#: Nodes up to which a posting gives all its pairs, nodes that those of a hot one are compared with, nodes in a piece of it
#: where pairs are looked for, and in one where rows are looked up.
FEW, HUBS, PIECE, SPLIT = 8, 4, 512, 512
#: Bits of a set's parity map: the parity of the number of its shingles at each place that their hashes give.
BITS = 1024
#: Chance that a pair at the threshold is lost by a count of collisions.
MISS = 1e-9

_RNG = np.random.Generator(np.random.PCG64(97))
_ORDERS = _RNG.integers(0, 2**31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TAGS = _RNG.integers(0, 2**63, POSTED, dtype=np.uint64)
_SALTS = np.array([0, 0x632BE59BD9B4E019], np.uint64)
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def least_matches(coordinates: int, similarity: float) -> int:
    """The largest count that a pair of this similarity stays below with a chance of MISS at most."""
    total, t = 0.0, 0
    while t < coordinates and (total := total + comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)) < MISS:
        t += 1
    return max(t, 1)


def _sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    data, at = joined([t.translate(_LOWER) for t in texts])
    starts, ends, first = words_of(data, at)
    words = word_hashes(data, starts, ends)
    return [shingle_set(words[f:e], width) for f, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def signature(shingles: np.ndarray) -> np.ndarray:
    """For each order, the shingle hash that comes first in it."""
    out = np.empty(COORDINATES, np.uint64)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    step = max(1, min(COORDINATES, (1 << 17) // len(x)))
    for i in range(0, COORDINATES, step):
        out[i : i + step] = shingles[np.multiply.outer(_ORDERS[i : i + step], x).argmin(axis=1)]
    return out


def _signatures(blocks: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = _sets(utf8(part.column(2)), width)
                full = [signature(s) if len(s) else None for s in sets]
                tokens = [None if f is None else mix64(f[:POSTED] ^ _TAGS).view(np.int64) for f in full]
                short = [None if f is None else mix64(f).astype("<u2").tobytes() for f in full]
                h1, h2 = (pa.array([int(mix64(s ^ salt).sum().view(np.int64)) if len(s) else None for s in sets], pa.int64()) for salt in _SALTS)
                columns = [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), h1, h2]
                columns += [pa.array(tokens, pa.list_(pa.int64())), pa.array(short, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["uid", "key", "n_shingles", "h1", "h2", "tokens", "sig"])

    kind, long = blocks.schema["keys"].dataType.elementType, T.LongType()
    fields = [("uid", long), ("key", kind), ("n_shingles", long), ("h1", long), ("h2", long)]
    fields += [("tokens", T.ArrayType(long)), ("sig", T.BinaryType())]
    return rows_of(blocks).mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields]))


def _matching(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in at least `least` coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, COORDINATES) for k in (2, 3))
            alike = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([c.filter(alike) for c in batch.columns[:2]], names=["a", "b"])

    sig = nodes.select("node", "sig")
    both = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _pairs(posts: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of nodes that share a posting and could be linked and join two components.

    `posts`: token, n (nodes of the token), node, size, comp, first (whether its place is in the prefix of the shorter one
    of a pair), and, null where unknown, place (from 0 among the node's shingles, rare ones first) and bits (the parity
    map). A posting is cut into pieces, and two pieces at a time are compared, so no task holds more than that of it.
    """
    pieces = F.ceil(F.col("n") / PIECE).cast("int")
    cut = posts.withColumn("k", F.pmod(F.xxhash64("node"), pieces).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), pieces - 1)))
    member = F.struct("node", "size", "comp", "place", "first", "bits")
    sides = [F.when(F.col("k") <= F.col("o"), member).alias("x"), F.when(F.col("k") >= F.col("o"), member).alias("y")]
    cut = cut.select("token", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), *sides)
    met = cut.groupBy("token", "i", "j").agg(F.collect_list("x").alias("x"), F.collect_list("y").alias("y"))

    def fits(x: Column, y: Column) -> Column:
        short, long = F.least(x["size"], y["size"]), F.greatest(x["size"], y["size"])
        overlap = F.ceil(percent * (short + long) / (100 + percent))
        room = F.least(x["size"] - x["place"], y["size"] - y["place"]) >= overlap
        in_prefix = (x["first"] & (x["size"] <= y["size"])) | (y["first"] & (y["size"] <= x["size"]))
        apart = (x["comp"] != y["comp"]) & ((F.col("i") != F.col("j")) | (x["node"] < y["node"]))
        near = apart & (100 * short >= percent * long) & F.coalesce(room & in_prefix, F.lit(True))
        differ = F.aggregate(F.zip_with(x["bits"], y["bits"], lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, d: n + d)
        return F.when(near, F.coalesce(differ <= short + long - 2 * overlap, F.lit(True))).otherwise(False)

    ends = lambda x, y: F.struct(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b"))
    both = F.flatten(F.transform("x", lambda x: F.transform(F.filter("y", lambda y: fits(x, y)), lambda y: ends(x, y))))
    return met.select(F.explode(both).alias("pair")).select("pair.a", "pair.b").distinct()


def _meeting(posts: DataFrame, facts: DataFrame, *keys: str) -> DataFrame:
    """`posts` joined with rows of `facts` on `keys`; both have upper, a bound on a token's rows, by which hot ones are split."""
    pieces = F.ceil(F.col("upper") / SPLIT).cast("int")
    spread = facts.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("upper")
    return posts.withColumn("piece", F.pmod(F.xxhash64("node"), pieces).cast("int")).join(spread, [*keys, "piece"]).drop("piece")


def _star_pairs(posts: DataFrame, percent: int, salt: int) -> DataFrame:
    """Distinct pairs (a, b) of each node of a posting with a few nodes of about its size and other components."""
    steps = 1 / log(100 / percent) if percent < 100 else 1e6  # sizes of linked nodes are one step apart at most
    sized = posts.withColumn("step", F.floor(F.log(F.col("size").cast("double")) * steps))
    drawn = F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(HUBS))
    least = F.min(F.struct(F.xxhash64("node", F.lit(~salt)).alias("order"), "node", "size", "comp"))
    hubs = sized.groupBy("token", "step", drawn.alias("drawn")).agg(least.alias("hub"), F.max("upper").alias("upper"))
    near = 100 * F.least("size", "hub.size") >= percent * F.greatest("size", "hub.size")
    met = _meeting(sized, hubs.drop("drawn"), "token", "step").where((F.col("comp") != F.col("hub.comp")) & near)
    return met.select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()


def _with_components(posts: DataFrame, found: DataFrame) -> DataFrame:
    return posts.join(found, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")


def _open(posts: DataFrame) -> DataFrame:
    """The rows of postings that hold several components and a place in a prefix, with n, their number of nodes."""
    facts = [F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("first").alias("any"), F.max("upper").alias("upper")]
    return _meeting(posts, posts.groupBy("token").agg(*facts).where("low <> high and any").select("token", "n", "upper"), "token")


def _linked(likely: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (s, t) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                s, t = s.values.to_numpy(), t.values.to_numpy()
                both = len(np.intersect1d(s, t, assume_unique=True))
                good[i] = 100 * both >= percent * (len(s) + len(t) - both)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:2]], names=["a", "b"])

    mine = sets.select("node", "shingles")
    both = likely.join(mine.toDF("a", "sa"), "a").join(mine.toDF("b", "sb"), "b")
    return stage(both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint"), "links")


def _shingles(nodes: DataFrame, blocks: DataFrame, width: int) -> DataFrame:
    """node, shingles (sorted hashes) and bits (parity map) of the given nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = _sets(utf8(part.column(1)), width)
                columns = [pa.array([np.sort(s.view(np.int64)) for s in sets], pa.list_(pa.int64())), pa.array(map(_parity, sets), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["node", "shingles", "bits"])

    return fetch(blocks, nodes.select(F.col("node").alias("uid"))).mapInArrow(run, "node bigint, shingles array<bigint>, bits array<bigint>")


def _parity(shingles: np.ndarray) -> np.ndarray:
    counts = np.bincount((shingles % np.uint64(BITS)).astype(np.int64), minlength=BITS)
    return np.packbits(counts.astype(np.uint8) & 1).view(np.int64)


def _long_posts(sets: DataFrame, percent: int) -> DataFrame:
    """token, upper, node, size, place, first: each node under the rarest of its shingles, as many as a prefix needs.

    Shingles of one node alone come first and take places, but are not posted.
    """
    every = sets.select("node", F.explode("shingles").alias("token"))
    counts = stage(every.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    known = every.join(counts, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("ranked"))
    size = F.col("size")
    # Of the overlap that a link needs: with a node as long at least, and with any.
    longer, any_ = F.floor((2 * percent * size + 99 + percent) / (100 + percent)), F.floor((percent * size + 99) / 100)
    placed = sets.select("node", F.size("shingles").alias("size")).join(known, "node").withColumn("alone", size - F.size("ranked"))
    wanted = F.greatest(size - any_ + 1 - F.col("alone"), F.lit(0)).cast("int")
    posts = placed.select("node", "size", "alone", longer.alias("longer"), F.posexplode(F.slice("ranked", F.lit(1), wanted)).alias("at", "r"))
    place = (F.col("alone") + F.col("at")).cast("int")
    first = place < size - F.col("longer") + 1
    out = stage(posts.select("r.token", F.col("r.n").alias("upper"), "node", "size", place.alias("place"), first.alias("first")), "posts")
    discard(counts)
    return out


def _components_of(links: DataFrame, found: DataFrame) -> DataFrame:
    edges = links.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return stage(connected_components(edges), "components")


def _rest(hot: DataFrame, found: DataFrame, nodes: DataFrame, blocks: DataFrame, width: int, percent: int) -> DataFrame:
    """`found` (node, component) with what links between nodes of hot postings (token, upper, node) join beyond it."""
    match = least_matches(COORDINATES, percent / 100)
    opened = _open(_with_components(hot, found).withColumn("first", F.lit(True))).select("node").distinct()
    sets = stage(_shingles(opened, blocks, width), "sets")
    posts = _long_posts(sets, percent)
    for salt in count(1):  # rare shingles first: what they connect need not be compared in the hot postings
        few = FEW ** salt
        left = stage(_open(_with_components(posts, found)), "open")
        mapped = left.where(F.col("n") <= few).join(sets.select("node", "bits"), "node")
        pairs = _pairs(mapped, percent).unionByName(_star_pairs(left.where(F.col("n") > few), percent, salt))
        likely = stage(_matching(pairs.distinct(), nodes, match), "matching")
        links = _linked(likely, sets, percent)
        last = left.where(F.col("n") > few).isEmpty()
        if not links.isEmpty():
            found = _components_of(links, found)
        discard(left, likely, links)
        if last:
            break
    discard(sets, posts)
    return found


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, uid, n_shingles, component_id, kept of each row of `docs`.

    A-Z are lower-cased; words are runs of bytes other than 0x20 and 0x09-0x0D; a row's set holds the distinct runs of
    `width` words, or the whole sequence where words are fewer. Rows are linked when 100 * intersection >= percent *
    union. component_id is the smallest key reachable over links, kept says whether it is the row's own, uid numbers
    rows. Null and empty texts, and texts of white space only, have empty sets and no links. Equal rows share a
    component; so do rows of one key, if their texts are linked, and each of them is then kept. A null key counts as
    larger than all others. Columns other than `key` and `text` are not read. An empty table gives an empty result.
    """
    blocks = stage_blocks(docs, key, text)
    out = _grouped(blocks, width, percent).withColumnRenamed("key", key)
    discard(blocks)
    return out


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, all their columns, of which one of each group of near-duplicates stays; see `near_duplicates`.

    The one with the smallest key stays; of equal keys, and of null keys where a group has no other, any one.
    """
    others = [c for c in docs.columns if c != text]
    blocks = stage_blocks(docs.select(F.struct(*(F.col(c) for c in others)).alias("row"), text), "row", text)
    found = _grouped(blocks.withColumn("keys", F.transform("keys", lambda row: row[key])), width, percent)
    one = found.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "uid")).alias("first"))
    kept = fetch(blocks, one.select("first.uid"), with_keys=True)
    return kept.select(*(F.col("text").alias(c) if c == text else F.col("key")[c].alias(c) for c in docs.columns))


def _grouped(blocks: DataFrame, width: int, percent: int) -> DataFrame:
    """key, uid, n_shingles, component_id, kept, root (a number of the component) of each row of `blocks`, staged."""
    signed = stage(_signatures(blocks, width), "signatures")
    rows = stage(signed.select("uid", "key", "n_shingles", "h1", "h2"), "rows")
    full = rows.where("n_shingles > 0")
    groups = stage(full.groupBy("h1", "h2").agg(F.min("uid").alias("node"), F.min("key").alias("least_key")), "groups")
    one = signed.select(F.col("uid").alias("node"), F.col("n_shingles").alias("size"), "tokens", "sig")
    nodes = stage(one.join(groups.select("node"), "node"), "nodes")
    discard(signed)

    posts = _short_posts(nodes, percent)
    pairs = _pairs(posts.where(F.col("n") <= FEW), percent).unionByName(_star_pairs(posts.where(F.col("n") > FEW), percent, 0)).distinct()
    likely = stage(_matching(pairs, nodes, least_matches(COORDINATES, percent / 100)), "matching")
    ends = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = stage(_shingles(ends, blocks, width), "sets")
    links = _linked(likely, sets, percent)
    found = stage(connected_components(links), "components")
    discard(likely, sets, links)
    found = _rest(posts.where(F.col("n") > FEW).select("token", "upper", "node"), found, nodes, blocks, width, percent)
    discard(nodes, posts)

    placed = stage(groups.join(found, "node", "left").select("h1", "h2", "least_key", F.coalesce("component", "node").alias("root")), "placed")
    ids = stage(placed.groupBy("root").agg(F.min("least_key").alias("component_id")), "ids")
    named = placed.join(ids, "root").select("h1", "h2", "root", "component_id")
    out = full.join(named, ["h1", "h2"]).drop("h1", "h2")
    empty = rows.where("n_shingles = 0").select("uid", "key", "n_shingles", F.col("uid").alias("root"), F.col("key").alias("component_id"))
    columns = ["key", "uid", "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"), "root"]
    out = stage(out.unionByName(empty).select(*columns), "duplicates")
    discard(rows, groups, found, placed, ids)
    return out


def _short_posts(nodes: DataFrame, percent: int) -> DataFrame:
    """token, n, upper, node, size, comp, place, first, bits: each node under the rarest of its coordinates' values.

    Of all values the rarest posted - least + 1 are needed; those of one node alone are among them and come first.
    """
    least = least_matches(POSTED, percent / 100)
    tokens = nodes.select("node", "size", F.explode("tokens").alias("token"))
    counts = stage(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    known = tokens.join(counts, "token").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("ranked"))
    rarest = F.slice("ranked", F.lit(1), F.size("ranked") - least + 1)
    prefix = known.where(F.size("ranked") >= least).select("node", "size", F.explode(rarest).alias("r"))
    prefix = stage(prefix.select("node", "size", "r.token", F.col("r.n").alias("upper")), "prefix")
    shared = prefix.groupBy("token").agg(F.count("*").alias("n"), F.max("upper").alias("upper")).where("n > 1")
    plain = [F.col("node").alias("comp"), F.lit(None).cast("int").alias("place"), F.lit(True).alias("first"), F.lit(None).cast("array<bigint>").alias("bits")]
    posts = stage(_meeting(prefix, shared, "token").select("token", "n", "upper", "node", "size", *plain), "posts")
    discard(counts, prefix)
    return posts
