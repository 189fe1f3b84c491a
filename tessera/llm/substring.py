"""Removal of word runs that occur more than once, found by difference-cover anchors.

A window is `window` consecutive words. Every window contains, for each residue pair, an anchor: positions whose number
modulo `period` is in a difference cover. For any two places i and j there is a shift d < period for which i + d and
j + d are both cover positions, so two equal windows share an anchor of window - period + 1 words at the same shift.

1. Each block of documents posts the hashes of its anchors, each hash once; a hash seen in two blocks, or twice in
   one, is marked. The marks go back as bit masks in the order of posting.
2. Windows that hold a marked anchor are extended to their whole length: their 127-bit hashes are posted and marked in
   the same way. So windows are judged by all their words, without pairs of places.
3. Words covered by a marked window go.

A run that a third of all documents share is posted once for each block, never gathered by document. Equality of
windows is equality of 127-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import stage_blocks
from .common import joined, mix64, run_hashes, stage, utf8, word_hashes, words_of

#: A perfect difference set modulo 21: the differences of its members are all residues.
PERIOD, COVER = 21, (0, 1, 6, 8, 18)
#: Bytes of text for each bucket of hashes, so that a bucket's hashes, a third of that or less, fit in a task.
BUCKET_BYTES = 128 << 20


class _Block:
    """Words, anchors and windows of one block's texts."""

    def __init__(self, texts: list[bytes], window: int, period: int, cover: tuple[int, ...]):
        self.data, at = joined(texts)
        self.starts, self.ends, self.first = words_of(self.data, at)
        self.words = word_hashes(self.data, self.starts, self.ends)
        n = len(self.words)
        self.window, self.anchor = window, window - period + 1
        lengths = np.diff(self.first)
        self.begin = np.repeat(self.first[:-1], lengths)  # of each word's document
        left = np.repeat(self.first[1:], lengths) - np.arange(n)  # words from here to its end
        inside = np.arange(n) - self.begin
        chosen = np.zeros(period, bool)
        chosen[list(cover)] = True
        long = np.repeat(lengths >= window, lengths)
        self.anchors = np.flatnonzero(long & chosen[inside % period] & (left >= self.anchor))
        self.whole = left >= window
        hashes = run_hashes(self.words, self.anchor)
        self.anchor_post = _Post(hashes[self.anchors], None)

    def candidates(self, marked: np.ndarray) -> None:
        """Windows that hold a marked anchor; marked has a flag for each anchor."""
        n = len(self.words)
        places = self.anchors[marked]
        low = np.maximum(places - (self.window - self.anchor), self.begin[places])
        self.windows = np.flatnonzero(_covered(n, low, places + 1) & self.whole)
        self.window_post = _Post(run_hashes(self.words, self.window)[self.windows], run_hashes(mix64(self.words ^ np.uint64(0x5851F42D4C957F2D)), self.window)[self.windows])

    def removed(self, marked: np.ndarray) -> np.ndarray:
        places = self.windows[marked]
        return _covered(len(self.words), places, places + self.window)


def _covered(n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of n positions lie in one of the intervals [low, high)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, low, 1)
    np.add.at(step, high, -1)
    return np.cumsum(step[:-1]) > 0


class _Post:
    """A block's hashes, each once and in a fixed order, dealt to buckets; the last bit says that it has it twice."""

    def __init__(self, first: np.ndarray, second: np.ndarray | None):
        kind = [("a", "<u8")] if second is None else [("a", "<u8"), ("b", "<u8")]
        rows = np.empty(len(first), kind)
        one = np.uint64(1)
        rows["a"] = first if second is not None else first & ~one
        if second is not None:
            rows["b"] = second & ~one
        order = np.lexsort([rows[k[0]] for k in reversed(kind)])
        rows = rows[order]
        new = np.ones(len(rows), bool)
        new[1:] = rows[1:] != rows[:-1]
        at = np.cumsum(new) - 1
        self.place = np.empty(len(rows), np.int64)  # of each hash in the posted order
        self.place[order] = at
        self.rows = rows[new]
        twice = np.bincount(at, minlength=len(self.rows)) > 1
        self.rows[kind[-1][0]] |= twice.astype(np.uint64)

    def dealt(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        bucket = ((self.rows["a"] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            yield k, self.rows[edges[k] : edges[k + 1]]

    def flags(self, masks: list[dict], buckets: int) -> np.ndarray:
        """For each hash given at first: whether it was marked."""
        have = {m["bucket"]: m["mask"] for m in masks or ()}
        marked = np.zeros(len(self.rows), bool)
        done = 0
        for k, rows in self.dealt(buckets):
            if k in have:
                marked[done : done + len(rows)] = np.unpackbits(np.frombuffer(have[k], np.uint8), count=len(rows))
            done += len(rows)
        return marked[self.place]


def _mark(posts: DataFrame, wide: bool) -> DataFrame:
    """block, masks: for each block the bit masks of its posted hashes that occur anywhere else."""
    kind = [("a", "<u8"), ("b", "<u8")] if wide else [("a", "<u8")]
    last = kind[-1][0]

    def reduce(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), kind) for c in table.column("posts").chunks for x in c]
        sizes = [len(p) for p in parts]
        rows = np.concatenate(parts)
        own = (rows[last] & np.uint64(1)).astype(bool)
        rows[last] &= ~np.uint64(1)
        order = np.lexsort([rows[k[0]] for k in reversed(kind)])
        ranked = rows[order]
        same = ranked[1:] == ranked[:-1]
        hit = np.zeros(len(rows), bool)
        hit[1:] |= same
        hit[:-1] |= same
        marked = own.copy()
        marked[order] |= hit
        out: list[tuple] = []
        for block, bucket, mask in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), np.split(marked, np.cumsum(sizes)[:-1]), strict=True):
            if mask.any():
                out.append((block, bucket, np.packbits(mask).tobytes()))
        return pa.Table.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], names=["block", "bucket", "mask"])

    marks = posts.groupBy("bucket").applyInArrow(reduce, "block bigint, bucket int, mask binary")
    return marks.groupBy("block").agg(F.collect_list(F.struct("bucket", "mask")).alias("masks"))


def remove_repeats(docs: DataFrame, window: int = 35, key: str = "doc_id", text: str = "text", period: int = PERIOD, cover: tuple[int, ...] = COVER, untouched: bool = False) -> DataFrame:
    """`key`, n_words, n_removed and kept (string) of each row of `docs`.

    Words are runs of bytes other than 0x20 and 0x09-0x0D. Each word goes that a window covers whose word sequence
    also starts anywhere else, in the same text or another; windows are judged on the input. Kept words are joined by
    one space; with `untouched`, texts that lose nothing come back as they were. A null or empty text has no words and
    gives an empty string; so does a text whose words all go. Rows are told apart by where they were staged, so repeated and null keys are rows of their own, and two equal rows of at
    least `window` words remove each other. Columns other than `key` and `text` are not read. An empty table gives an
    empty result.
    """
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("cover is no difference cover modulo period")
    if not period <= window:
        raise ValueError("period must not exceed window")
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    blocks = stage_blocks(docs, key, text)
    size = blocks.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))

    def posts(hashes: Callable[[pa.RecordBatch, int], _Post]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    out = list(hashes(batch, i).dealt(buckets))
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([batch.column(0)[i].as_py()] * len(out), pa.int64()), pa.array([r.tobytes() for _, r in out], pa.binary())], names=["bucket", "block", "posts"])

        return run

    def anchors(batch: pa.RecordBatch, i: int) -> _Post:
        return _Block(utf8(batch.column(1)[i].values), window, period, cover).anchor_post

    def windows(batch: pa.RecordBatch, i: int) -> _Post:
        b = _Block(utf8(batch.column(1)[i].values), window, period, cover)
        b.candidates(b.anchor_post.flags(batch.column(2)[i].as_py(), buckets))
        return b.window_post

    schema = "bucket int, block bigint, posts binary"
    near = stage(_mark(blocks.select("block", "texts").mapInArrow(posts(anchors), schema), wide=False), "anchors")
    extended = blocks.join(near, "block").select("block", "texts", "masks").mapInArrow(posts(windows), schema)
    equal = stage(_mark(extended, wide=True), "windows")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, texts, near_masks, equal_masks = (c[i] for c in batch.columns)
                b = _Block(utf8(texts.values), window, period, cover)
                gone = np.zeros(len(b.words), bool)
                if near_masks.is_valid and equal_masks.is_valid:
                    b.candidates(b.anchor_post.flags(near_masks.as_py(), buckets))
                    gone = b.removed(b.window_post.flags(equal_masks.as_py(), buckets))
                stay, counts = ~gone, np.zeros(len(gone) + 1, np.int64)
                np.cumsum(gone, out=counts[1:])
                all_words, kept = b.data.split(), []
                for f, e, whole in zip(b.first[:-1].tolist(), b.first[1:].tolist(), utf8(texts.values), strict=True):
                    if counts[e] > counts[f]:
                        kept.append(b" ".join(compress(all_words[f:e], stay[f:e].tolist())))
                    else:
                        kept.append(whole if untouched else b" ".join(all_words[f:e]))
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(np.diff(b.first), pa.int64()), pa.array(np.diff(counts[b.first]), pa.int64()), pa.array(kept, pa.string())], names=["key", "n_words", "n_removed", "kept"])

    judged = blocks.join(near.withColumnRenamed("masks", "near"), "block", "left").join(equal.withColumnRenamed("masks", "equal"), "block", "left")
    return judged.select("keys", "texts", "near", "equal").mapInArrow(cut, T.StructType([T.StructField("key", kind), *(T.StructField(n, T.LongType()) for n in ("n_words", "n_removed")), T.StructField("kept", T.StringType())])).withColumnRenamed("key", key)


def without_repeats(docs: DataFrame, window: int = 35, text: str = "text", chars: str | None = None) -> DataFrame:
    """The rows of `docs`, all their columns, without repeated word runs in `text`; see `remove_repeats`.

    Rows go that had words and lose all of them. Texts that lose nothing stay as they are, null becomes empty. `chars`
    names a column that has the text's length in characters; it follows the text.
    """
    others = [c for c in docs.columns if c != text]
    packed = docs.select(F.struct(*(F.col(c) for c in others)).alias("row"), text)
    done = remove_repeats(packed, window, "row", text, untouched=True).where("n_words = 0 or n_removed < n_words")
    columns = {c: F.col("row")[c] for c in others} | {text: F.col("kept")}
    if chars is not None:
        columns[chars] = F.when(F.col("n_removed") > 0, F.char_length("kept").cast(docs.schema[chars].dataType)).otherwise(columns[chars])
    return done.select(*(columns[c].alias(c) for c in docs.columns))


def digests(removed: DataFrame, key: str = "doc_id") -> DataFrame:
    return removed.select(key, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
