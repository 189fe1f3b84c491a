"""Sharding by fixed virtual slots.

A record's hash puts it into one of thousands of virtual slots, for good. Bytes are summed by slot; a versioned map says
which shard holds which slot. Rebalancing and growing edit the map: a few slots move, and with them their records; no
other record does.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, shared_dir, stage

#: Virtual slots, and parts that a slot of average size has, in which its rows are numbered: fixed, whatever the input.
SLOTS, PARTS = 6144, 8


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each virtual slot. `moved` counts the slots that the last edit moved."""

    version: int
    n_shards: int
    shards: tuple[int, ...]
    moved: int = 0

    @staticmethod
    def initial(n_shards: int, n_slots: int = SLOTS) -> SlotMap:
        return SlotMap(1, n_shards, tuple(int(k) for k in np.arange(n_slots) * n_shards // n_slots))

    def loads(self, bytes_by_slot: np.ndarray) -> np.ndarray:
        return np.bincount(self.shards, weights=bytes_by_slot, minlength=self.n_shards)

    def rebalanced(self, bytes_by_slot: np.ndarray, tolerance: float = 0.001) -> SlotMap:
        """The next version: slots move from the heaviest to the lightest shard while that brings the two closer.

        It stops when the heaviest exceeds the lightest by at most `tolerance` of the mean, or no move or exchange of
        two slots helps.
        """
        size = np.asarray(bytes_by_slot, np.float64)
        shards = np.array(self.shards)
        load = self.loads(size)
        for _ in range(20 * len(shards)):
            heavy, light = int(load.argmax()), int(load.argmin())
            gap = load[heavy] - load[light]
            if gap <= tolerance * load.mean():
                break
            mine, theirs = np.flatnonzero(shards == heavy), np.flatnonzero(shards == light)
            gain = size[mine][:, None] - np.r_[0.0, size[theirs]][None, :]  # column 0: a move, else an exchange
            off = np.abs(gain - gap / 2)
            off[(gain <= 0) | (gain >= gap)] = np.inf
            i, j = np.unravel_index(off.argmin(), off.shape)
            if not np.isfinite(off[i, j]):
                break
            shards[mine[i]] = light
            if j:
                shards[theirs[j - 1]] = heavy
            load[heavy] -= gain[i, j]
            load[light] += gain[i, j]
        return replace(self, version=self.version + 1, shards=tuple(shards.tolist()), moved=int((shards != self.shards).sum()))

    def grown(self, bytes_by_slot: np.ndarray) -> SlotMap:
        """The next version with one more shard, which takes slots from the heaviest ones until it holds its share."""
        size = np.asarray(bytes_by_slot, np.float64)
        shards, new = np.array(self.shards), self.n_shards
        load = np.append(self.loads(size), 0.0)
        share = load.sum() / (new + 1)
        open_ = np.ones(new, bool)  # shards that may still have a slot that fits
        while open_.any():
            heavy = int(np.where(open_, load[:new], -1).argmax())
            mine = np.flatnonzero(shards == heavy)
            fits = mine[(size[mine] > 0) & (load[new] + size[mine] <= share * 1.001)]
            if not len(fits):
                open_[heavy] = False
                continue
            k = fits[np.abs(size[fits] - np.median(size[fits])).argmin()]
            shards[k] = new
            load[heavy] -= size[k]
            load[new] += size[k]
        return SlotMap(self.version + 1, new + 1, tuple(shards.tolist()), int((shards != self.shards).sum()))

    def write(self, folder: str) -> str:
        """Store this version as JSON under a temporary name first; returns its path."""
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        name = f"{base}/slots-v{self.version:06d}.json"
        with system.open_output_stream(f"{name}.tmp") as f:
            f.write(json.dumps({"version": self.version, "n_shards": self.n_shards, "shards": self.shards}).encode())
        system.move(f"{name}.tmp", name)
        return name

    @staticmethod
    def read(path: str) -> SlotMap:
        system, name = file_system(path)
        with system.open_input_stream(name) as f:
            d = json.loads(f.read())
        return SlotMap(d["version"], d["n_shards"], tuple(d["shards"]))


def shard(docs: DataFrame, n_shards: int = 24, key: str = "doc_id", text: str = "text", folder: str | None = None, slots: SlotMap | None = None) -> DataFrame:
    """`key`, size, text_crc32, virtual (slot), shard and slot (place in its shard, from 0 without gaps) of each row.

    size is the text's bytes in UTF-8 plus 8; a null text has none, and its crc32 is 0. The hash is over `key` and the
    text's crc32, so rows that share a null or repeated key are spread. The map given, or the first one, is rebalanced
    by bytes, so sizes of shards come out near equal; both versions are stored in `folder` (by default a new shared
    one). Equal rows are in one virtual slot, but dealt to its parts one by one, and numbered in any order. Other columns are not read. An empty table
    gives an empty result and a map that nothing moved in.
    """
    text_col = F.coalesce(F.col(text).cast("string"), F.lit(""))
    size = (F.octet_length(text_col) + F.lit(8)).cast("long")
    rows = docs.select(F.col(key).alias("key"), size.alias("size"), F.crc32(text_col.cast("binary")).alias("text_crc32"))
    n_slots = len(slots.shards) if slots else SLOTS
    virtual = F.pmod(F.xxhash64("key", "text_crc32"), F.lit(n_slots)).cast("int")
    rows = stage(rows.select("*", virtual.alias("virtual"), F.xxhash64(F.monotonically_increasing_id()).alias("spread")), "records")

    first = slots or SlotMap.initial(n_shards, n_slots)
    sums = rows.groupBy("virtual").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).toPandas()  # n_slots rows at most
    by_slot = np.bincount(sums.virtual.to_numpy(int), weights=sums.bytes.to_numpy(float), minlength=n_slots) if len(sums) else np.zeros(n_slots)
    final = first.rebalanced(by_slot)
    folder = folder or shared_dir(docs.sparkSession, "slots")
    first.write(folder)
    final.write(folder)

    # A slot has as many parts as it has shares of the rows, so that one with many equal rows is numbered by many tasks.
    share = max(1, int(sums.n.sum()) // (n_slots * PARTS))
    spark = docs.sparkSession
    parts = spark.createDataFrame([(int(v), -(-int(n) // share)) for v, n in zip(sums.virtual, sums.n, strict=True)], "virtual int, parts int")
    rows = rows.join(F.broadcast(parts), "virtual").withColumn("part", F.pmod("spread", "parts").cast("int"))
    counts = rows.groupBy("virtual", "part").agg(F.count("*").alias("n")).toPandas()  # n_slots * (PARTS + 1) rows at most
    counts["shard"] = np.array(final.shards, int)[counts.virtual.to_numpy(int)]
    counts = counts.sort_values(["shard", "virtual", "part"])
    counts["before"] = counts.groupby("shard").n.cumsum() - counts.n
    found = [tuple(map(int, r)) for r in counts[["virtual", "part", "shard", "before"]].itertuples(index=False)]
    offsets = spark.createDataFrame(found, "virtual int, part int, shard int, before bigint")
    placed = rows.join(F.broadcast(offsets), ["virtual", "part"])
    order = "row_number() over (partition by virtual, part order by key, text_crc32, size)"
    return placed.select(F.col("key").alias(key), "size", "text_crc32", "virtual", "shard", (F.col("before") + F.expr(order) - 1).alias("slot"))
