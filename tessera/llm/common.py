"""Helpers that the operators of this package share: shared folders, staged tables, hashing of words."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as the contracts fix it.
SPACES = b" \t\n\v\f\r"
#: Folders that `stage` and `stage_blocks` wrote and nothing has deleted yet, with the table's name where it is one.
_SCRATCH: dict[str, str | None] = {}


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder's URI under `spark.checkpoint.dir`, which driver and executors see alike.

    Only on a single machine, as in tests, is a temporary folder used where that setting is missing; a cluster raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _context_dir(spark)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def _context_dir(spark: SparkSession) -> str | None:
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get() if found.isDefined() else None


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """`df` written to the shared folder and read back: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    _SCRATCH[path] = None
    return out


def discard(*staged: DataFrame) -> None:
    """Delete what was staged for these frames; nothing that is still to be computed may need it."""
    for df in staged:
        _delete(df.sparkSession, df.staged_at)


def clean(spark: SparkSession, *keep: DataFrame) -> None:
    """Delete all that this process staged, folders and tables, but for `keep`: for when results are written."""
    kept = {df.staged_at for df in keep}
    for path in [p for p in _SCRATCH if p not in kept]:
        _delete(spark, path)


def scratch_table(path: str, name: str) -> None:
    """Note that the table `name` was staged at `path`."""
    _SCRATCH[path] = name


def _delete(spark: SparkSession, path: str) -> None:
    table = _SCRATCH.pop(path, None)
    if table:
        spark.sql(f"drop table if exists {table}")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI, on whichever machine this runs."""
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri) if not uri.startswith("file:") else uri)


def commit_files(manifest: DataFrame, root: str) -> None:
    """Rename each file that `manifest` (temporary, name) lists to its final name under `root`.

    The manifest is a staged table, so it holds the files of successful attempts only. Renaming is idempotent: a
    second attempt finds the final name and leaves it. What failed attempts left behind goes with the folder `_tmp`.
    """

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(root)
        for batch in batches:
            done = []
            for temporary, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if system.get_file_info(f"{base}/{name}").type == fs.FileType.NotFound:
                    system.move(f"{base}/{temporary}", f"{base}/{name}")
                done.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["name"])

    manifest.select("temporary", "name").mapInArrow(rename, "name string").write.format("noop").mode("overwrite").save()
    system, base = file_system(root)
    if system.get_file_info(f"{base}/_tmp").type != fs.FileType.NotFound:
        system.delete_dir(f"{base}/_tmp")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


# -- words and their hashes -------------------------------------------------------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 2**64)
#: Odd multipliers for the words of a shingle.
_PLACES = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int, _kept: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """1, base, base^2 ... modulo 2^64, kept between calls."""
    have = _kept.get(base)
    if have is None or len(have) < n:
        out = np.empty(max(n, 1 << 16), np.uint64)
        out[0], done = 1, 1
        while done < len(out):
            step = min(done, len(out) - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 2**64))
            done += step
        have = _kept[base] = out
    return have[:n]


def utf8(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.binary()).to_pylist()


def joined(parts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The texts (UTF-8), each followed by a line feed, and where each begins (one more entry: the end)."""
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=at[1:])
    return b"\n".join(parts) + b"\n" * bool(parts), at


def words_of(data: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts as `joined` gives them: where each word starts and ends, and each text's first word (and the end).

    A word is a run of bytes other than 0x20 and 0x09-0x0D.
    """
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    solid = np.ones(len(raw) + 1, bool)
    solid[0] = False
    np.not_equal(raw, 32, out=solid[1:])
    solid[1:] &= (raw - np.uint8(9)) > 4
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edge[::2], edge[1::2]
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial over random values of the bytes, from prefix sums."""
    out = np.empty(len(starts), np.uint64)
    raw = np.frombuffer(data, np.uint8)
    i = 0
    while i < len(starts):  # in slices, so that the tables stay small
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + (1 << 20), "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[raw[low:high]] * powers(_R, high - low), out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * powers(_R_INV, high - low)[s] + (e - s).astype(np.uint64)
        i = j
    return mix64(out)


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` words, len(words) - width + 1 of them, from prefix sums."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_R, len(words)), out=sums[1:])
    return mix64((sums[width:] - sums[:n]) * powers(_R_INV, len(words))[:n])


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct hashes of runs of `width` words, sorted; with fewer words the whole sequence is one run."""
    if not len(words):
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return mix64((words * _PLACES[: len(words)]).sum(keepdims=True) + np.uint64(len(words)))
    n = len(words) - width + 1
    total = words[:n] * _PLACES[0]
    for k in range(1, width):
        total = total + words[k : k + n] * _PLACES[k]
    return np.unique(mix64(total))
