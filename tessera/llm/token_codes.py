"""Token ids in directly addressable codes: random access to any id without decoding a block.

An id is cut into chunks of 8 bits. Level 0 has the lowest chunk of every id; a bitmap says which ids go on, and their
next chunks form level 1, in order, with a bitmap of its own, and so on. A directory has the count of ones before each
512 bits of a bitmap, so the place of an id's next chunk is one look-up and a count within 64 bytes.

A file has the documents of one range of keys in ascending order. Layout, all integers little-endian:
  8 bytes magic, 8 bytes length of the header, header (JSON: counts, levels and where each part starts),
  keys (8 bytes each), whether each is null (1 byte each), start of each document in ids of this file (8 bytes each, one
  more for the end), then for each level: chunks, bitmap, directory.
"""

from __future__ import annotations

import json
import os
import string
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import commit_files, file_system, shared_dir, stage, text_or_empty

MAGIC = b"TDACODE1"
#: Ids in a file; a document is never split.
FILE_IDS = 4_000_000
#: Bits between entries of a directory.
STRIDE = 512
#: Kept words in a worker; beyond it the table starts anew. It bounds memory, not results.
CACHE = 1_200_000
PUNCTUATION = string.punctuation


def pack(keys: list[int | None], documents: list[np.ndarray]) -> bytes:
    """A file's bytes."""
    starts = np.zeros(len(documents) + 1, "<i8")
    np.cumsum([len(d) for d in documents], out=starts[1:])
    rest = np.concatenate(documents).astype("<u4") if documents else np.zeros(0, "<u4")
    parts = [np.array([k or 0 for k in keys], "<i8").tobytes(), bytes(k is None for k in keys), starts.tobytes()]
    levels = []
    while len(rest) or not levels:
        on = rest > 255
        bits = np.packbits(on, bitorder="little").tobytes()
        bits += bytes(-len(bits) % (STRIDE // 8))
        ones = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").reshape(-1, STRIDE).sum(axis=1, dtype="<u8")
        directory = np.zeros(len(ones) + 1, "<u8")
        np.cumsum(ones, out=directory[1:])
        parts += [(rest & 255).astype(np.uint8).tobytes(), bits, directory.tobytes()]
        levels.append(len(rest))
        rest = rest[on] >> 8
    at, places = 0, []
    for p in parts:
        places.append(at)
        at += len(p)
    head = json.dumps({"documents": len(documents), "ids": int(starts[-1]), "levels": levels, "places": places, "bytes": at}).encode()
    return MAGIC + len(head).to_bytes(8, "little") + head + b"".join(parts)


class Codes:
    """Reads a file; `data` is anything that can be sliced to bytes, a memory map for instance."""

    def __init__(self, data):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a file of token codes")
        size = int.from_bytes(data[8:16], "little")
        head = json.loads(bytes(data[16 : 16 + size]))
        self.n_documents, self.n_ids, self.counts = head["documents"], head["ids"], head["levels"]
        base, places = 16 + size, [*head["places"], head["bytes"]]
        if len(data) < base + places[-1]:
            raise ValueError("the file is cut short")
        part = lambda k, kind: np.frombuffer(data, kind, (places[k + 1] - places[k]) // np.dtype(kind).itemsize, base + places[k])
        self.keys, self.null, self.starts = part(0, "<i8"), part(1, np.uint8), part(2, "<i8")
        self.levels = [(part(3 + 3 * k, np.uint8), part(4 + 3 * k, np.uint8), part(5 + 3 * k, "<u8")) for k in range(len(self.counts))]

    def id(self, i: int) -> int:
        """The id at place i of the file: one chunk, one bit and one short count for each level."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        out = 0
        for k, (chunks, bits, directory) in enumerate(self.levels):
            out |= int(chunks[i]) << (8 * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // STRIDE
            before = int.from_bytes(bits[block * STRIDE // 8 : (i >> 3) + 1].tobytes(), "little") & ((1 << (i - block * STRIDE)) - 1)
            i = int(directory[block]) + before.bit_count()
        return out

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids at places start to end - 1."""
        out = np.zeros(end - start, "<u4")
        where, low, high = np.arange(end - start), start, end
        for k, (chunks, bits, directory) in enumerate(self.levels):
            out[where] |= chunks[low:high].astype(np.uint32) << np.uint32(8 * k)
            on = np.unpackbits(bits[low >> 3 : (high + 7) >> 3], bitorder="little")[low & 7 :][: high - low].astype(bool)
            if not on.any():
                break
            where = where[on]
            block = low // STRIDE
            skipped = np.unpackbits(bits[block * STRIDE // 8 : (low + 7) >> 3], bitorder="little")[: low - block * STRIDE]
            low = int(directory[block]) + int(skipped.sum())
            high = low + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def _words_end_at_spaces(file: dict) -> bool:
    """Whether a tokenizers file is of the kind that `WordEncoder` can take apart: lower-case words, each with an end mark."""

    def kinds(part: dict | None) -> set[str]:
        if part is None:
            return set()
        inner = [x for k in ("normalizers", "pretokenizers") for x in part.get(k, ())]
        return {part["type"]}.union(*map(kinds, inner))

    normal, model = kinds(file.get("normalizer")), file["model"]
    plain = normal <= {"Sequence", "NFC", "NFKC", "Lowercase", "Replace"} and "Lowercase" in normal
    plain = plain and kinds(file.get("pre_tokenizer")) <= {"Sequence", "Split", "ByteLevel"}
    return plain and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")


class WordEncoder:
    """Encodes with a tokenizers file, keeping the ids of words it has seen where its words end at white space.

    Words of letters, and such words with ASCII punctuation after them, are one and two pre-tokens; new ones are encoded
    together, and told apart by the pieces that end a word. All else goes through the library as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # For lower-case ASCII letters the file's normaliser and byte mapping change nothing, and words end at spaces.
        self.ascii = Tokenizer.from_file(path)
        self.ascii.normalizer, self.ascii.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.by_words = _words_end_at_spaces(json.loads(self.tokenizer.to_str()))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _together(self, tokenizer, words: list[str]) -> list[bytes]:
        parts = [words[at : at + 256] for at in range(0, len(words), 256)]
        out: list[bytes] = []
        for part, found in zip(parts, tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            edge = np.flatnonzero(self.ends[ids]) + 1
            if len(edge) == len(part) and edge[-1] == len(ids):
                data = ids.tobytes()
                at = (4 * edge).tolist()
                out += [data[a:b] for a, b in zip([0, *at], at, strict=False)]
            else:  # a letter to the library's pattern need not be one to Python
                out += map(self._whole, part)
        return out

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if w.isalpha()]
        rest = [(w, stem) for w in words if not w.isalpha() for stem in [w.rstrip(PUNCTUATION)]]
        marked = [(w, stem) for w, stem in rest if len(stem) < len(w) and stem.isalpha()]
        known = self.cache
        for tokenizer, fits in ((self.ascii, True), (self.tokenizer, False)):
            mine = [w for w in plain if w.isascii() is fits]
            known.update(zip(mine, self._together(tokenizer, [w.lower() for w in mine] if fits else mine), strict=True))
            pairs = [(w, stem) for w, stem in marked if stem.isascii() is fits]
            ends = {end: self._whole(end) for end in {w[len(stem) :] for w, stem in pairs}}
            stems = self._together(tokenizer, [stem.lower() for _, stem in pairs] if fits else [stem for _, stem in pairs])
            known.update((w, ids + ends[w[len(stem) :]]) for (w, stem), ids in zip(pairs, stems, strict=True))
        known.update((w, self._whole(w)) for w, _ in rest if w not in known)

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of each of some distinct words. When the table is full, what was used since it last was is kept."""
        found = list(map(self.cache.get, words))
        if None in found:
            missing = [i for i, f in enumerate(found) if f is None]
            if len(self.cache) + len(missing) > CACHE // 2:
                self.older, self.cache = self.cache, {}
            if self.older:
                again = {words[i]: self.older[words[i]] for i in missing if words[i] in self.older}
                self.cache |= again
                self._learn([words[i] for i in missing if words[i] not in again])
            else:
                self._learn([words[i] for i in missing])
            for i in missing:
                found[i] = self.cache[words[i]]
        return found

    def arrays(self, texts: pa.Array, step: int = 1024) -> Iterator[np.ndarray]:
        """For each text its ids. Words are told apart and counted off in Arrow; the table sees each of a step's once.

        Splitting at ASCII white space is safe: no pre-token, and no special string, spans it.
        """
        if not self.by_words:
            for text in texts.to_pylist():
                yield np.frombuffer(self._whole(text), "<u4")
            return
        for at in range(0, len(texts), step):
            lists = pc.ascii_split_whitespace(texts.slice(at, step).cast(pa.large_string()))
            coded = lists.flatten().dictionary_encode()
            known = self._ids(coded.dictionary.to_pylist())
            sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
            table = np.frombuffer(b"".join(known), "<u4")
            starts = np.cumsum(sizes) - sizes
            words = coded.indices.to_numpy()
            lengths = sizes[words]
            ends = np.cumsum(lengths)
            flat = table[np.repeat(starts[words] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
            edges = np.r_[0, ends][np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]].tolist()
            for x, y in pairwise(edges):
                yield flat[x:y]

    def __call__(self, text: str) -> bytes:
        return next(self.arrays(pa.array([text]))).tobytes()


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One for each worker process, which keeps it from task to task."""
    return WordEncoder(path)


def write(docs: DataFrame, encoder: Callable[[], Callable[[pa.Array], Iterator[np.ndarray]]], end_id: int, folder: str | None = None, key: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of each text, `end_id` after each, in ascending order of `key`; returns the staged manifest.

    Columns: name, folder, documents, ids, base (ids in all files before), bytes. A null text counts as empty, so it
    has the end id only. Null keys come first; rows of one key follow in the order of their text. Other columns are not
    read. An empty table gives no files.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "token-codes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"))
    # By the text's beginning after the key, so that rows of one key may go to several tasks.
    ranges = rows.repartitionByRange(parts, F.asc_nulls_first("key"), F.substring("text", 1, 32))
    rows = ranges.sortWithinPartitions(F.asc_nulls_first("key"), "text")
    end = np.uint32(end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        encode = encoder()
        made: list[tuple] = []
        keys: list[int | None] = []
        ids: list[np.ndarray] = []

        def close() -> None:
            temporary = f"_tmp/{uuid.uuid4().hex}.codes"
            system.create_dir(f"{base}/_tmp", recursive=True)
            data = pack(keys, ids)
            with system.open_output_stream(f"{base}/{temporary}") as f:
                f.write(data)
            made.append((temporary, TaskContext.get().partitionId(), len(keys), sum(map(len, ids)), len(data)))
            keys.clear()
            ids.clear()

        held = 0
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                keys.append(k)
                ids.append(np.append(x, end))
                held += len(ids[-1])
                if held >= file_ids:
                    close()
                    held = 0
        if keys:
            close()
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(kinds)] + [pa.array(range(len(made)), pa.int64())], names=["temporary", "task", "documents", "ids", "bytes", "n"])

    made = stage(rows.mapInArrow(run, "temporary string, task bigint, documents bigint, ids bigint, bytes bigint, n bigint"), "manifest")
    # One row for a file of millions of ids. Tasks are in the order of their ranges, files in that of their task.
    order = "over (order by task, n rows between unbounded preceding and current row)"
    manifest = made.select("*", F.expr(f"sum(ids) {order} - ids").alias("base"), F.expr(f"row_number() {order} - 1").alias("k"))
    manifest = stage(manifest.select("temporary", F.format_string("part-%08d.codes", "k").alias("name"), "documents", "ids", "base", "bytes"), "manifest")
    commit_files(manifest, folder)
    return manifest.select("name", F.lit(folder).alias("folder"), "documents", "ids", "base", "bytes")


def read(manifest: DataFrame) -> DataFrame:
    """key, start, n_tokens, ids_crc32 of each document in the files of `manifest`, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, folder, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, base = file_system(folder)
                with system.open_input_stream(f"{base}/{name}") as f:
                    codes = Codes(f.read())
                data, edges = memoryview(codes.ids(0, codes.n_ids).tobytes()), (4 * codes.starts).tolist()
                sums = [zlib.crc32(data[a:b]) for a, b in pairwise(edges)]
                yield pa.RecordBatch.from_arrays([pa.array(codes.keys, mask=codes.null.astype(bool)), pa.array(codes.starts[:-1] + before), pa.array(np.diff(codes.starts)), pa.array(sums, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])

    # The number is given, as what the small rows stand for is large.
    tasks = min(10_000, max(1, manifest.count()))
    return manifest.select("name", "folder", "base").repartition(tasks, F.col("name")).mapInArrow(run, "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
