"""Byte-level BPE through a sentencepiece model that is serialised from the vocabulary itself.

The vocabulary (a file of base64 tokens and ranks) becomes a sentencepiece BPE model: each token's bytes are mapped to
printable characters, one for each byte, and its score is the negative rank, so that the best-scored merge is the one
of the lowest rank. Normalisation is the identity: no dummy prefix, no removal or escaping of white space. Pieces stand
in the order of rank, so a piece's number is the token's id. Texts are split by the pre-token pattern first, each
pre-token is mapped and encoded by itself; decoding looks up each id's bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Kept pre-tokens in a worker; beyond it the table starts anew. It bounds memory, not results.
CACHE = 400_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ranks, which must be 0, 1, 2 ..."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2 ... without gaps")
    return [ranks[i] for i in range(len(ranks))]


def byte_characters() -> list[str]:
    """A printable character for each byte: itself if printable in Latin-1, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    extra = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _varint(n: int) -> bytes:
    n &= 2**64 - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """The serialised model. Fields by number: pieces 1 (piece 1, score 2, type 3), trainer 2, normaliser 3."""
    to_char = byte_characters()
    unknown, normal, bpe = 2, 1, 2
    pieces = [_field(1, _field(1, "".join(map(to_char.__getitem__, t)).encode()) + _field(2, float(-rank)) + _field(3, normal)) for rank, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encodes and decodes with a rank file. `pattern` splits a text into pre-tokens."""

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.known = {t: i for i, t in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        # White space is the Unicode property, as the pattern's own engine has it.
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.to_char = dict(enumerate(byte_characters()))
        self.space = self.to_char[0x20]
        self.cache: dict[str, bytes] = {}

    def _learn(self, pre_tokens: list[str]) -> None:
        if len(self.cache) + len(pre_tokens) > CACHE:
            self.cache.clear()
        raw = [p.encode() for p in pre_tokens]
        mapped = [p.replace(" ", self.space) if p.isascii() and p.isprintable() else r.decode("latin-1").translate(self.to_char) for p, r in zip(pre_tokens, raw, strict=True)]
        for at in range(0, len(raw), 256):
            # The line feed is in no piece: no merge crosses it, and it comes out as the unknown piece.
            ids = np.array(self.model.encode("\n".join(mapped[at : at + 256]), out_type=int), "<u4")
            ends = [*np.flatnonzero(ids == len(self.tokens)).tolist(), len(ids)]
            data, start = ids.tobytes(), 0
            for p, r, end in zip(pre_tokens[at : at + 256], raw[at : at + 256], ends, strict=True):
                whole = self.known.get(r)  # a pre-token that is itself a token stays whole
                self.cache[p] = data[4 * start : 4 * end] if whole is None else whole.to_bytes(4, "little")
                start = end + 1

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        found = self.split(text)
        try:
            return b"".join(map(self.cache.__getitem__, found))
        except KeyError:
            new = list({p for p in found if p not in self.cache})
            fresh = len(self.cache) + len(new) > CACHE
            self._learn(list(set(found)) if fresh else new)
            return b"".join(map(self.cache.__getitem__, found))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def byte_bpe(vocabulary: str, pattern: str) -> ByteBpe:
    """One for each worker process, which keeps it from task to task."""
    return ByteBpe(vocabulary, pattern)


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, ids (binary: little-endian unsigned 32-bit integers) and decoded (binary) of each row of `docs`.

    A null text counts as empty and gives no ids. Rows are taken one by one, so repeated keys, null keys and ties
    need no rule: each row in gives one row out. Columns other than `key` and `text` are not read. An empty table
    gives an empty result. `vocabulary` is a path that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary, pattern)
        for batch in batches:
            ids = [bpe.encode(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.large_binary()), pa.array(map(bpe.decode, ids), pa.large_binary())], names=["key", "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids binary, decoded binary").withColumnRenamed("key", key)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of `encode_texts`' rows."""
    return encoded.select(
        key,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
