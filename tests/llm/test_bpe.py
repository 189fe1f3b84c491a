from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import bpe

PATH = public.path("byte_bpe_50k.tiktoken")
with open(PATH, "rb") as f:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
LIBRARY = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = bpe.ByteBpe(PATH, public.PATTERN)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80) | st.lists(st.sampled_from([" the", "\n", "\x1c", "\x85", "'ll", "▁", "é", "日本", "😀", "　", " ", "1234", "!!!", "\x00", "ß's", "<|endoftext|>"]), max_size=10).map("".join))
def test_like_the_library(text):
    ids = np.frombuffer(OURS.encode(text), "<u4").tolist()
    assert ids == LIBRARY.encode_ordinary(text)
    assert OURS.decode(OURS.encode(text)) == text.encode()


def test_small_table(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    small = bpe.ByteBpe(PATH, public.PATTERN)
    for text in ["one two three four five six seven", "eight nine ten one two", "one " * 50, ""]:
        assert np.frombuffer(small.encode(text), "<u4").tolist() == LIBRARY.encode_ordinary(text)


def test_model_is_a_sentencepiece_model():
    model = sentencepiece.SentencePieceProcessor(model_proto=bpe.sentencepiece_model([bytes([b]) for b in range(256)] + [b"ab", b"abc", b" a"]))
    assert model.get_piece_size() == 260 and model.get_score(256) == -256.0 and model.id_to_piece(258) == "Ġa"
    assert model.encode("abcab") == [257, 256]


def test_gaps_are_refused(tmp_path):
    (tmp_path / "v").write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(tmp_path / "v"))


def test_rows(spark):
    texts = [None, "", "plain text", "x" * 200_000, "plain text", "ünï"]
    docs = spark.createDataFrame(list(zip([1, 2, 3, 4, 3, None], texts, strict=True)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = bpe.digests(bpe.encode_texts(docs, PATH, public.PATTERN)).collect()
    want = []
    for k, t in zip([1, 2, 3, 4, 3, None], texts, strict=True):
        ids = np.array(LIBRARY.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((k, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encode_texts(docs.limit(0), PATH, public.PATTERN).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in bpe.digests(bpe.encode_texts(docs, PATH, public.PATTERN)).collect()}
    for r in docs.collect():
        ids = LIBRARY.encode_ordinary(r.text or "")
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
