"""Queries that SQL can express against their SQL; contracts of the others on whole small tables."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
from tessera.llm import queries

from ..oracle import compare, connect
from . import brute

SF = "/root/testdata/sf0.01"


def test_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert compare(spark, connect(SF), name, queries.queries()[name], queries.oracle_sql()[name], SF)


def _texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_op2(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at, want = 0, []
    for k, t in sorted(_texts(spark)):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op2_token_codes(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_op4(spark):
    docs = dict(_texts(spark))
    got = queries.op4_toxicity(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op5(spark):
    assert sorted(map(tuple, queries.op5_substring_dedup(spark, SF).collect())) == sorted(brute.substring(_texts(spark)))


def test_op9(spark):
    assert sorted(map(tuple, queries.op9_minhash_near_dedup(spark, SF).collect())) == sorted(brute.near(_texts(spark)))


def test_op10(spark):
    got = queries.op10_sharding(spark, SF).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in _texts(spark)}


def test_op1_payloads(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op1_warc(spark, SF).collect()
    assert {(r.page_id, r.payload_bytes, r.payload_digest) for r in got} == {(k, len(p), hashlib.sha1(p).hexdigest()) for k, p in pages.items()}
