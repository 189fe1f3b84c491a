from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import token_codes
from tessera.llm.token_codes import Codes, WordEncoder, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY, ENCODER = Tokenizer.from_file(PATH), WordEncoder(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), max_size=6))
def test_codes(documents):
    keys = [None, *range(5)][: len(documents)]
    codes = Codes(pack(keys, [np.array(d, "<u4") for d in documents]))
    flat = [x for d in documents for x in d]
    assert [codes.document(k).tolist() for k in range(len(documents))] == documents
    assert [codes.id(i) for i in range(0, len(flat), 3)] == flat[::3]
    for _ in range(5):
        a = random.randint(0, len(flat))
        b = random.randint(a, len(flat))
        assert codes.ids(a, b).tolist() == flat[a:b]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["It's", "Élan,", "foo", "<|endoftext|>", "\x1c", "don't.", "x1", "İI", "ß!", "日本語", "ﬁ", "é", "Σς", " ", "!!", "a,b"]), max_size=8).map(" ".join))
def test_encoder(text):
    assert np.frombuffer(ENCODER(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_files(spark):
    rng = random.Random(1)
    rows = [(i * 91 % 1009, " ".join(rng.choices(["the", "cat,", "Würze", "is", "1984"], k=rng.randrange(200)))) for i in range(200)]
    rows += [(None, "null key"), (None, None), (2000, ""), (3, "b"), (3, "a"), (3, "a"), (5000, "word " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).withColumn("base", F.lit(1))
    files = token_codes.write(df, lambda: WordEncoder(PATH).arrays, 1, file_ids=3000)
    assert files.count() > 5
    want, at = [], 0
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_codes.read(files).collect()), key=lambda r: r[1]) == want
    assert token_codes.read(token_codes.write(df.limit(0), lambda: WordEncoder(PATH).arrays, 1)).count() == 0


def test_full_tables(monkeypatch):
    """Results do not depend on what is kept."""
    monkeypatch.setattr(token_codes, "CACHE", 40)
    small, rng = WordEncoder(PATH), random.Random(9)
    texts = [" ".join("".join(rng.choices("abcé.1", k=rng.randint(1, 4))) for _ in range(rng.randrange(30))) for _ in range(400)]
    assert [x.tolist() for x in small.arrays(pa.array(texts), 50)] == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
