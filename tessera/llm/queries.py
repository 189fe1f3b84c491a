"""One query for each operator of this package, applied with production parameters to whole tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, kdtree, minhash, quality, slots, substring, token_codes, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: All inner products of the stated queries.
OP6 = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e
           from embeddings
           where embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id,
             cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) as score
      from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from p)
select query_id, rank, vec_id, score from r where rank <= 10
"""


def op6_kdtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kdtree.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)
    return found.select("query_id", "rank", "vec_id", "score")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "n_slots", "n_changed")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


#: Records with equal payloads of 1000 bytes and more refer to the one with the largest page_id.
OP1 = """
with p as (select page_id, coalesce(html, '') as payload from pages),
d as (select page_id, cast(octet_length(encode(payload)) as bigint) as payload_bytes, sha1(payload) as payload_digest from p),
m as (select *, max(page_id) over (partition by payload_digest) as last from d)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> last then last end as refers_to
from m
"""


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(_table(spark, sf_dir, "pages"))
    return warc.read(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    files = token_codes.write(_table(spark, sf_dir, "documents"), lambda: token_codes.word_encoder(vocabulary).arrays, end_id=1)
    return token_codes.read(files).withColumnRenamed("key", "doc_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.grade(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), toxicity.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


#: All windows of 35 words, by the digest of their words.
OP5 = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
s as (select doc_id, words, unnest(range(1, len(words) - 33)) as i from d where len(words) >= 35),
h as (select doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) as h from s),
again as (select h from h group by h having count(*) > 1),
gone as (select distinct doc_id, i + k as pos from (select doc_id, i from h semi join again using (h)), range(35) r(k)),
w as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as pos from d),
k as (select doc_id, string_agg(word, ' ' order by pos) as kept, count(*) as n_kept from w anti join gone using (doc_id, pos) group by doc_id)
select d.doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(n_kept, 0) as bigint) as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from d left join k using (doc_id)
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(substring.remove_repeats(_table(spark, sf_dir, "documents")))


#: All pairs that share a shingle, and what is reachable over links.
OP9 = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, case when len(w) < 3 then array_to_string(w, ' ') else array_to_string(w[i:i + 2], ' ') end as shingle
      from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
e as (select c.a, c.b from c join n x on x.doc_id = c.a join n y on y.doc_id = c.b where 100 * c.c >= 85 * (x.n + y.n - c.c)),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on r.b = e.a),
m as (select a as doc_id, min(b) as component_id from r group by a)
select m.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, component_id, m.doc_id = component_id as kept
from m left join n using (doc_id)
"""


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = slots.shard(_table(spark, sf_dir, "documents"), n_shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_warc": op1_warc, "op2_token_codes": op2_token_codes, "op3_quality": op3_quality, "op4_toxicity": op4_toxicity, "op5_substring_dedup": op5_substring_dedup, "op6_kdtree_top_k": op6_kdtree_top_k, "op7_benchmark_decontamination": op7_benchmark_decontamination, "op8_byte_bpe": op8_byte_bpe, "op9_minhash_near_dedup": op9_minhash_near_dedup, "op10_sharding": op10_sharding}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1, "op5_substring_dedup": OP5, "op6_kdtree_top_k": OP6, "op9_minhash_near_dedup": OP9}
