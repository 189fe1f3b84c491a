"""The corpus pipeline: five stages over `documents`, each by one operator of tessera.llm.

1. toxicity: documents that the lexicon model rejects go.
2. near_duplicates: of each group of near-duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays.
3. substring_dedup: runs of 35 words that occur more than once go from the texts; a document all of whose words go, though it
   had some, goes too. Texts that lose nothing keep their white space; in others kept words are joined by one space.
4. decontamination: documents that repeat a benchmark item, maybe with other parameters, go.
5. byte_bpe: the rest is encoded, decoded and digested.

Stages 1 to 4 return the columns of `documents`; n_chars follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, minhash, substring, toxicity
from tessera.llm.common import stage

#: No SQL: learning weights and byte-pair merges are beyond it. Each stage is tested against a plain version.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.without_near_duplicates(docs, width=5, percent=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.without_repeats(docs, window=35, chars="n_chars")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", byte_bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
