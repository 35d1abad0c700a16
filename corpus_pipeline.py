"""A training-data pipeline over `documents`: stages of (name, function of (spark, docs, sf_dir)).

Each stage gets all that its predecessor kept. All but the last return the columns of documents:

1. language: documents without a letter, or whose language is uncertain, are dropped.
2. near_duplicates: of each class of near-duplicates the document with the smallest id stays.
3. repeated_spans: words of 13-word windows that a document with a smaller id holds too are removed.
4. mix: documents are repeated (up to three times) or left out, as the weighted mix of sources takes them.
5. encode: doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded_sha256, the digest of the decoded ids.

Nulls, repeated rows and empty tables are handled as the operators say; extra columns pass through the first four stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terragrid.llm import bpe, language, mixing, near_dedup, substring_dedup
from terragrid.llm.shared import new_folder

RANKS = "byte_bpe_multi_50k.tiktoken"


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.known_language(docs, language.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def remove_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded=True)
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_spans", remove_repeated_spans),
    ("mix", mix_sources),
    ("encode", encode),
]
#: SQL cannot express the stages' models, signatures and encoder; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result but the last is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
