"""Preparing a training corpus in stages, each on all that the one before has kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of `documents`. Between stages the result is written as Parquet to the
shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import bpe, exact_dedup, langid, mixing, near_copies
from eventloom.llm.shared import new_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return langid.drop_unidentified(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id."""
    return exact_dedup.drop_copies(docs, keep="min")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the row with the smallest id."""
    return near_copies.drop_near_copies(docs, shingle=5, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to target weights; a row stands as often as it is taken."""
    return mixing.mix_sources(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and hashes of the ids and of the text they decode to."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode_digest(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup),
    ("mixing", mixing_stage),
    ("byte_bpe", byte_bpe),
]

#: Language models, fingerprints and tokens are beyond SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
