"""The corpus pipeline: four filtering stages over `documents`, then encoding.

Every stage works on all rows that its predecessor kept.  A stage that rejects a
row drops it whole; all stages but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titrant.llm import byte_bpe, decontaminate, jaccard_join, quality, toxicity
from titrant.llm.queries import learnable, table
from titrant.session import saved


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for toxicity go."""
    return toxicity.remove_toxic(docs, toxicity.fit(docs, learnable(table(spark, sf_dir, "labels"))))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3 for quality go."""
    return quality.remove_poor(docs, quality.fit(docs, learnable(table(spark, sf_dir, "labels"))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of smallest doc_id."""
    return jaccard_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), and the digest of the text decoded from them."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.round_trip(docs, path, pattern).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("ngram_jaccard_join", drop_near_copies), ("decontamination", drop_leaks), ("byte_bpe", encode)]
#: Trained models and MinHash have no SQL form; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
