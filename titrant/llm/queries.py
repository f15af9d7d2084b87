"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titrant.llm import byte_bpe, decontaminate, divergence, embedding_dedup, fingerprints, jaccard_join, labelled, language, licences, quality, token_counts, token_files, toxicity, whitening
from titrant.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


@query
def op3_embedding_dedup(spark, sf_dir):
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


@query
def op6_byte_bpe(spark, sf_dir):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), path, pattern).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op7_token_files(spark, sf_dir):
    out = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.with_crc32(token_files.read_tokens(spark, out))


@query
def op9_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def learnable(labels: DataFrame) -> DataFrame:
    return labels.where(labelled.bucket(F.col("doc_id"), 5) != 0)


def scored(rows: DataFrame, least: float) -> DataFrame:
    held = F.coalesce(labelled.bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


@query
def op4_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scored(quality.score(docs, quality.fit(docs, learnable(table(spark, sf_dir, "labels")))), 0.3)


@query
def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scored(toxicity.score(docs, toxicity.fit(docs, learnable(table(spark, sf_dir, "labels")))), 0.5)


@query
def op2_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(labelled.bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    found = language.predict(docs, language.fit(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op5_decontamination(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op5_decontamination"] = decontaminate.SQL


@query
def op10_licences(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents"))


SQL["op10_licences"] = licences.sql()


@query
def op11_source_divergence(spark, sf_dir):
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


SQL["op11_source_divergence"] = divergence.SQL


@query
def op12_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@query
def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
