"""Bounded samples of labelled documents, and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket(doc_id, n: int):
    """crc32 of the document id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def documents(docs: DataFrame) -> DataFrame:
    """doc_id and text, without the columns that are no input of a score."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def one_row_each(rows: DataFrame) -> DataFrame:
    """doc_id and the other columns, one row per doc_id: of several texts the one of smallest hash."""
    rest = [c for c in rows.columns if c not in ("doc_id", "text")]
    return rows.groupBy("doc_id").agg(*[F.min(c).alias(c) for c in rest], F.min_by("text", F.xxhash64("text")).alias("text"))


def sample(docs: DataFrame, labels: DataFrame, column: str, zero: int, one: int, salt: int) -> DataFrame:
    """doc_id, label, weight, half, text: at most `zero` and `one` rows of each
    label, one per doc_id, chosen by a hash of doc_id.  weight: labelled documents that each chosen one
    stands for.  half: 0 or 1, an even split.  Conflicting labels: the larger counts."""
    rows = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("label"))
    parts = []
    for label, most in ((0, zero), (1, one)):
        of = rows.where(F.col("label") == label)
        weight = F.greatest(F.lit(1.0), of.agg(F.count(F.lit(1))).scalar() / most)
        parts.append(of.withColumn("h", F.xxhash64("doc_id", F.lit(salt))).orderBy("h", "doc_id").limit(most).withColumn("weight", weight))
    chosen = parts[0].union(parts[1]).select("doc_id", "label", "weight", F.pmod(F.xxhash64("h"), F.lit(2)).cast("int").alias("half"))
    return one_row_each(documents(docs).join(F.broadcast(chosen), "doc_id"))  # `zero` + `one` rows


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, turns: int = 25) -> np.ndarray:
    """Coefficients by Newton's method; the last column of x is the constant, without penalty."""
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(turns):
        p = sigmoid(x @ beta)
        slope = x.T @ (w * (y - p)) - penalty * beta
        bend = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        beta = beta + step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
    return beta


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
