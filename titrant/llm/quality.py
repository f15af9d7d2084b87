"""Operator 4: a hashed word n-gram logistic regression, fitted by
follow-the-regularised-leader updates and scored as sparse dot products.

Tokens are runs of word characters or of other visible characters, in lower
case; features are single tokens and neighbouring pairs, hashed to 2**BITS
places, weighted by count / root of the sum of squared counts.

Bound of the fit: SAMPLE labelled documents, chosen by a hash, one row per doc_id.  Defined
results: null and empty texts have no features and get the score of the constant; very
long texts are counted in blocks, whole; without labels the score is 0.5.  One row per input row, repeated or
not.  Columns other than doc_id, text and the label are ignored; `remove_poor` keeps them, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from titrant.llm import labelled
from titrant.llm.shingles import hash_words, mix
from titrant.session import saved

#: (label 0, label 1) documents at most.
SAMPLE = (2_500, 5_000)
BITS = 18
TOKEN = re.compile(r"\w+|[^\w\s]+")
BLOCK = 100_000
#: Follow-the-regularised-leader: learning rate, smoothing, absolute and squared penalty, passes.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.05, 1.0, 3


def places(text: str) -> np.ndarray:
    """Feature places of a text, repeated as often as they occur."""
    found, out, last = TOKEN.findall(text.lower()), [], np.empty(0, np.uint64)
    for k in range(0, len(found), BLOCK):
        h = hash_words(found[k:k + BLOCK])
        row = np.concatenate([last, h])
        pairs = mix(row[:-1] * np.uint64(0x9E3779B97F4A7C15) + row[1:])
        out += [h >> np.uint64(64 - BITS), pairs >> np.uint64(64 - BITS)]
        last = h[-1:]
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    place, count = np.unique(places(text), return_counts=True)
    return place.astype(np.int32), (count / max(np.sqrt((count.astype(np.float64) ** 2).sum()), 1)).astype(np.float32)


class Model:
    def __init__(self):
        self.weights, self.constant = np.zeros(1 << BITS, np.float32), 0.0

    def train(self, rows: list[tuple[np.ndarray, np.ndarray, int, float]], seed: int = 4) -> None:
        size = 1 << BITS
        z, n = np.zeros(size + 1), np.zeros(size + 1)
        rng = np.random.default_rng(seed)
        for _ in range(PASSES):
            for k in rng.permutation(len(rows)):
                place, value, label, weight = rows[k]
                at, x = np.append(place, size), np.append(value, 1.0)
                w = self._leader(z[at], n[at])
                g = (labelled.sigmoid(w @ x) - label) * weight * x
                step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
                z[at] += g - step * w
                n[at] += g * g
        w = self._leader(z, n)
        self.weights, self.constant = w[:size].astype(np.float32), float(w[size])

    @staticmethod
    def _leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def score(self, text: str) -> float:
        place, value = sparse(text)
        return float(labelled.sigmoid(float(self.weights[place] @ value) + self.constant))


def _sparse_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [sparse(t.as_py()) for t in b.column(2)]
        made = [pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*b.columns[:2], *made], ["label", "weight", "place", "value"])


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality") -> Model:
    """A model from the labels given; callers leave held-out rows out of them."""
    sampled = labelled.sample(docs, labels, column, *SAMPLE, salt=4)
    rows = saved(sampled.select("label", "weight", "text").mapInArrow(_sparse_rows, "label int, weight double, place binary, value binary"), "quality-sample")
    read = [(np.frombuffer(r.place, np.int32), np.frombuffer(r.value, np.float32), r.label, r.weight) for r in rows.toLocalIterator()]
    mean = np.mean([r[3] for r in read]) if read else 1.0
    model = Model()
    model.train(sorted([(p, v, y, w / mean) for p, v, y, w in read], key=lambda r: (len(r[0]), r[0].tobytes(), r[1].tobytes(), r[2])))
    return model


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """The first column, and `score` of the text in the second."""
    weights = rows.sparkSession.sparkContext.broadcast((model.weights, model.constant))  # 2**BITS floats
    name = rows.columns[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model()
        own.weights, own.constant = weights.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.score(t.as_py()) for t in b.column(1)], pa.float64())], [name, "score"])
    return rows.mapInArrow(run, StructType([rows.schema.fields[0], StructField("score", DoubleType())]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), one row per input row."""
    return _scored(labelled.documents(docs), model)


def remove_poor(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows at or over the threshold, with their columns."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return _scored(rows, model).where(F.col("score") >= threshold).select("row.*")
