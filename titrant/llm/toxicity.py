"""Operator 8: toxicity by compression distance.

zstandard trains one dictionary on ordinary text and two on toxic text.  The
toxic ones are trained on what ordinary text does not explain: of each toxic
document, the stretches made of byte grams that a larger share of toxic than of ordinary
documents hold, by the factors of CONTRASTS.  Each is laid over the ordinary dictionary, so that
the difference of two lengths of a window is what toxic wording alone saves.
A wide contrast sees the rare wording, a narrow one has less noise.  The
savings over all windows of a text are turned into a probability by
thresholds and weights calibrated on labelled documents that no dictionary has seen.

Grams count once a document, so words, parts of words and phrases of
ordinary words all count alike.  The literals of a window stay under the size
from which zstandard entropy-codes them, so lengths differ by matches alone.

Bound of the fit: SAMPLE labelled documents, chosen by a hash, one row per doc_id;
their whole texts, but for the ordinary dictionary, which is trained on PIECES
pieces of PIECE_CHARS characters of each.

Defined results: null and empty texts get the score of an empty window; very long
texts are cut into windows like others; without labels of both kinds the score
is the labels' mean, or 0 without labels.  One row per input row, repeated or not.
Columns other than doc_id, text and the label are ignored; `remove_toxic`
keeps them, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from titrant.llm import labelled
from titrant.session import saved

#: (ordinary, toxic) documents at most for dictionaries and calibration together; half of them for each.
SAMPLE = (8_000, 4_000)
WINDOW = 50
#: The ordinary dictionary: its size, and what it is trained on, evenly spaced pieces of a document.
TRAINED_BYTES, PIECE_CHARS, PIECES = 16384, 256, 4
#: Bytes of a gram: the shortest match that zstandard makes here.
GRAM = 5
#: For each toxic dictionary: by what factor a gram's documents must exceed their number expected
#: from ordinary text, plus one; and its size.  Segments of the trainer, in bytes.
CONTRASTS, SEGMENT = ((2, 2048), (4, 1024)), {"k": 16, "d": 6}
#: Stands in a trained file before its content: the first three offsets that the format repeats.
OFFSETS = b"\1\0\0\0\4\0\0\0\10\0\0\0"
#: Stands before each window and in all dictionaries: makes every window compressible, so that none is stored raw.
LEAD = b"#" * 32
#: Stands behind each window: zstandard starts no match in the last eight bytes.
TAIL = b"#" * 8
#: Bytes saved by which windows are counted.
STEPS = (2, 3, 4, 5, 6)


def windows(text: str) -> Iterator[bytes]:
    """The whole text in windows that end at blanks where they can."""
    data = text.lower().encode("utf-8", "surrogatepass")
    at, n = 0, len(data)
    while at < n:
        end = at + WINDOW
        if end < n and (cut := data.rfind(b" ", at + WINDOW // 2, end)) > 0:
            end = cut
        yield data[at:end]
        at = end


def compressor(content: bytes) -> Callable[[bytes], bytes]:
    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    how = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=5, target_length=32, strategy=zstandard.STRATEGY_LAZY2, **plain)
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=data).compress


def features(text: str, ordinary, *toxic) -> list[float]:
    """For each toxic dictionary: mean saving and shares of windows over each step, also
    scaled by the root of the number of windows, as for a sum of independent ones."""
    n, total = 0, [0] * len(toxic)
    over = [[0] * len(STEPS) for _ in toxic]
    for w in windows(text):
        whole = LEAD + w + TAIL
        plain = len(ordinary(whole))
        n += 1
        for d, compress in enumerate(toxic):
            saving = plain - len(compress(whole))
            if saving:
                total[d] += saving
                for k, step in enumerate(STEPS):
                    over[d][k] += saving >= step
    if not n:
        return [0.0] * (2 * (len(STEPS) + 1) * len(toxic) + 1)
    root, mean = n ** 0.5, [x / n for t, o in zip(total, over) for x in (t, *o)]
    return [*mean, *(x * root for x in mean), float(np.log1p(n))]


class Model:
    """Dictionary contents and the calibration; small, so it travels in closures."""

    def __init__(self, ordinary: bytes, toxic: list[bytes]):
        self.contents = [x + LEAD * 2 for x in (ordinary, *(t + ordinary for t in toxic))]
        self.mean = self.scale = self.beta = None

    def measure(self, docs: DataFrame) -> DataFrame:
        """The input's other columns and `x`, the features of `text` (the last column)."""
        contents = self.contents
        columns = docs.columns[:-1]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dictionaries = [compressor(x) for x in contents]
            for batch in batches:
                x = [features(t.as_py(), *dictionaries) for t in batch.column(len(columns))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x, pa.list_(pa.float64()))], [*columns, "x"])
        return docs.mapInArrow(run, StructType([*docs.schema.fields[:-1], StructField("x", ArrayType(DoubleType()))]))

    def calibrate(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.beta = labelled.logistic(np.c_[(x - self.mean) / self.scale, np.ones(len(x))], y, w)

    def probability(self):
        """A column over `x`."""
        terms = [(F.col("x")[k] - float(self.mean[k])) / float(self.scale[k]) * float(self.beta[k]) for k in range(len(self.mean))]
        return 1 / (1 + F.exp(-sum(terms, F.lit(float(self.beta[-1])))))


def grams(data: bytes) -> np.ndarray:
    """A number for each GRAM bytes in a row."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    out = np.zeros(max(0, len(x) - GRAM + 1), np.int64)
    for k in range(GRAM):
        out = out << 8 | x[k:k + len(out)]
    return out


def framed(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "surrogatepass") + b" "


def _gram_counts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for at in range(0, len(b), 200):
            for label, part in b.iloc[at:at + 200].groupby("label"):
                found, n = np.unique(np.concatenate([np.unique(grams(framed(t))) for t in part["text"]]), return_counts=True)
                zero = np.zeros(len(n), np.int64)
                yield pd.DataFrame({"gram": found, "one": n if label else zero, "zero": zero if label else n})


def gram_counts(sampled: DataFrame) -> DataFrame:
    """gram, one, zero: toxic and ordinary documents that hold it."""
    seen = sampled.select("label", "text").mapInPandas(_gram_counts, "gram long, one long, zero long")
    return seen.groupBy("gram").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"))


def stretches(text: str, wanted: np.ndarray) -> bytes:
    """The distinct stretches of a text that consist of wanted grams (sorted)."""
    data = framed(text)
    found = grams(data)
    if not len(found) or not len(wanted):
        return b""
    at = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
    inside = np.zeros(len(data) + 2, np.int8)
    for k in range(GRAM):
        inside[1 + k:1 + k + len(found)] |= wanted[at] == found
    ends = np.flatnonzero(np.diff(inside))
    return b"\n".join(dict.fromkeys(data[x:y] for x, y in zip(ends[::2], ends[1::2])))


def shuffled(samples: Iterable[bytes]) -> list[bytes]:
    """Samples in an order of their own: the trainer picks from one stretch of them after the other."""
    return sorted(filter(None, samples), key=lambda x: (hashlib.blake2b(x).digest(), x))


def trained_content(samples: list[bytes], size: int, **how) -> bytes:
    """The content of a dictionary that zstandard trains, without its header."""
    try:
        whole = zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        return b"\n".join(samples)[-size:]
    return whole.partition(OFFSETS)[2] or whole


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> Model:
    """A model from the labels given; callers leave held-out rows out of them."""
    sampled = saved(labelled.sample(docs, labels, column, *SAMPLE, salt=8), "toxicity-sample")
    first = sampled.where("half = 0")
    at = F.expr(f"transform(sequence(0, {PIECES - 1}), k -> substring(lower(text), 1 + cast(k * char_length(text) / {PIECES} AS int), {PIECE_CHARS}))")
    pieces = shuffled(p.encode() for r in first.where("label = 0").select(at.alias("p")).toLocalIterator() for p in r.p)
    sizes = {r.label: r["count"] for r in first.groupBy("label").count().collect()}
    expected = F.col("zero") * (sizes.get(1, 0) / max(1, sizes.get(0, 0))) + 1
    # wanted grams each occur in more than two of the sampled toxic documents
    odd = gram_counts(first).where(F.col("one") > CONTRASTS[0][0] * expected).select("gram", (F.col("one") / expected).alias("times")).collect()
    left: list[list[bytes]] = [[] for _ in CONTRASTS]
    wanted = [np.array(sorted(r.gram for r in odd if r.times > least), np.int64) for least, _ in CONTRASTS]
    for r in first.where("label = 1").select("text").toLocalIterator():
        for k, some in enumerate(wanted):
            left[k].append(stretches(r.text, some))
    toxic = [trained_content(shuffled(some), size, **SEGMENT) for some, (_, size) in zip(left, CONTRASTS)]
    model = Model(trained_content(pieces, TRAINED_BYTES), toxic)
    rows = model.measure(sampled.where("half = 1").select("label", "weight", "text")).collect()
    rows.sort(key=lambda r: (r.label, r.x))
    x = np.array([r.x for r in rows] or [features("", *[compressor(b"")] * (1 + len(CONTRASTS)))])
    model.calibrate(x, np.array([r.label for r in rows] or [0]), np.array([r.weight for r in rows] or [1.0]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), one row per input row."""
    return model.measure(labelled.documents(docs)).select("doc_id", model.probability().alias("score"))


def remove_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows below the threshold, with their columns."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return model.measure(rows).where(model.probability() < threshold).select("row.*")
