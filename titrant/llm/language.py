"""Operator 2: language identification by a byte convolutional network.

Bytes are embedded; filters of several widths slide over fixed-length windows; the
maximum of each filter over a window feeds a softmax.  A text's score for a
language is the mean over all its windows, which overlap by the widest
filter less one, so every byte sequence is seen.  Trained here in numpy.

Bound of the fit: about PER_LANGUAGE documents (twice as many at most, one row per
doc_id) of each of the LANGUAGES commonest languages, chosen by a hash, and PIECES windows
of each.  Whole texts are predicted, however long.  Columns other than doc_id,
text and, in the fit, lang are ignored.  Defined results: `und` with score 0 for null texts, texts
without letters, and without learned languages.  One row per input row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from titrant.llm import labelled

PER_LANGUAGE, LANGUAGES, PIECES = 400, 500, 12
WINDOW, WIDTHS, FILTERS, EMBED = 128, (2, 3, 4), 12, 6
STEP = WINDOW - max(WIDTHS) + 1
EPOCHS, BATCH, RATE = 4, 128, 0.01
#: Windows in one matrix product.
AT_ONCE = 256


def windows(text: str) -> np.ndarray:
    """(windows, WINDOW) bytes of the whole lower-cased text, zero-filled."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-(len(data) - WINDOW) // STEP) + 1)
    whole = np.zeros((n - 1) * STEP + WINDOW, np.uint8)
    whole[:len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(whole, WINDOW)[::STEP]


class ByteNet:
    def __init__(self, languages: list[str], seed: int = 2):
        rng = np.random.default_rng(seed)
        wide, total = max(WIDTHS), FILTERS * len(WIDTHS)
        self.languages = languages
        #: Filter inputs beyond a filter's width stay zero.
        self.mask = np.repeat(np.concatenate([np.repeat(np.arange(wide)[:, None] < w, FILTERS, 1) for w in WIDTHS], 1), EMBED, 0).astype(np.float32)
        self.p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "filters": rng.normal(0, 0.3, (wide * EMBED, total)) * self.mask, "bias": np.zeros(total),
                  "dense": rng.normal(0, 0.2, (total, len(languages))), "shift": np.zeros(len(languages))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _patches(self, x: np.ndarray) -> np.ndarray:
        e = self.p["embed"][x]
        wide, reach = max(WIDTHS), WINDOW - max(WIDTHS) + 1
        return np.concatenate([e[:, k:k + reach] for k in range(wide)], axis=2)

    def forward(self, x: np.ndarray):
        patches = self._patches(x)
        z = (patches.reshape(-1, patches.shape[2]) @ self.p["filters"]).reshape(len(x), -1, self.p["filters"].shape[1])
        return patches, z

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for k in range(0, len(x), AT_ONCE):
            h = np.maximum(self.forward(x[k:k + AT_ONCE])[1].max(axis=1) + self.p["bias"], 0)
            out.append(softmax(h @ self.p["dense"] + self.p["shift"]))
        return np.concatenate(out)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss and its gradients; through a maximum flows only its place."""
        n, (patches, z) = len(x), self.forward(x)
        best = z.argmax(axis=1)
        h = np.maximum(np.take_along_axis(z, best[:, None], 1)[:, 0] + self.p["bias"], 0)
        p = softmax(h @ self.p["dense"] + self.p["shift"])
        loss = float(-np.log(np.maximum(p[np.arange(n), y], 1e-12)).mean())
        d = p
        d[np.arange(n), y] -= 1
        d /= n
        dh = d @ self.p["dense"].T * (h > 0)
        chosen = patches[np.arange(n)[:, None], best]
        embed = np.zeros_like(self.p["embed"])
        wide = max(WIDTHS)
        flow = (dh[:, :, None] * self.p["filters"].T).reshape(n, -1, wide, EMBED)
        np.add.at(embed, x[np.arange(n)[:, None, None], best[:, :, None] + np.arange(wide)], flow)
        return loss, {"embed": embed, "filters": np.einsum("nf,nfk->kf", dh, chosen) * self.mask, "bias": dh.sum(0), "dense": h.T @ d, "shift": d.sum(0)}

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 3) -> None:
        """Adam over shuffled batches, languages drawn evenly."""
        rng = np.random.default_rng(seed)
        share = 1 / np.bincount(y, minlength=len(self.languages))[y]
        m, v, t = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2)), None, 0
        m, v = m
        for _ in range(EPOCHS * max(len(x) // BATCH, 10)):
            some = rng.choice(len(x), min(BATCH, len(x)), p=share / share.sum())
            t += 1
            for k, g in self.gradients(x[some], y[some])[1].items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] -= RATE * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        parts = [windows(t) for t in texts]
        starts = np.cumsum([0, *(len(p) for p in parts[:-1])])
        sums = np.add.reduceat(self.probabilities(np.concatenate(parts)), starts, axis=0)
        mean = sums / np.array([len(p) for p in parts])[:, None]
        return [self.languages[k] for k in mean.argmax(axis=1)], np.clip(mean.max(axis=1), 0, 1).astype(float).tolist()


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(docs: DataFrame) -> ByteNet:
    """A network from the text and lang of the rows given; callers leave held-out rows out."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where("lang is not null and text is not null and doc_id is not null")
    learned = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    rate = F.broadcast(learned.select("lang", (PER_LANGUAGE / F.col("count")).alias("rate")))  # LANGUAGES rows
    chosen = known.join(rate, "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 20)) < F.col("rate") * (1 << 20)).drop("rate").where(F.expr(r"text rlike '\\p{L}'"))
    # a hot id may be drawn with all its rows: one row each, then so many of a language by rank
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id"))
    chosen = labelled.one_row_each(chosen).withColumn("rank", rank).where(F.col("rank") <= 2 * PER_LANGUAGE)
    pieces = F.expr(f"array_distinct(transform(sequence(0, {PIECES - 1}), k -> substring(text, 1 + cast(k * char_length(text) / {PIECES} AS int), {WINDOW})))")
    rows = chosen.select("doc_id", "lang", pieces.alias("pieces")).orderBy("doc_id", "lang").collect()
    languages = sorted({r.lang for r in rows})
    net = ByteNet(languages)
    found = [(windows(p)[0], languages.index(r.lang)) for r in rows for p in r.pieces if p.strip()]
    if found and len(languages) > 1:
        net.train(np.array([x for x, _ in found]), np.array([y for _, y in found]))
    return net


def predict(docs: DataFrame, net: ByteNet) -> DataFrame:
    """doc_id, lang_pred, score."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                some = b.slice(at, 200)
                texts, letters = some.column(1).to_pylist(), some.column(2).to_pylist()
                own = [k for k, yes in enumerate(letters) if yes and net.languages]
                lang, score = ["und"] * len(texts), [0.0] * len(texts)
                for k in range(0, len(own), 50):
                    for i, x, s in zip(own[k:], *net.predict([texts[i] for i in own[k:k + 50]])):
                        lang[i], score[i] = x, s
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.rlike(text, F.lit(r"\p{L}")).alias("letters")).mapInArrow(run, "doc_id long, lang_pred string, score double")
