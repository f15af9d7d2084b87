"""Operator 1: n-gram Jaccard join with Bayesian candidate pruning.

Documents with equal shingle sets form one class and are compared once.
Classes that agree in a band of MinHash values are candidates.  A candidate's
values are compared 32 at a time; it is dropped as soon as the posterior
probability (uniform prior) that its similarity reaches the threshold falls
below the tolerance.  The rest is verified on the whole shingle sets.

With 32 bands of 4 values a pair at similarity 0.8 is missed with probability
5e-8 by the bands and about 1e-6 by pruning.  Shingles and classes are 64-bit
hashes.  Every pair is handled in the first band in which it agrees, so links
are counted once.

Defined results: a null or wordless text, or a null doc_id, has no links and
is its own class (class_id = doc_id).  A text of one to four words links with texts of the
same words.  Rows that repeat a doc_id count as documents of their own.
Further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titrant.llm import pairs
from titrant.llm.rows import row_key
from titrant.llm.shingles import MinHash, digest, mix, shingle_set
from titrant.session import saved

THRESHOLD = 0.8
TOLERANCE = 1e-6
BANDS, ROWS = 32, 4
STEP = 32
MINHASH = MinHash(BANDS * ROWS)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, size: int = BANDS * ROWS, step: int = STEP) -> list[tuple[int, int]]:
    """(values compared, matches needed to go on).  The posterior of the
    similarity after m matches of n is Beta(m+1, n-m+1); its upper tail at t
    is the chance of m successes at most in n+1 trials of probability t."""
    out = []
    for n in range(step, size + 1, step):
        tail, m = (1 - threshold) ** (n + 1), 0
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(members, bands) 64-bit bucket keys."""
    s = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), s.shape[:2]).copy()
    for k in range(ROWS):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + s[:, :, k])
    return acc.view(np.int64)


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
            s = shingle_set(text.as_py()) if doc_id is not None else ()
            rows.append((digest(s), len(s), MINHASH.signature(s).tobytes()) if len(s) else (None, 0, None))
        made = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
        yield pa.RecordBatch.from_arrays([b.column(0), *made], ["doc_id", "id", "weight", "sig"])


def _bands(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if len(b):
            keys = band_keys(np.frombuffer(b"".join(b["sig"]), np.uint32).reshape(len(b), -1))
            yield pd.DataFrame({"key": keys.ravel(), "band": np.tile(np.arange(BANDS, dtype=np.int32), len(b)),
                                "id": np.repeat(b["id"].to_numpy(), BANDS), "weight": np.repeat(b["weight"].to_numpy(), BANDS)})


def candidates(frame: pd.DataFrame, needed: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, partners that survive the incremental comparison) of a unit."""
    sig = np.frombuffer(b"".join(frame["sig"]), np.uint32).reshape(len(frame), -1)
    ids, band = frame["id"].to_numpy(), int(frame["band"].iat[0])
    keys = band_keys(sig)
    for i, js in pairs.partners(frame["part"].to_numpy()):
        js = js[(ids[js] != ids[i]) & (keys[js, band] == keys[i, band])]
        if band and len(js):
            js = js[~(keys[js, :band] == keys[i, :band]).any(axis=1)]
        same, done = np.zeros(len(js), np.int64), 0
        for n, least in needed:
            if not len(js):
                break
            same = same + (sig[js, done:n] == sig[i, done:n]).sum(axis=1)
            js, same, done = js[same >= least], same[same >= least], n
        if len(js):
            yield i, js


def _surviving(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The members of each unit that have a surviving candidate there."""
    needed, out = least_matches(), []
    for frame in pairs.whole_units(batches):
        hit = np.zeros(len(frame), bool)
        for i, js in candidates(frame, needed):
            hit[i] = True
            hit[js] = True
        if hit.any():
            out.append(frame.loc[hit, ["unit", "band", "id", "part"]])
        if len(out) > 2000:
            yield pd.concat(out)
            out = []
    if out:
        yield pd.concat(out)


def _sets(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for cls, copies, sig, text in zip(b["id"], b["copies"], b["sig"], b["text"]):
            s = shingle_set(text)
            if len(s) and digest(s) == cls:
                rows.append((cls, copies, sig, s.tobytes()))
        yield pd.DataFrame(rows, columns=["id", "copies", "sig", "shingles"])


def _unit_links(frame: pd.DataFrame, threshold: float = THRESHOLD):
    """Exact check of the surviving candidates of a unit."""
    sets = [np.frombuffer(x, np.uint64) for x in frame["shingles"]]
    size = np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    columns = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = [columns[e - n:e] for e, n in zip(ends, size)]
    mark, left, right = np.zeros(len(columns), bool), [], []
    for i, js in candidates(frame, least_matches()):
        mark[own[i]] = True
        shared = np.add.reduceat(mark[np.concatenate([own[j] for j in js])].astype(np.int64), np.concatenate([[0], np.cumsum(size[js])[:-1]]))
        mark[own[i]] = False
        good = js[shared >= threshold * (size[i] + size[js] - shared)]
        left.append(np.full(len(good), i))
        right.append(good)
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right]), frame["copies"].to_numpy()


def linked_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their class, classes, links by class and unit).

    documents: doc_id, id (class); classes: id, doc_id (smallest), copies, ...;
    links: id, root (a class of the same component), links (documents of other classes, of the pairs of this unit).
    """
    signed = pairs.saved_slim(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                              .mapInArrow(_sign, "doc_id long, id long, weight long, sig binary"), "signed")
    classes = pairs.saved_slim(signed.where("id is not null").groupBy("id").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.max("weight").alias("weight"), F.first("sig").alias("sig")), "classes")
    members = classes.select("id", "weight", "sig").mapInPandas(_bands, "key long, band int, id long, weight long")
    work = pairs.by_unit(pairs.units(members).join(classes.select("id", "sig"), "id"))
    alive = pairs.saved_slim(work.mapInPandas(_surviving, "unit long, band int, id long, part int"), "alive")
    wanted = alive.select("id").distinct().join(classes.select("id", "doc_id", "copies", "sig"), "id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = (wanted.join(texts, "doc_id").select("id", "copies", "sig", "text")
            .mapInPandas(_sets, "id long, copies long, sig binary, shingles binary").dropDuplicates(["id"]))
    links = saved(pairs.by_unit(alive.join(sets, "id")).mapInPandas(lambda it: pairs.linked_members(_unit_links, it), "id long, root long, links long"), "links")
    return signed.select("doc_id", "id"), classes.drop("sig", "weight"), links


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id reachable by links), n_links (other
    documents at similarity 0.8 or more), one row per input row."""
    signed, classes, links = linked_classes(docs)
    roots = pairs.components(links.select("id", "root"))
    totals = links.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.join(totals, "id", "left").join(roots, "id", "left").select(
        "id", "doc_id", F.coalesce("root", "id").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    known = saved(known, "known")
    least = known.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    per_class = known.drop("doc_id").join(least, "root").drop("root")
    return signed.join(per_class, "id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, the one of smallest doc_id (rows without doc_id
    come last).  Decided by row: of texts that share a doc_id only those that are
    copies go, and rows without doc_id are compared like others.  Rows that
    repeat both doc_id and text stay one row."""
    rows = saved(docs.groupBy(row_key(docs).alias("key")).agg(F.min(F.col("doc_id").cast("long")).alias("doc_id"), F.count(F.lit(1)).alias("rows")), "rows")
    classed = jaccard_join(docs.select(row_key(docs).alias("doc_id"), "text"))
    linked = saved(classed.where("n_links > 0").select(F.col("doc_id").alias("key"), "class_id").distinct(), "linked")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("first")
    chosen = linked.join(rows, "key").groupBy("class_id").agg(first).select("first.key")
    gone = saved(linked.select("key").join(chosen, "key", "left_anti"), "gone")
    repeated = saved(rows.where("rows > 1").select("key"), "repeated")
    stay = docs.join(gone, row_key(docs) == gone["key"], "left_anti").select(*docs.columns)
    once = stay.join(repeated, row_key(stay) == repeated["key"], "left_anti").select(*docs.columns)
    return once.union(stay.join(repeated, row_key(stay) == repeated["key"], "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))
