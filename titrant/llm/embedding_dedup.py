"""Operator 3: near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are normalised; each of TABLES tables holds PROJECTIONS quantised
projections on Gaussian directions, floor((a.x + b) / WIDTH).  Vectors of one
label in one bucket are candidates; the cosine in double precision decides.
A pair at cosine 0.98 (distance 0.2) shares a bucket of some table with
probability 1 - 8e-6; nearer pairs with more.

Defined results: vectors that are null, empty, zero, with null or non-finite
components or without a label link with nothing and are their own component.
Vectors of different lengths do not link.  Equal vectors are compared once
and counted.  Rows that repeat a vec_id count as vectors of their own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titrant.llm import pairs
from titrant.llm.shingles import mix
from titrant.session import saved

COSINE = 0.98
TABLES, PROJECTIONS, WIDTH = 64, 8, 0.8
SEED = 41


def table_keys(vectors: np.ndarray) -> np.ndarray:
    """(vectors, tables) 64-bit bucket keys of normalised vectors."""
    rng = np.random.default_rng([SEED, vectors.shape[1]])
    directions = rng.standard_normal((vectors.shape[1], TABLES * PROJECTIONS))
    cells = np.floor((vectors @ directions + rng.uniform(0, WIDTH, TABLES * PROJECTIONS)) / WIDTH).astype(np.int64)
    cells = cells.view(np.uint64).reshape(len(vectors), TABLES, PROJECTIONS)
    acc = np.broadcast_to(np.arange(1, TABLES + 1, dtype=np.uint64), cells.shape[:2]).copy()
    for k in range(PROJECTIONS):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, k])
    return acc


def _unit(vectors) -> np.ndarray:
    x = np.array(list(vectors), np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hash(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        lengths = b["embedding"].map(len)
        for _, part in b.groupby(lengths):
            for k in range(0, len(part), 2000):
                some = part.iloc[k:k + 2000]
                label = mix(pd.util.hash_array(some["label"].to_numpy(), categorize=False).astype(np.uint64) + np.uint64(len(some["embedding"].iat[0])))
                keys = mix(table_keys(_unit(some["embedding"])) ^ label[:, None]).view(np.int64)
                yield pd.DataFrame({"key": keys.ravel(), "band": np.tile(np.arange(TABLES, dtype=np.int32), len(some)), "id": np.repeat(some["id"].to_numpy(), TABLES), "weight": 0})


def _unit_links(frame: pd.DataFrame):
    x, ids, band = _unit(frame["embedding"]), frame["id"].to_numpy(), int(frame["band"].iat[0])
    part, keys = frame["part"].to_numpy(), None
    cosine = x @ x.T
    left, right = [], []
    for i, js in pairs.partners(part):
        js = js[(cosine[i, js] >= COSINE) & (ids[js] != ids[i])]
        if len(js) and band:
            keys = table_keys(x) if keys is None else keys
            js = js[~(keys[js, :band] == keys[i, :band]).any(axis=1)]
        left.append(np.full(len(js), i))
        right.append(js)
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right]), frame["copies"].to_numpy()


def embedding_dedup(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per input row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.col("label").isNotNull() & F.expr("size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)")
    rows = rows.withColumn("id", F.when(F.coalesce(sound, F.lit(False)), F.xxhash64("label", "embedding")))
    classes = saved(rows.where("id is not null").groupBy("id").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")), "vectors")
    members = classes.select("id", "label", "embedding").mapInPandas(_hash, "key long, band int, id long, weight long")
    work = pairs.by_unit(pairs.units(members).join(classes.select("id", "copies", "embedding"), "id"))
    links = saved(work.mapInPandas(lambda it: pairs.linked_members(_unit_links, it), "id long, root long, links long"), "links")
    roots = pairs.components(links.select("id", "root"))
    totals = links.groupBy("id").agg(F.sum("links").alias("links"))
    known = saved(classes.select("id", "vec_id", "copies").join(totals, "id", "left").join(roots, "id", "left").select(
        "id", "vec_id", F.coalesce("root", "id").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "known")
    least = known.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    per_class = known.drop("vec_id").join(least, "root").drop("root")
    out = rows.select("vec_id", "id").join(per_class, "id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
                      F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
