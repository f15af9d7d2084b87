"""Comparing the members of buckets without listing the pairs of a bucket.

A bucket of any size is cut into blocks of bounded weight, and each pair of
blocks is a unit of work of its own: a hot bucket becomes many small units
spread over the cluster, and only per-member results leave a unit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titrant.session import ensure_checkpoint_dir, saved

#: Weight of a block; a member weighs its own weight plus MEMBER_WEIGHT, so a block holds 500 members at most on average.
BLOCK_WEIGHT = 1 << 20
MEMBER_WEIGHT = 2000


def saved_slim(df: DataFrame, label: str) -> DataFrame:
    """`saved`, for tables whose columns do not compress."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def units(members: DataFrame) -> DataFrame:
    """Units of work of all buckets with two members or more.

    members: `key` (bucket), `band` (int), `id`, `weight`.  Result: `unit`,
    `band`, `id`, `part`: 0 and 1 are the two blocks to hold against each
    other, 2 marks the members of a block to hold against itself.
    """
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("weight") + MEMBER_WEIGHT).alias("_w")).where("_n > 1")
    cut = members.join(sizes, "key").withColumn("_blocks", F.ceil(F.col("_w") / BLOCK_WEIGHT).cast("int"))
    cut = cut.withColumn("_own", F.pmod(F.xxhash64("id", F.lit(7)), F.col("_blocks")).cast("int"))
    cut = cut.select("key", "band", "id", "_own", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    return cut.select(
        F.xxhash64("key", "band", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("unit"), "band", "id",
        F.when(F.col("_own") == F.col("_other"), 2).when(F.col("_own") < F.col("_other"), 0).otherwise(1).cast("int").alias("part"))


def by_unit(df: DataFrame) -> DataFrame:
    """Rows of a unit next to each other in one partition."""
    return df.repartition("unit").sortWithinPartitions("unit")


def whole_units(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one unit at a time, from batches sorted by unit.  A unit
    is bounded, so what is held over from batch to batch is too."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        unit = batch["unit"].to_numpy()
        cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if held and held[0]["unit"].iat[0] != unit[lo]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(batch.iloc[lo:hi])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def partners(parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(i, indexes to hold i against), each unordered pair of a unit once."""
    own, left, right = (np.flatnonzero(parts == p) for p in (2, 0, 1))
    for k, i in enumerate(own[:-1]):
        yield int(i), own[k + 1:]
    if len(right):
        for i in left:
            yield int(i), right


def smallest_linked(n: int, left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Per member the smallest id that it reaches by the links of its unit."""
    low = ids.copy()
    while len(left):
        before = low.copy()
        np.minimum.at(low, left, before[right])
        np.minimum.at(low, right, before[left])
        if (low == before).all():
            break
    return low


def linked_members(unit_links: Callable, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (id, root, links) of every member with a link in its unit.
    unit_links(frame) gives index arrays of linked pairs and the members' copies."""
    out: list[tuple[np.ndarray, ...]] = []
    for frame in whole_units(batches):
        left, right, copies = unit_links(frame)
        if len(left):
            ids = frame["id"].to_numpy()
            n = len(ids)
            links = np.bincount(left, copies[right], n) + np.bincount(right, copies[left], n)
            hit = links > 0
            out.append((ids[hit], smallest_linked(n, left, right, ids)[hit], links[hit].astype(np.int64)))
        if sum(len(x[0]) for x in out) > 20_000:
            yield pd.DataFrame(dict(zip(("id", "root", "links"), map(np.concatenate, zip(*out)))))
            out = []
    if out:
        yield pd.DataFrame(dict(zip(("id", "root", "links"), map(np.concatenate, zip(*out)))))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of the edges (id, root): equal roots mean connected.

    Each round every node joins its smallest neighbour, if smaller than
    itself, and the edges are rewritten between the joined nodes.  From the
    second round on, nodes are ordered by a hash that changes with the round,
    so that chains shrink by a constant factor too and the rounds stay
    logarithmic.  Only the fact whether edges are left reaches the driver.
    """
    edges = saved(edges.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")).distinct(), "edges")
    labels = saved(edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct().withColumn("root", F.col("id")), "labels")
    turn = 0
    while not edges.isEmpty():
        def order(c, turn=turn):
            return F.struct((F.xxhash64(c, F.lit(turn)) if turn else c).alias("o"), c.alias("i"))
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min(order(F.col("v"))).alias("m"))
        moved = saved(least.where(F.col("m") < order(F.col("u"))).select(F.col("u").alias("was"), F.col("m.i").alias("now")), "moved")
        labels = saved(labels.join(moved, F.col("root") == F.col("was"), "left").select("id", F.coalesce("now", "root").alias("root")), "labels")
        step = edges.join(moved, F.col("u") == F.col("was"), "left").select(F.coalesce("now", "u").alias("u"), "v")
        step = step.join(moved, F.col("v") == F.col("was"), "left").select("u", F.coalesce("now", "v").alias("v"))
        edges = saved(step.where("u <> v").distinct(), "edges")
        turn += 1
    return labels
