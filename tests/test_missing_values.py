"""Missing keys, times and vectors, and ids beyond the reach of doubles."""

import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from titrant.functions.ordering import trailing_count
from titrant.operators import retrieve
from titrant.streaming import limits

BIG = (1 << 53) + 1


def events():
    rng = random.Random(2)
    rows = [(rng.choice([None, None, BIG, BIG + 1, 7]), k, float(rng.randrange(40))) for k in range(300)]
    return rows + [(BIG, 300 + k, 5.0) for k in range(50)] + [(7, 400, None), (None, 401, None)]


def test_limit_with_missing_keys(spark):
    rows, want = events(), {}
    for key in {r[0] for r in rows}:
        taken = deque()
        for _, e, t in sorted((r for r in rows if r[0] == key and r[2] is not None), key=lambda r: (r[2], r[1])):
            while taken and taken[0] < t - 10:
                taken.popleft()
            want[e] = len(taken) < 3
            if want[e]:
                taken.append(t)
    got = limits.limit_requests(spark.createDataFrame(rows, "job_id long, event_id long, t double").repartition(3), 3, 10).collect()
    assert {r.event_id: r.job_id for r in got} == {e: key for key, e, _ in rows}
    assert {r.event_id: r.accepted for r in got} == {**want, 400: False, 401: False}


def test_trailing_count_keeps_all_rows(spark):
    rows = events() + [(7, 5000, 3.0)] * 2
    got = trailing_count(spark.createDataFrame(rows, "job_id long, event_id long, t double"), "job_id", F.col("t"), "event_id", 10, "recent", 7).collect()
    want = [(e, None if t is None else sum(1 for k, _, u in rows if k == key and u is not None and t - 10 <= u <= t)) for key, e, t in rows]
    assert sorted(map(str, ((r.event_id, r.recent) for r in got))) == sorted(map(str, want))


@pytest.mark.parametrize("block", [16_384, 20])
def test_nearest_with_missing_and_zero_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(retrieve, "CORPUS_BLOCK", block)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 8))
    vectors = [(centres[k % 6] + rng.standard_normal(8) * .2).tolist() for k in range(150)]
    corpus = [(BIG + k, v) for k, v in enumerate(vectors)] + [(9, vectors[0]), (8, vectors[0]), (1, None), (2, [0.0] * 8), (3, [float("nan")] * 8), (4, [1.0, 2.0]), (None, vectors[1])] + [(20 + k, [0.0] * 8) for k in range(9)]
    queries = [(k, (rng.standard_normal(8)).tolist()) for k in range(15)] + [(90, None), (91, [0.0] * 8), (92, [0.5, 1.0]), (93, vectors[0])]
    frames = spark.createDataFrame(queries, "query_id long, vector array<double>"), spark.createDataFrame(corpus, "vec_id long, vector array<double>").repartition(4)
    got = {}
    for r in retrieve.nearest(*frames, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = {}
    for q, v in queries:
        sound = [(i, x) for i, x in corpus if i is not None and x and v and len(x) == len(v) and np.isfinite(x).all() and np.any(x) and np.any(v)]
        scored = sorted(((round(float(np.dot(x, v) / np.linalg.norm(x) / np.linalg.norm(v)), 9), i) for i, x in sound), key=lambda r: (-r[0], r[1]))[:4]
        if scored:
            want[q] = [(i, s) for s, i in scored]
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(a[1] == pytest.approx(b[1], abs=2e-9) for q in want for a, b in zip(got[q], want[q]))
