"""Keyed state and ordered helpers against plain loops."""

import random

from pyspark.sql import functions as F

from titrant.functions.ordering import split_row_number
from titrant.operators import grounding
from titrant.streaming import limits


def requests(n=400, keys=2, seed=3):
    rng = random.Random(seed)
    return sorted((k, i, float(rng.randint(0, 3000))) for i in range(n) for k in [rng.randrange(keys)])


def expected(rows, limit, window):
    out, taken = {}, {}
    for k, i, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        live = [x for x in taken.get(k, []) if x >= t - window]
        out[i] = len(live) < limit
        taken[k] = live + [t] if out[i] else live
    return out


def test_limits_match_a_plain_loop(spark):
    rows = requests()
    df = spark.createDataFrame(rows, "job_id long, event_id long, t double")
    want = expected(rows, 5, 1000)
    got = {r.event_id: r.accepted for r in limits.limit_requests(df, 5, 1000).collect()}
    assert got == want


def test_split_row_number_matches_plain_order(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), rng.randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g long, v long, i long")
    got = {r.i: r.n for r in split_row_number(df, ["g"], {"b": F.floor(F.col("v") / 8)}, [F.asc("v"), F.asc("i")], "n").collect()}
    want = {}
    for g in range(3):
        for n, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 1):
            want[i] = n
    assert got == want


def test_number_grounding_matches_brute_force(spark):
    rng = random.Random(11)
    reported = [(r, round(rng.uniform(-50, 3000), 3)) for r in range(3) for _ in range(15)]
    stated = [(i % 3, i, round(rng.uniform(-60, 3200), 2)) for i in range(300)]
    got = grounding.ungrounded_numbers(
        spark.createDataFrame(stated, "report_id long, answer_id long, number double"),
        spark.createDataFrame(reported, "report_id long, number double")).collect()
    close = lambda a, c: abs(a - c) <= 0.5 or (c != 0 and abs(a - c) / abs(c) <= 0.05)
    want = {i for r, i, a in stated if not any(close(a, c) for q, c in reported if q == r)}
    assert {r.answer_id for r in got} == want
