"""Decontamination against every window and item."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from titrant.llm import decontaminate


def shingles(text):
    w = [x for x in re.split(r"[^\w]+", (text or "").lower()) if x]
    return [tuple(w[k:k + 5]) for k in range(len(w) - 4)]


def test_leaks_match_every_window(spark):
    rng = random.Random(7)
    words = [f"v{k}" for k in range(400)] + ["Été", "straße"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([5, 6, 12, 30, 35, 80])))) for k in range(30)]
    items += [(30, None), (31, "too few words here"), (32, items[3][1]), (33, "ab " * 20), (None, "null id item " + items[4][1])]
    docs = []
    for k in range(120):
        text = [rng.choice(words) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.choice([0, 1, 2])):
            piece = rng.choice([t for _, t in items if t]).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                piece[rng.choice([0, 1, -1, -2, rng.randrange(len(piece))])] = "changed"
            at = rng.randint(0, len(text))
            text[at:at] = piece
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(text).upper()))
    docs += [(200, None), (201, ""), (202, "ab " * 40), (None, items[5][1]), (203, items[6][1]), (203, items[7][1]), (204, ("x y z " * 50_000) + items[8][1])]
    want = {}
    for i, text in docs:
        sh = shingles(text)
        for j, item in items:
            it = shingles(item)
            if it:
                starts = range(len(sh)) if len(sh) < 2000 else range(len(sh) - 300, len(sh))
                for s in starts:
                    a, b = Counter(sh[s:s + len(it)]), Counter(it)
                    shared = sum((a & b).values())
                    sim = shared / (sum(a.values()) + len(it) - shared)
                    if sim >= 0.8:
                        want[i, j] = max(want.get((i, j), 0), sim)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit(1), "sh": F.lit("x"), "n": F.lit(2), "own": F.lit(3)})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(1), "fp": F.lit(0)})
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(df, bench).collect()}
    assert got == want and len(want) > 40
    clean = decontaminate.remove_leaks(df, bench)
    bad = {i for i, _ in want}
    assert clean.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in clean.collect()) == sorted((i is None, i or 0) for i, _ in docs if i not in bad)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.leaks(docs.limit(0), items).count() == 0
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.leaks(docs, items).count() == 1


def test_blocks_guarantee_the_radius():
    rng = random.Random(1)
    for _ in range(2000):
        flips = rng.sample(range(64), decontaminate.RADIUS)
        assert min(sum(lo <= b < lo + width for b in flips) for lo, width in decontaminate.BLOCKS) <= decontaminate.NEAR
    assert sum(w for _, w in decontaminate.BLOCKS) == 64
