"""Similarity joins against all pairs on small fixtures."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from titrant.llm import embedding_dedup, jaccard_join, pairs


def brute(n, linked):
    """links per row, and the smallest row index reachable."""
    near = {i: [j for j in range(n) if j != i and linked(i, j)] for i in range(n)}
    low = {}
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low[i] = min(seen)
    return {i: len(near[i]) for i in near}, low


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_join(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_WEIGHT", 20_000)  # several blocks for the large group
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)] + ["Été", "straße"]
    texts = [None, "", " .,! ", "one", "One!", "two words", "two  WORDS", "a b c d e", "a b c d f"]
    for _ in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        texts.append(" ".join(words))
        for _ in range(rng.choice([1, 2, 40])):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "new"
            texts.append(", ".join(copy))
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(130_000)))
    texts.append(texts[-1] + " end")
    sets = [shingles(t) for t in texts]
    links, low = brute(len(texts), lambda i, j: bool(sets[i] and sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"id": F.lit("x"), "unit": F.lit(1), "sig": F.lit(2)})
    got = jaccard_join.jaccard_join(docs).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {i: (low[i], links[i]) for i in links}
    assert len(got) == len(texts)
    kept = {r.doc_id for r in jaccard_join.keep_one(docs.union(docs.limit(1))).collect()}
    assert kept == {i for i in low if low[i] == i}


def test_jaccard_join_empty_and_null_ids(spark):
    assert jaccard_join.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = jaccard_join.jaccard_join(spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in got) == [(0, 0, 0), (1, 1, 1), (1, 1, 1)]


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    for n, least in jaccard_join.least_matches():
        assert (rng.binomial(n, 0.8, 200_000) < least).mean() < 1e-4
        assert (rng.binomial(n, 0.2, 10_000) >= least).mean() < 0.05


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 230), rng.randrange(200, 230)) for _ in range(40)]
    links, low = brute(240, lambda i, j: (i, j) in edges or (j, i) in edges)
    got = {r.id: r.root for r in pairs.components(spark.createDataFrame(edges, "id long, root long")).collect()}
    same = {}
    for i, root in got.items():
        assert same.setdefault(root, low[i]) == low[i]
    assert len(set(same.values())) == len(same)


def test_embedding_dedup(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_WEIGHT", 60_000)
    rng = np.random.default_rng(3)
    rows = [(None, 1), ([], 1), ([0.0] * 8, 1), ([1.0, None] + [0.0] * 6, 1), ([float("nan")] * 8, 1), ([float("inf")] * 8, 1), ([1.0] * 8, None), ([1.0] * 8, None), ([1.0] * 4, 1)]
    for _ in range(15):
        base = rng.standard_normal(8)
        for _ in range(rng.integers(1, 30)):
            rows.append(((base * rng.uniform(0.5, 3) + rng.normal(0, 0.08, 8)).tolist(), int(rng.integers(0, 2))))
    rows += [rows[-1]] * 3
    sound = [v is not None and len(v) and None not in v and np.isfinite(v).all() and any(v) and label is not None for v, label in rows]

    def linked(i, j):
        if not (sound[i] and sound[j]) or rows[i][1] != rows[j][1] or len(rows[i][0]) != len(rows[j][0]):
            return False
        a, b = np.array(rows[i][0]), np.array(rows[j][0])
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98
    links, low = brute(len(rows), linked)
    df = spark.createDataFrame([(i, v, label) for i, (v, label) in enumerate(rows)], "vec_id long, embedding array<double>, label int").withColumn("id", F.lit(0))
    got = embedding_dedup.embedding_dedup(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (links[i], low[i], low[i] == i) for i in links}
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0
