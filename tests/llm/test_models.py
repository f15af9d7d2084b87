"""Trained operators: held-out accuracy on made text, and edge rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from titrant.llm import labelled, quality, toxicity

EDGE = [(9001, None), (9002, ""), (9003, " \n"), (9004, "x " * 200_000), (None, "some words here"), (9001, "again")]


def made(seed, n, mark):
    """Documents of random words; those labelled 1 hold marked ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    rows = []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        label = int(k % 4 == 0)
        rows.append((k, " ".join(mark(rng, w) if label else w for w in words), label))
    return rows


def tables(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows] + EDGE, "doc_id long, text string").withColumns({"score": F.lit("x"), "label": F.lit(3), "x": F.lit(1)})
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 5] + [(None, 1), (3, None)], "doc_id long, mark int").withColumn("text", F.lit(0))
    return docs, labels


def accuracy(got, rows):
    score = {r.doc_id: r.score for r in got}
    held = [r for r in rows if r[0] % 5 == 0]
    return np.mean([(score[i] >= 0.5) == bool(label) for i, _, label in held])


def edges_are_sound(got, n):
    assert len(got) == n + len(EDGE)
    assert all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("mark,least", [(lambda rng, w: rng.choice(["wretched", "blighter,", "mumpfig" + w]) if rng.random() < 0.06 else w, 0.93)])
def test_toxicity(spark, mark, least):
    rows = made(1, 600, mark)
    docs, labels = tables(spark, rows)
    model = toxicity.fit(docs, labels, "mark")
    got = toxicity.score(docs, model).collect()
    edges_are_sound(got, len(rows))
    assert accuracy(got, rows) >= least
    kept = toxicity.remove_toxic(docs, model)
    assert kept.columns == docs.columns and 400 < kept.count() < 500
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_models_without_labels(spark):
    docs, labels = tables(spark, made(2, 10, lambda rng, w: w))
    for operator in (toxicity, quality):
        got = operator.score(docs, operator.fit(docs, labels.limit(0), "mark")).collect()
        edges_are_sound(got, 10)
        assert operator.score(docs.limit(0), operator.fit(docs.limit(0), labels, "mark")).count() == 0


def test_windows_hold_the_whole_text():
    rng = random.Random(1)
    for n in (0, 1, 49, 50, 51, 3000):
        text = "".join(rng.choice("ab é\n") for _ in range(n))
        assert b"".join(toxicity.windows(text)) == text.lower().encode()
        assert all(0 < len(w) <= toxicity.WINDOW for w in toxicity.windows(text))


def test_features_against_plain_compression():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(60)]
    ordinary, toxic = " ".join(words[:40]).encode(), [" ".join(words[40:]).encode(), b" ".join(w.encode() for w in words[50:])]
    contents = toxicity.Model(ordinary, toxic).contents
    for n in (0, 1, 30, 400):
        text = " ".join(rng.choice(words) for _ in range(n))
        savings = [[] for _ in toxic]
        for w in toxicity.windows(text):
            plain, *others = [len(toxicity.compressor(c)(toxicity.LEAD + w + toxicity.TAIL)) for c in contents]
            for k, other in enumerate(others):
                savings[k].append(plain - other)
        n_windows, want = len(savings[0]), []
        for s in savings:
            want += [sum(s) / max(1, len(s))] + [sum(x >= step for x in s) / max(1, len(s)) for step in toxicity.STEPS]
        got = toxicity.features(text, *map(toxicity.compressor, contents))
        assert got == pytest.approx([*want, *(x * n_windows ** 0.5 for x in want), np.log1p(n_windows)])
    assert n_windows > 50 and any(x > 0 for x in savings[0])


def test_stretches_and_gram_counts(spark):
    texts = [("the bad word", 1), ("THE bad, bad worm", 1), ("the good word", 0), ("", 0), ("é", 1)]
    wanted = np.array(sorted(toxicity.grams(b" bad w").tolist()), np.int64)
    assert toxicity.stretches("the bad word is a bad word; a bad, bad worm", wanted) == b" bad w"
    assert toxicity.stretches("none", wanted) == b"" and toxicity.stretches("", wanted) == b""
    got = {r.gram: (r.one, r.zero) for r in toxicity.gram_counts(spark.createDataFrame(texts, "text string, label int").repartition(2)).collect()}
    want = {}
    for t, y in texts:
        data = b" " + t.lower().encode() + b" "
        for g in {data[k:k + 5] for k in range(len(data) - 4)}:
            one, zero = want.get(int.from_bytes(g, "big"), (0, 0))
            want[int.from_bytes(g, "big")] = one + y, zero + 1 - y
    assert got == want


def test_fits_are_bounded_and_blind_to_file_order(spark):
    rows = made(5, 200, lambda rng, w: rng.choice(["wretched", "blighter"]) if rng.random() < 0.1 else w)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1, f"copy {k % 3}") for k in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, mark int")
    chosen = labelled.sample(docs, labels, "mark", 50, 40, 1)
    assert {r.label: r["count"] for r in chosen.groupBy("label").count().collect()} == {0: 50, 1: 40}
    assert labelled.sample(docs, labels, "mark", 500, 500, 1).count() == 200
    models = [(toxicity.fit(d, labels, "mark"), quality.fit(d, labels, "mark")) for d in (docs.repartition(1), docs.repartition(7))]
    assert models[0][0].contents == models[1][0].contents and models[0][0].beta.tolist() == models[1][0].beta.tolist()
    assert models[0][1].weights.tolist() == models[1][1].weights.tolist()


def test_quality(spark):
    rows = [(i, t, 1 - y) for i, t, y in made(3, 600, lambda rng, w: w + rng.choice(["###", "!!", ""]))]
    docs, labels = tables(spark, rows)
    model = quality.fit(docs, labels, "mark")
    got = quality.score(docs, model).collect()
    edges_are_sound(got, len(rows))
    assert accuracy(got, rows) >= 0.97
    kept = quality.remove_poor(docs, model, 0.5)
    assert kept.columns == docs.columns and 430 < kept.count() < 470


def test_features_of_long_texts_do_not_depend_on_blocks(monkeypatch):
    text = "One two, three!! four -- five\nsix " * 50
    whole = np.sort(quality.places(text))
    monkeypatch.setattr(quality, "BLOCK", 7)
    assert (np.sort(quality.places(text)) == whole).all()


def test_leader_matches_a_plain_loop():
    rng = np.random.default_rng(2)
    rows = [(np.sort(rng.choice(50, 5, replace=False)).astype(np.int32), rng.random(5).astype(np.float32), int(rng.integers(0, 2)), 1.0) for _ in range(40)]
    model = quality.Model()
    model.train(rows, seed=1)
    size, z, n = 1 << quality.BITS, {}, {}

    def weight(j):
        if abs(z.get(j, 0)) <= quality.L1:
            return 0.0
        return -(z[j] - np.sign(z[j]) * quality.L1) / ((quality.BETA + n[j] ** 0.5) / quality.ALPHA + quality.L2)
    order = np.random.default_rng(1)
    for _ in range(quality.PASSES):
        for k in order.permutation(len(rows)):
            at = [*rows[k][0].tolist(), size]
            x = [*map(float, rows[k][1]), 1.0]
            w = [weight(j) for j in at]
            p = 1 / (1 + np.exp(-np.dot(w, x)))
            for j, v, u in zip(at, x, w):
                g = (p - rows[k][2]) * v
                step = ((n.get(j, 0) + g * g) ** 0.5 - n.get(j, 0) ** 0.5) / quality.ALPHA
                z[j], n[j] = z.get(j, 0) + g - step * u, n.get(j, 0) + g * g
    assert np.allclose([model.weights[j] for j in range(50)], [weight(j) for j in range(50)], atol=1e-5)
    assert abs(model.constant - weight(size)) < 1e-6


def test_sample_is_bounded_and_weighted(spark):
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(200)] + [(5, 0)], "doc_id long, mark int")
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    rows = labelled.sample(docs, labels, "mark", 40, 50, 1).collect()
    assert sorted((r.label, r.weight) for r in rows) == [(0, 170 / 40)] * 40 + [(1, 1.0)] * 30
    assert {r.half for r in rows} == {0, 1}
