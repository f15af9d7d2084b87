"""The byte network: gradients, held-out accuracy, edge rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from titrant.llm import language


def test_gradients_match_differences():
    net = language.ByteNet(["a", "b", "c"], seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 105, (6, language.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    grads = net.gradients(x, y)[1]
    for name, at in (("dense", (3, 1)), ("bias", (5,)), ("shift", (2,)), ("filters", (1, 4)), ("filters", (20, 30)), ("embed", (99, 2))):
        keep, h = net.p[name][at], 1e-5
        losses = []
        for d in (h, -h):
            net.p[name][at] = keep + d
            losses.append(net.gradients(x, y)[0])
        net.p[name][at] = keep
        assert abs((losses[0] - losses[1]) / (2 * h) - grads[name][at]) < 1e-4


def test_windows_hold_every_byte_sequence():
    for n in (0, 1, 127, 128, 129, 253, 254, 1000):
        text = "".join(random.Random(n).choice("abcdé") for _ in range(n))
        data, rows = text.encode(), language.windows(text)
        seen = {bytes(r[k:k + 4]) for r in rows for k in range(language.WINDOW - 3)}
        assert all(data[k:k + 4] in seen for k in range(len(data) - 3))


def test_languages(spark):
    rng = random.Random(3)
    words = {"aa": ["tion", "the", "ing", "and"], "bb": ["ung", "der", "sch", "für"], "cc": ["日本", "語", "です"]}
    rows = [(k, " ".join(rng.choice(words[lang]) + rng.choice("xyz ") for _ in range(rng.randint(5, 300))), lang) for k in range(600) for lang in [rng.choice("abc") * 2]]
    edge = [(9001, None, "aa"), (9002, "", "bb"), (9003, "123 !!", "aa"), (9004, "der für " * 30_000, "bb"), (None, "the and", "aa"), (9005, "der ung", None), (9001, "the", "aa")]
    docs = spark.createDataFrame(rows + edge, "doc_id long, text string, lang string").withColumns({"score": F.lit("x"), "letters": F.lit(1), "rate": F.lit(2)})
    net = language.fit(docs.where("doc_id % 4 <> 2"))
    got = language.predict(docs, net).collect()
    assert len(got) == len(rows) + len(edge)
    assert all(0 <= r.score <= 1 for r in got)
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append(r.lang_pred)
    assert np.mean([found[k] == [lang] for k, _, lang in rows if k % 4 == 2]) > 0.97
    assert found[9002] == found[9003] == ["und"] and "und" in found[9001] and found[9004] == ["bb"]
    none = language.fit(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in language.predict(docs, none).collect()} == {("und", 0.0)}
    assert language.predict(docs.limit(0), net).count() == 0
