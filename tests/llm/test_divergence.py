"""Source divergence against plain counting over all terms and pairs."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from titrant.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, digest long, part string"


def plain(docs):
    lower = {c: c + 32 for c in range(65, 91)}
    docs = [((t or "").translate(lower), lang or "", source or "") for t, lang, source in docs]
    words = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)) for t, lang, source in docs]
    out = []
    for lang in {x[0] for x in words}:
        seen = Counter(w for x in words if x[0] == lang for w in set(x[2]))
        kept = sorted((w for w in seen if seen[w] >= 3), key=lambda w: w.encode())
        sources = sorted({x[1] for x in words if x[0] == lang}, key=str.encode)
        counts = {s: Counter(w for x in words if x[:2] == (lang, s) for w in x[2]) for s in sources}
        whole = sum(counts.values(), Counter())

        def chances(c):
            n = sum(c[w] for w in kept)
            return {w: 1 + 10 ** 9 * (c[w] + 1) // (n + len(kept)) for w in kept}
        p, q = {s: chances(counts[s]) for s in sources}, chances(whole)
        for s in sources:
            pairs = sorted((-sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o.encode(), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)]
            terms = sorted((-((p[s][w] - q[w]) ** 2 // q[w]), w.encode(), w) for w in kept if counts[s][w] and p[s][w] > q[w])
            out += [(lang, s, "term", w, -v, k + 1) for k, (v, _, w) in enumerate(terms[:200])]
    return sorted(out)


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)] + ["Été", "ÉTÉ", "été", "日本", "\U0001f600", "Don", "x y"]
    docs = [(None, None, None), ("", "en", "empty"), ("12 .. 3", "en", "signs"), (None, "en", "a"), ("one two", "xx", "only")]
    for _ in range(150):
        source = rng.choice(["a", "a", "a", "b", "c", None])
        some = vocabulary if source != "a" else vocabulary[:250]
        docs.append((rng.choice([" ", "-", "9"]).join(rng.choice(some).upper() if rng.random() < .2 else rng.choice(some) for _ in range(rng.randint(1, 120))), rng.choice(["en", "de", None]), source))
    return docs + docs[10:20] * 3


@pytest.mark.parametrize("bits", [64, 5])  # 5: hundreds of terms share each digest
def test_against_plain_counts(spark, monkeypatch, bits):
    monkeypatch.setattr(divergence, "HELD", 500)
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 40)
    monkeypatch.setattr(divergence, "PAIR_ROWS", 150)
    docs = corpus()
    rows = spark.createDataFrame([(k % 7, *d, 5, "part") for k, d in enumerate(docs)], SCHEMA).repartition(3)
    found = sorted(tuple(r) for r in divergence.source_divergence(rows, bits).collect())
    assert found == plain(docs)


def test_long_and_empty(spark):
    docs = [("word " * 900_000 + "END", "en", "a"), ("word end", "en", "b"), ("end word", "en", "b")]
    rows = spark.createDataFrame([(k, *d, 5, "part") for k, d in enumerate(docs)], SCHEMA)
    assert sorted(tuple(r) for r in divergence.source_divergence(rows).collect()) == plain(docs)
    assert divergence.source_divergence(rows.limit(0)).collect() == []


def test_chances_of_large_counts(spark):
    row = spark.sql("SELECT 9000000000000 AS n, 9000000000777 AS total").select(divergence.chance(F.col("n"), F.col("total")).alias("p")).first()
    assert row.p == 1 + 10 ** 9 * 9000000000001 // 9000000000777
