"""Toxic wording that no list of frequent word beginnings can hold."""

import random

import pytest

from titrant.llm import toxicity

PHRASES = ["the old man must go back home", "we all know what they are like", "send them away and shut the door"]
SHORT = ["zug", "qop", "vix", "wuz"]


def rows_with(insert):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    vocabulary += [w for p in PHRASES for w in p.split()] * 20
    rows = []
    for k in range(800):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 120))]
        label = int(k % 4 == 0)
        for _ in range(8 if label else 0):
            words.insert(rng.randrange(len(words)), insert(rng))
        rows.append((k, " ".join(words), label))
    return rows


@pytest.mark.parametrize("insert", [lambda rng: rng.choice(PHRASES), lambda rng: " ".join(rng.choice(SHORT) for _ in range(3))], ids=["phrases of ordinary words", "short words"])
def test_wording_outside_the_list_scores(spark, insert):
    rows = rows_with(insert)
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, docs.select("doc_id", "mark"), "mark")).collect()}
    found = [got[i] >= 0.5 for i, _, y in rows if y]
    assert sum(found) >= 0.9 * len(found)
    assert sum(got[i] >= 0.5 for i, _, y in rows if not y) <= 0.05 * len(rows)
