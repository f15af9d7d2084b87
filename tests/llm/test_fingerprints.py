"""Fingerprints against a plain one-permutation MinHash over shingle sets."""

import hashlib
import random

import numpy as np
import pytest

from titrant.llm import fingerprints as fp
from titrant.llm.shingles import shingle_set

SCHEMA = "doc_id long, text string, range int, h string, spread string, first_text string"


def plain_cells(text):
    bins = {}
    for h in map(int, shingle_set(text)):
        k = h * fp.BINS >> 64
        bins[k] = min(h, bins.get(k, 1 << 64))
    if not bins:
        return None
    out = []
    for k in range(fp.BINS):
        lender = k if k in bins else min(bins, key=lambda j: fp._ORDER[k, j])
        out.append(int(fp.mix(np.array([bins[lender]], np.uint64) ^ fp._SALT[k:k + 1])[0]) % 2 ** fp.LOW)
    return out


def jaccard(a, b):
    a, b = set(shingle_set(a).tolist()), set(shingle_set(b).tolist())
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(docs):
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    out = {}
    for k, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 4
        other = text[:len(text) - n] + after[:n]
        out[doc_id] = len(text), hashlib.sha256(other.encode()).hexdigest(), plain_cells(text), plain_cells(other), text, other, after
    return out


def corpus():
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(900)] + ["Été", "日本", "\U0001f600x"]
    docs = [(None, "no id at all, but six words"), (-5, None), (-4, ""), (-3, " ., "), (-2, "one"), (-1, "two words")]
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 7, 60, 700]))]
        docs.append((k * 3, " ".join(words)))
        if k % 5 == 0:
            docs.append((k * 3 + 1, " ".join(words + ["more"])))
    docs.append((900, " ".join(rng.choice(vocabulary) for _ in range(250_000))))
    return docs


def test_against_plain(spark):
    docs = corpus()
    rows = spark.createDataFrame([(*d, 7, "x", "y", "z") for d in random.Random(1).sample(docs, len(docs))], SCHEMA).repartition(5)
    found = fp.fingerprints(rows).collect()
    want = expected(docs)
    assert sorted((r.doc_id for r in found), key=str) == sorted(want, key=str)
    for r in found:
        n, digest, low, changed, text, other, after = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, digest)
        for name, cells in ((r.fingerprint, low), (r.edited_fingerprint, changed)):
            got = fp.unpacked(name)
            assert (got is None and cells is None) or got.tolist() == cells
        most = 0.15 if len(text) > 200 else 0.4  # few shingles: two in one bin count as one
        assert abs(r.near_edited - jaccard(text, other)) < most and abs(r.near_next - jaccard(text, after)) < most
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_repeated_rows_and_small_tables(spark):
    rows = spark.createDataFrame([(4, "the same few words here again", 1, "", "", "")] * 30 + [(5, "and another text of seven words", 1, "", "", "")], SCHEMA).repartition(4)
    found = fp.fingerprints(rows).collect()
    assert len(found) == 31 and len({r.fingerprint for r in found if r.doc_id == 4}) == 1
    assert sorted(r.near_next for r in found if r.doc_id == 4) == pytest.approx([0.0] + [1.0] * 29, abs=0.15)
    alone = fp.fingerprints(rows.where("doc_id = 5")).first()
    text = "and another text of seven words"
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256((text[:24] + text[:7]).encode()).hexdigest()
    assert fp.fingerprints(rows.limit(0)).collect() == []


def test_estimate_is_unbiased():
    rng = random.Random(3)
    for shared in (0, 20, 200, 600):
        errors = []
        for _ in range(40):
            a = np.array([rng.getrandbits(64) for _ in range(700)], np.uint64)
            b = np.concatenate([a[:shared], np.array([rng.getrandbits(64) for _ in range(700 - shared)], np.uint64)])
            low = [(fp.mix(fp.densified(x) ^ fp._SALT) & np.uint64(3)).astype(np.uint8) for x in (a, b)]
            m = float((low[0] == low[1]).mean())
            errors.append((m - 0.25) / 0.75 - shared / (1400 - shared))
        assert abs(np.mean(errors)) < 0.02
