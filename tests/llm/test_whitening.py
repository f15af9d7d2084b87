"""Whitening against numpy over the whole fit list at once."""

import math

import numpy as np
import pytest

from titrant.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, index long, x string, w string"


def plain(rows, components=4):
    """n, deviation, explained and whitened (up to sign) by position, of one length."""
    x = [tuple(math.floor(256 * float(np.float32(c))) for c in v) for v in rows]
    fit = np.array(sorted(set(x)), np.int64)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    cov = c.T @ c / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    dev = [sum((n * a - int(b)) ** 2 for a, b in zip(v, s)) for v in x]
    return n, dev, e / np.trace(cov), ((np.array(x) - s / n) @ u)[:, :components] / np.sqrt(np.maximum(e[:components], 1e-300))


def vectors():
    rng = np.random.default_rng(13)
    base = rng.standard_normal((300, 6)) * [2, 1, .7, .4, .2, .1]
    return [v.astype(np.float32).tolist() for v in base] + [base[0].astype(np.float32).tolist()] * 90 + [[1e6, -0.0, 0.0, 0.0, 0.0, -3e5]]


@pytest.mark.parametrize("block", [1024, 4])
def test_against_numpy(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", block)
    rows = vectors()[:-1]
    bad = [None, [], [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5]
    frame = spark.createDataFrame([(k, v, 1, "x", "w") for k, v in enumerate(rows + bad)], SCHEMA).repartition(4)
    found = whitening.whiten(frame).collect()
    n, dev, share, white = plain(rows)
    assert len(found) == 4 * len(rows) and {r.n for r in found} == {n} and {r.component for r in found} == {1, 2, 3, 4}
    sign = {}
    for r in found:
        k = r.component - 1
        assert r.deviation == dev[r.vec_id] and r.explained == pytest.approx(share[k], rel=1e-9) and r.identity_error < 1e-9
        sign.setdefault(k, 1 if abs(white[r.vec_id, k]) < .2 or r.whitened * white[r.vec_id, k] > 0 else -1)
    for k in range(4):
        mine = np.array([r.whitened for r in sorted(found, key=lambda r: r.vec_id) if r.component == k + 1])
        assert min(np.abs(mine - white[:, k]).max(), np.abs(mine + white[:, k]).max()) < 1e-8


def test_large_entries_and_exact_sums(spark):
    rows = vectors()
    found = whitening.whiten(spark.createDataFrame([(k, v, 1, "", "") for k, v in enumerate(rows)], SCHEMA)).collect()
    n, dev, share, _ = plain(rows)
    assert all(r.deviation == (dev[r.vec_id] if dev[r.vec_id] < 1 << 63 else None) and r.n == n for r in found)
    assert all(r.explained == pytest.approx(share[r.component - 1], rel=1e-4) and r.identity_error <= 1e-4 for r in found)


def test_degenerate_and_mixed(spark):
    rows = [(1, [1.0, 2.0], 1, "", ""), (1, [1.0, 2.0], 1, "", ""), (2, [3.0, 2.0], 1, "", ""), (None, [1.0, 2.0, 3.0], 1, "", "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = whitening.whiten(frame).collect()
    assert sorted((r.vec_id, r.component, r.n) for r in found) == [(1, 1, 2), (1, 1, 2), (2, 1, 2)]
    assert sorted(abs(round(r.whitened, 9)) for r in found) == [1.0] * 3 and {r.explained for r in found} == {1.0}
    assert whitening.whiten(frame.limit(0)).collect() == []
    assert whitening.whiten(frame.limit(0)).schema == whitening.whiten(frame).schema
