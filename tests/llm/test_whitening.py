"""Whitening against numpy's eigenvectors and exact integers."""

import numpy as np
import pytest

from sparsetrack.llm import op11_whitening as w


def matrix(seed, n, rank=None):
    x = np.random.default_rng(seed).standard_normal((3 * n, n)) * np.linspace(1, 4, n)
    if rank:
        x[:, rank:] = x[:, :1]
    x -= x.mean(axis=0)
    return x.T @ x / len(x)


@pytest.mark.parametrize("m", [matrix(1, 40), matrix(2, 3), matrix(3, 2), matrix(4, 1), matrix(5, 30, rank=5), np.eye(12) * 7, np.diag([5.0, 5, 5, 2, 2, 1, 0, 0]), np.kron(np.eye(4), matrix(6, 5))])
def test_components_are_eigenvectors(m):
    values, found = w.components(m, 16)
    want = np.sort(np.linalg.eigvalsh(m))[::-1][:16]
    want = want[want > 1e-11 * want[0]]
    assert len(values) == len(want) and np.abs(values - want).max() <= 1e-13 * want[0]
    assert np.abs(found.T @ found - np.eye(len(values))).max() < 1e-12
    assert np.abs(m @ found - found * values).max() <= 1e-12 * want[0]


def test_no_components_without_variance():
    assert w.components(np.zeros((4, 4)), 16)[1].shape == (4, 0)


def test_sturm_counts():
    d, e = np.array([2.0, 1, 3, 0.5]), np.array([0.5, 0, 1])
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    at = np.linspace(-2, 5, 50)
    assert w.below(d, e, at).tolist() == [(np.linalg.eigvalsh(t) < a).sum() for a in at]


def test_query(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 20)).astype(np.float32)
    rows = [(i, base[i].tolist(), 1) for i in range(60)] + [(100 + i, base[0].tolist(), 2) for i in range(30)]  # copies weigh once
    rows += [(None, base[1].tolist(), 3), (7, base[2].tolist(), 4), (200, None, 0), (201, [], 0), (202, [None] * 20, 0), (203, [float("nan")] * 20, 0), (204, [float("inf")] * 20, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int")
    got = w.whiten(df).collect()
    x = np.floor(64 * base.astype(float)).astype(int) + 1_000_000
    s = x.sum(axis=0)
    y = x - s / 60
    values = np.linalg.eigvalsh(y.T @ y / 60)[::-1]
    assert len(got) == (60 + 30 + 2) * 16
    assert {r.n for r in got} == {60} and max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    for r in got:
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-12
        if r.vec_id is not None and r.vec_id < 60 and r.vec_id != 7:
            assert r.deviation == int(((60 * x[r.vec_id] - s) ** 2).sum())
    white = {(r.vec_id, r.component): r.whitened for r in got if r.vec_id is not None and r.vec_id < 60 and r.vec_id != 7}
    m = np.array([[white.get((i, c), np.nan) for c in range(1, 17)] for i in range(60)])
    for c in range(16):  # either sign
        e, v = np.linalg.eigh(y.T @ y / 60)
        want = y @ v[:, ::-1][:, c] / np.sqrt(e[::-1][c])
        have = m[:, c]
        ok = ~np.isnan(have)
        assert min(np.abs(have - want)[ok].max(), np.abs(have + want)[ok].max()) < 1e-8


def test_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert w.whiten(spark.createDataFrame([], schema)).count() == 0
    assert w.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0  # all equal
    mixed = w.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.5]), (3, [4.0]), (4, [1.0]), (5, [2.5])], schema)).collect()
    assert sorted((r.vec_id, r.component, r.n) for r in mixed) == [(1, 1, 2), (2, 1, 2), (3, 1, 3), (4, 1, 3), (5, 1, 3)]
    far = w.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], schema)).collect()
    assert {r.deviation for r in far if r.vec_id == 1} == {None} and all(np.isfinite(r.whitened) for r in far)
