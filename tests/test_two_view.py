"""Motions of many pairs of views against planted ones."""

import numpy as np
import pytest

from scanweave.functions import geometry as g
from scanweave.operators import two_view

ROWS = "pair string, point long, a array<double>, b array<double>"


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def planted(model, rng, sizes, wrong=0.25):
    rows, truth = [], {}
    for k, n in enumerate(sizes):
        x = g.v2t(np.array([[0.6, 0.1 * k, 0.2, 0.05 * k, -0.1, 0.07]]))[0]
        p = rng.uniform(-2, 2, (n, 3)) + [0, 0, 6]
        there = (p - x[:3, 3]) @ x[:3, :3]
        if model == "essential":
            a, b = unit(p), unit(there)
        elif model == "rotation":
            a, b = unit(p), unit(p) @ x[:3, :3]
        else:
            a, b = p, there
        bad = rng.random(n) < wrong
        b = np.where(bad[:, None], unit(rng.normal(size=(n, 3))) * np.linalg.norm(b, axis=1, keepdims=True), b)
        rows += [(f"pair{k}", i, a[i].tolist(), b[i].tolist()) for i in range(n)]
        truth[f"pair{k}"] = x, int((~bad).sum()), n
    return rows, truth


@pytest.mark.parametrize("model", sorted(two_view.MODELS))
def test_planted_motions_are_found(spark, model, monkeypatch):
    monkeypatch.setattr(two_view, "RUN", 70)  # the largest pair is cut into many runs
    rows, truth = planted(model, np.random.default_rng(3), [900, 60, 90])
    rows += [("few", 1, [1.0, 0.0, 0.0], [1.0, 0.0, 0.0]), ("few", 2, None, [1.0, 0.0, 0.0]), (None, 3, [1.0, 0.0, 0.0], [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, ROWS)
    results = []
    for parts in (3, 7):
        got = {r.pair: r for r in two_view.ransac(df.repartition(parts), model, threshold=1e-3).collect()}
        assert set(got) == {*truth, "few"} and got["few"].model is None and (got["few"].n_points, got["few"].n_inliers) == (1, 0)
        for k, (x, inliers, n) in truth.items():
            m = np.array(got[k].model)
            assert got[k].n_points == n and inliers <= got[k].n_inliers <= inliers + 0.02 * n + 2
            if model == "essential":
                m = m.reshape(4, 4)
                assert np.allclose(m[:3, :3], x[:3, :3], atol=2e-3) and np.allclose(m[:3, 3], x[:3, 3] / np.linalg.norm(x[:3, 3]), atol=2e-2)
            elif model == "rotation":
                assert np.allclose(m.reshape(3, 3), x[:3, :3], atol=1e-3)
            else:
                assert np.allclose(m.reshape(3, 4), x[:3], atol=1e-3)
        results.append({k: (r.n_inliers, None if r.model is None else np.round(r.model, 6).tolist()) for k, r in got.items()})
    assert results[0] == results[1]


def test_no_rows(spark):
    assert two_view.ransac(spark.createDataFrame([], ROWS)).collect() == []
