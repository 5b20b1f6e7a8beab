"""Two-view geometry on directions: essential matrices, poses, triangulation, and RANSAC spread over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from scanweave.functions import geometry as g


def essential(pose: np.ndarray) -> np.ndarray:
    """E with a' E b = 0 for directions a in the first and b in the second camera, whose pose in the first is given."""
    return g.skew(pose[..., :3, 3]) @ pose[..., :3, :3]


def eight_point(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The essential matrix of at least eight pairs of directions, with two equal singular values and a zero."""
    rows = (a[:, :, None] * b[:, None, :]).reshape(-1, 9)
    e = np.linalg.svd(rows)[2][-1].reshape(3, 3)
    u, _, vt = np.linalg.svd(e)
    return u @ np.diag([1.0, 1.0, 0.0]) @ vt


def errors(e: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sine of each direction's angle to the other's epipolar plane, the larger of both."""
    v = np.abs(np.einsum("ki,ij,kj->k", a, e, b))
    planes = np.linalg.norm(b @ e.T, axis=1), np.linalg.norm(a @ e, axis=1)
    return v / np.maximum(np.minimum(*planes), 1e-12)


def triangulate(pose: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points nearest to both rays, in the first camera, and both depths."""
    d = b @ pose[:3, :3].T
    t = pose[:3, 3]
    aa, dd, ad = (a * a).sum(1), (d * d).sum(1), (a * d).sum(1)
    det = np.where(np.abs(aa * dd - ad * ad) < 1e-12, np.nan, aa * dd - ad * ad)
    at, dt = a @ t, d @ t
    s, u = (dd * at - ad * dt) / det, (ad * at - aa * dt) / det
    return ((s[:, None] * a) + (t + u[:, None] * d)) / 2, np.stack([s, u], axis=1)


def poses(e: np.ndarray) -> np.ndarray:
    """The four poses of an essential matrix, with translations of length 1."""
    u, _, vt = np.linalg.svd(e)
    u, vt = u * np.linalg.det(u), vt * np.linalg.det(vt)
    w = np.array([[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])
    out = np.tile(np.eye(4), (4, 1, 1))
    for k, (r, t) in enumerate((r, s * u[:, 2]) for r in (u @ w @ vt, u @ w.T @ vt) for s in (1, -1)):
        out[k, :3, :3], out[k, :3, 3] = r, t
    return out


def best_pose(e: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The one of the four poses that puts most points before both cameras."""
    found = poses(e)
    return found[int(np.argmax([(triangulate(x, a, b)[1] > 0).all(axis=1).sum() for x in found]))]


def rotation_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rotation with a = R b, of at least two pairs of directions."""
    u, _, vt = np.linalg.svd(a.T @ b)
    return u @ np.diag([1.0, 1.0, np.linalg.det(u @ vt)]) @ vt


def ransac(spark: SparkSession, a: np.ndarray, b: np.ndarray, model: str = "essential", rounds: int = 500, threshold: float = 0.01, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(model, inliers). Rounds are rows of spark.range, each seeded by its number; only the best of each task comes back.

    model: essential (eight pairs a round, a pose comes back) or rotation (two pairs).
    """
    held = spark.sparkContext.broadcast((a, b))
    size = 8 if model == "essential" else 2

    def score(m: np.ndarray) -> np.ndarray:
        x, y = held.value
        return errors(m, x, y) < threshold if model == "essential" else np.linalg.norm(x - y @ m.T, axis=1) < threshold

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y = held.value
        best = (-1, 0, np.zeros(9))
        for f in frames:
            for k in f["id"]:
                at = np.random.default_rng([seed, int(k)]).choice(len(x), size, replace=False)
                m = eight_point(x[at], y[at]) if model == "essential" else rotation_of(x[at], y[at])
                best = max(best, (int(score(m).sum()), -int(k), m.ravel()), key=lambda v: v[:2])
        yield pd.DataFrame([(best[0], best[1], best[2].tolist())], columns=["n", "k", "m"])

    rows = spark.range(rounds).mapInPandas(run, "n long, k long, m array<double>").collect()  # one row a task
    m = np.array(max(rows, key=lambda r: (r["n"], r["k"]))["m"]).reshape(3, 3)
    inliers = score(m)
    if inliers.sum() >= size:
        m = eight_point(a[inliers], b[inliers]) if model == "essential" else rotation_of(a[inliers], b[inliers])
        inliers = score(m)
    return (best_pose(m, a[inliers], b[inliers]) if model == "essential" else m), inliers
