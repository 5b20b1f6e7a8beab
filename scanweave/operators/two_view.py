"""Robust motions between many pairs of views at once, where the correspondences lie.

Correspondences are a table keyed by pair. For each pair POOL of them, chosen by hash, give `rounds` minimal samples and as many
hypotheses, in one task for each pair. Hypotheses are then joined to all correspondences, packed in runs of about RUN, and
tasks count how many of a run fit each; sums of counts choose the best. It is fitted again to all that fit, from sums of products
by pair. So a pair of any size is spread over tasks, no points are broadcast and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanweave.functions import epipolar
from scanweave.sources.tables import keep

#: Correspondences of a pair that samples are drawn from, and those of one run.
POOL, RUN = 64, 1000
#: Numbers of a model, correspondences of a minimal sample, and sums for its fit to many.
MODELS = {"essential": (9, 8, 81), "rotation": (9, 2, 9), "rigid": (12, 3, 16)}


def _fit(model: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if model == "essential":
        return epipolar.eight_point(a, b).ravel()
    if model == "rotation":
        return epipolar.rotation_of(a, b).ravel()
    ma, mb = a.mean(axis=0), b.mean(axis=0)
    r = epipolar.rotation_of(a - ma, b - mb)
    return np.hstack([r, (ma - r @ mb)[:, None]]).ravel()


def _errors(model: str, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if model == "essential":
        return epipolar.errors(m.reshape(3, 3), a, b)
    m = m.reshape(3, -1)
    return np.linalg.norm(a - b @ m[:, :3].T - (m[:, 3] if m.shape[1] == 4 else 0), axis=1)


def _products(model: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What `_refit` needs of correspondences that fit, added up."""
    if model == "essential":
        rows = (a[:, :, None] * b[:, None, :]).reshape(-1, 9)
        return (rows.T @ rows).ravel()
    if model == "rotation":
        return (a.T @ b).ravel()
    one = np.ones((len(a), 1))
    return (np.hstack([a, one]).T @ np.hstack([b, one])).ravel()


def _refit(model: str, s: np.ndarray) -> np.ndarray:
    if model == "essential":
        u, _, vt = np.linalg.svd(np.linalg.eigh(s.reshape(9, 9))[1][:, 0].reshape(3, 3))
        return (u @ np.diag([1.0, 1.0, 0.0]) @ vt).ravel()

    def turn(c: np.ndarray) -> np.ndarray:
        u, _, vt = np.linalg.svd(c)
        return u @ np.diag([1.0, 1.0, np.linalg.det(u @ vt)]) @ vt

    if model == "rotation":
        return turn(s.reshape(3, 3)).ravel()
    s = s.reshape(4, 4)
    n, sa, sb = s[3, 3], s[:3, 3], s[3, :3]
    r = turn(s[:3, :3] - np.outer(sa, sb) / n)
    return np.hstack([r, ((sa - r @ sb) / n)[:, None]]).ravel()


def _split(points: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([p["a"] for p in points], float).reshape(-1, 3), np.array([p["b"] for p in points], float).reshape(-1, 3)


def _added(c: str, n: int):
    return F.array(*[F.sum(F.col(c)[i]) for i in range(n)]).alias(c)


def ransac(rows: DataFrame, model: str = "essential", rounds: int = 200, threshold: float = 0.01, seed: int = 1) -> DataFrame:
    """(pair, model, n_points, n_inliers) of rows (pair, point, a, b). essential: a and b are directions in the first and second view,
    and the model is the second's pose in the first, 16 numbers by rows, translation of length 1. rotation: directions, a = R b,
    9 numbers. rigid: points, a = R b + t, 12 numbers.

    Rows with nulls are left out. Among hypotheses that fit equally many the first counts. Pairs with fewer rows than a minimal
    sample have a null model. The same rows give the same result in any partitioning.
    """
    numbers, least, products = MODELS[model]
    kind = dict(rows.dtypes)["pair"]
    rows = rows.where("pair is not null and point is not null and a is not null and b is not null").select("pair", "point", "a", "b")
    order = Window.partitionBy("pair").orderBy(F.xxhash64("pair", "point", F.lit(seed)), "point")
    pool = rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= POOL)  # the limit holds before the shuffle too
    pool = pool.groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("_k", "a", "b"))).alias("points"), F.xxhash64(F.lit(seed), "pair").alias("seed"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for points, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                a, b = _split(points)
                rng = np.random.default_rng(own & ((1 << 63) - 1))
                found = [_fit(model, a[at], b[at]) for at in (rng.choice(len(a), least, replace=False) for _ in range(rounds))] if len(a) >= least else []
                out.append([m.tolist() for m in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.list_(pa.float64())))], names=["pair", "models"])

    tried = keep(pool.mapInArrow(draw, f"pair {kind}, models array<array<double>>"), "views-tried")
    sizes = rows.groupBy("pair").agg(F.count("*").alias("n_points"))
    runs = rows.join(sizes, "pair").withColumn("run", F.pmod(F.xxhash64("point"), F.ceil(F.col("n_points") / RUN)))
    runs = keep(runs.groupBy("pair", "run").agg(F.collect_list(F.struct("a", "b")).alias("points")), "views-runs")

    def over(models: DataFrame, value: str, f, output: str) -> DataFrame:
        """f(points a, points b, value) as a row of each run."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [f(*_split(points), held) for points, held in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["pair", output])

        return runs.select("pair", "points").join(models.select("pair", value), "pair").mapInArrow(run, f"pair {kind}, {output} array<double>")

    counts = over(tried.where("size(models) > 0"), "models", lambda a, b, ms: [float((_errors(model, np.array(m), a, b) < threshold).sum()) for m in ms], "counts")
    counts = counts.groupBy("pair").agg(_added("counts", rounds))
    best = tried.join(counts, "pair").select("pair", F.element_at("models", F.array_position("counts", F.array_max("counts")).cast("int")).alias("model"))
    best = keep(best, "views-best")

    def gather(a: np.ndarray, b: np.ndarray, m: list) -> list[float]:
        fit = _errors(model, np.array(m), a, b) < threshold
        return [float(fit.sum()), *_products(model, a[fit], b[fit]).tolist()]

    sums = over(best, "model", gather, "sums").groupBy("pair").agg(_added("sums", 1 + products))

    def refit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_refit(model, np.array(s[1:])).tolist() if s[0] >= least else m for m, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["pair", "model"])

    best = keep(best.join(sums, "pair").select("pair", "model", "sums").mapInArrow(refit, f"pair {kind}, model array<double>"), "views-fitted")

    def judge(a: np.ndarray, b: np.ndarray, m: list) -> list[float]:
        """How many fit; of an essential matrix also how many points each of its four poses puts before both views."""
        fit = _errors(model, np.array(m), a, b) < threshold
        before = [float((epipolar.triangulate(x, a[fit], b[fit])[1] > 0).all(axis=1).sum()) for x in epipolar.poses(np.array(m).reshape(3, 3))] if model == "essential" else []
        return [float(fit.sum()), *before]

    judged = over(best, "model", judge, "found").groupBy("pair").agg(_added("found", 5 if model == "essential" else 1))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [epipolar.poses(np.array(m).reshape(3, 3))[int(np.argmax(f[1:]))].ravel().tolist() for m, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64())), batch.column(3)], names=["pair", "model", "n_inliers"])

    out = best.join(judged, "pair").select("pair", "model", "found", F.col("found")[0].cast("long").alias("n_inliers"))
    out = out.mapInArrow(choose, f"pair {kind}, model array<double>, n_inliers long") if model == "essential" else out.drop("found")
    return sizes.join(out, "pair", "left").select("pair", "model", "n_points", F.coalesce("n_inliers", F.lit(0).cast("long")).alias("n_inliers"))
