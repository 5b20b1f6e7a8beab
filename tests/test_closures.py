"""Closures between local maps: votes against a plain count, planted false ones, motions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanweave.functions import poses
from scanweave.operators import closures
from scanweave.operators.tracks import compose

POSE = ", ".join(f"{f} double" for f in poses.FIELDS)


def random_poses(rng, n, size=5.0, turn=0.4):
    q = np.hstack([rng.normal(size=(n, 3)) * turn, np.ones((n, 1))])
    return np.hstack([rng.normal(size=(n, 3)) * size, q / np.linalg.norm(q, axis=1, keepdims=True)])


def case(rng, n=40, false=8):
    """Poses of two maps, of which the second is off by a drift; closures between them; one map has closures of its own."""
    truth = random_poses(rng, 2 * n)
    drift = random_poses(rng, 1, 2.0, 0.3)
    seen = truth.copy()
    seen[n:] = compose(np.broadcast_to(drift, (n, 7)), truth[n:])
    step = lambda a, b: compose(closures.inverse(truth[[a]]), truth[[b]])[0]
    rows, wrong = [], set(range(false))
    for k in range(n):
        a, b = k, n + int(rng.integers(n))
        z = random_poses(rng, 1)[0] if k in wrong else step(a, b)
        if k % 2:  # the other way round
            a, b, z = b, a, closures.inverse(z[None])[0]
        rows.append((k, a, b, z))
    rows += [(100, 0, 5, step(0, 5)), (101, 1, 6, random_poses(rng, 1)[0])]
    return truth, seen, drift, rows, wrong


def frames(spark, seen, rows):
    pose = lambda df, c: df.withColumn(c, poses.struct(tuple(F.col("v")[i] for i in range(7)))).drop("v")
    v = pose(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(seen)], "id long, v array<double>"), "pose")
    c = pose(spark.createDataFrame([(k, int(a), int(b), list(map(float, z))) for k, a, b, z in rows], "closure_id long, a long, b long, v array<double>"), "step")
    return v, c


@pytest.mark.parametrize("block", [256, 7])
def test_false_closures_are_outvoted(spark, block, monkeypatch):
    monkeypatch.setattr(closures, "BLOCK", block)
    rng = np.random.default_rng(1)
    truth, seen, drift, rows, wrong = case(rng)
    v, c = frames(spark, seen, rows)
    parts = spark.range(80).select(F.col("id").alias("variable_id"), F.when(F.col("id") < 40, 0).otherwise(40).alias("part"))
    statuses, motions = closures.validate(v, c, parts)
    got = {r.closure_id: r for r in statuses.collect()}
    between = [k for k in range(40)]
    assert {k for k in between if got[k].status == "accepted"} == set(between) - wrong
    assert {k for k in between if got[k].status == "rejected"} == wrong
    assert got[100].status == "accepted" and got[101].status == "rejected" and got[100].n_checks == 1
    # a closure fits under the motions of all true ones, or of itself alone
    assert all((got[k].n_checks, got[k].n_good) == (40, 1 if k in wrong else 32) for k in between)
    (m,) = motions.collect()
    found = np.array([[m.motion[f] for f in poses.FIELDS]])
    assert np.abs(closures.residual(compose(found, drift))).max() < 1e-6 and m.chi < 1e-10 and m.n == 32


def test_noisy_closures_are_fitted_together(spark):
    rng = np.random.default_rng(2)
    truth, seen, drift, rows, _ = case(rng, false=0)
    rows = [(k, a, b, compose(z[None], np.array([[*rng.normal(size=3) * 0.02, *rng.normal(size=3) * 0.005, 1.0]]))[0]) for k, a, b, z in rows[:40]]
    v, c = frames(spark, seen, rows)
    parts = spark.range(80).select(F.col("id").alias("variable_id"), (F.col("id") >= 40).cast("int").alias("part"))
    _, motions = closures.validate(v, c, parts, inlier_chi=5.0)
    (m,) = motions.collect()
    found = np.array([[m.motion[f] for f in poses.FIELDS]])
    off = np.abs(closures.residual(compose(found, drift))).max()
    one = [r for r in closures.clustered(v, c, parts).where("closure_id < 6").collect()]
    alone = max(np.abs(closures.residual(compose(np.array([[r.motion[f] for f in poses.FIELDS]]), drift))).max() for r in one)
    assert off < 0.06 and off < alone and 0 < m.chi < 1.0


def test_closures_without_parts_stay_open(spark):
    truth, seen, drift, rows, _ = case(np.random.default_rng(3), n=4, false=0)
    v, c = frames(spark, seen, rows[:4])
    parts = spark.createDataFrame([(0, 0), (1, 0)], "variable_id long, part int")
    statuses, motions = closures.validate(v, c, parts)
    assert [(r.status, r.n_checks) for r in statuses.collect()] == [("open", 0)] * 4 and motions.collect() == []
    whole = spark.range(8).select(F.col("id").alias("variable_id"), (F.col("id") >= 4).cast("int").alias("part"))
    assert {r.status for r in closures.validate(v, c, whole)[0].collect()} == {"open"}  # four checks are too few
