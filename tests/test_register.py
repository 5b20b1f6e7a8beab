"""Clouds registered from a wrong start."""

import numpy as np

from pyspark.sql import functions as F
from scanweave.functions import geometry as g
from scanweave.functions import poses
from scanweave.operators import register

POINTS = "pair long, point_id long, x double, y double, z double"


def test_clouds_meet_from_a_wrong_start(spark):
    rng = np.random.default_rng(1)
    fixed, moving, truth = [], [], {}
    for k in range(3):
        p = rng.uniform(-2, 2, (300, 3))
        x = g.v2t(np.array([[0.12, -0.1, 0.08, 0.01, -0.015, 0.02 + 0.01 * k]]))[0]
        q = (p[:220] - x[:3, 3]) @ x[:3, :3]
        extra = rng.uniform(10, 12, (20, 3))  # these meet nothing
        fixed += [(k, i, *map(float, v)) for i, v in enumerate(p)]
        moving += [(k, 1000 + i, *map(float, v)) for i, v in enumerate(np.vstack([q, extra]))]
        truth[k] = x
    fixed.append((7, 0, 0.0, 0.0, 0.0))
    moving.append((7, 0, 50.0, 0.0, 0.0))  # a pair of which nothing meets
    start = spark.createDataFrame([(k,) for k in (0, 1, 2, 7)], "pair long").withColumn("pose", poses.struct(tuple(F.lit(v) for v in (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0))))
    history = []
    got = {r.pair: r for r in register.register(spark.createDataFrame(fixed, POINTS), spark.createDataFrame(moving, POINTS), start, 0.6, history=history).collect()}
    for k, x in truth.items():
        m = np.array([got[k].pose[f] for f in poses.FIELDS])
        assert np.allclose(m[:3], x[:3, 3], atol=1e-6) and np.allclose(np.abs(m[3:]), np.abs(g.matrix_to_quaternion(x[:3, :3])), atol=1e-6)
        assert got[k].n == 220 and got[k].rms < 1e-6
    assert (got[7].n, got[7].rms, tuple(got[7].pose)) == (0, None, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0))
    assert history[0] > 0.01 and history[-1] <= 1e-9 and len(history) < 30
