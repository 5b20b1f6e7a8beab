"""Running poses and initial estimates against walks, one after the other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanweave.functions import poses
from scanweave.operators import spread, tracks
from scanweave.sources.tables import keep

POSE = poses.STRUCT


def steps(n, seed=1, size=1.0):
    rng = np.random.default_rng(seed)
    q = rng.normal(size=(n, 4)) * [0.1, 0.1, 0.1, 0] + [0, 0, 0, 1]
    return np.hstack([rng.normal(size=(n, 3)) * size, q / np.linalg.norm(q, axis=1, keepdims=True)])


def walk(s):
    out = [s[:1]]
    for i in range(1, len(s)):
        out.append(tracks.compose(out[-1], s[i : i + 1]))
    return np.vstack(out)


def apart(a, b):
    sign = np.sign((a[:, 3:] * b[:, 3:]).sum(axis=1, keepdims=True))
    return np.abs(np.hstack([a[:, :3], a[:, 3:]]) - np.hstack([b[:, :3], sign * b[:, 3:]])).max()


def inverse(p):
    q = p[:, 3:] * [-1, -1, -1, 1]
    zero = np.zeros((len(p), 3))
    return np.hstack([-tracks.compose(np.hstack([zero, q]), np.hstack([p[:, :3], np.tile([0, 0, 0, 1.0], (len(p), 1))]))[:, :3], q])


def column(rows, name):
    return np.array([[r[name][f] for f in poses.FIELDS] for r in rows])


def test_runs_are_multiplied_over_partitions(spark):
    data = {"a": steps(3000, 1), "b": steps(1, 2), None: steps(700, 3)}
    rows = [(k, i, [float(x) for x in s]) for k, v in data.items() for i, s in enumerate(v)]
    df = spark.createDataFrame(rows, "run string, i int, v array<double>").select("run", "i", poses.struct(tuple(F.col("v")[j] for j in range(7))).alias("step"))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", 13)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
        got = keep(tracks.running_poses(df.repartition(5), ["i"], ["run"]), "t")
        for k, v in data.items():
            own = got.where(F.col("run").eqNullSafe(F.lit(k))).orderBy("i").collect()
            assert [r.i for r in own] == list(range(len(v))) and apart(column(own, "pose"), walk(v)) < 1e-9
        alone = tracks.running_poses(df.where("run = 'a'").drop("run"), ["i"]).orderBy("i").collect()
        assert apart(column(alone, "pose"), walk(data["a"])) < 1e-9
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before[1])
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tracks.running_poses(df.where("false"), ["i"], ["run"]).collect() == []


def test_a_million_steps_in_many_tasks(spark):
    half = F.lit(0.5)
    df = spark.range(1_000_000, numPartitions=4).select("id", poses.struct((F.lit(1.0), F.lit(0.0), F.lit(0.0), *poses.yaw(F.lit(2 * np.pi / 1000)))).alias("step"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = keep(tracks.running_poses(df, ["id"]), "t")
        # a circle of a thousand steps is back where it began
        far = got.where("(id + 1) % 1000 = 0").agg(F.max(F.abs("pose.tx")), F.max(F.abs("pose.ty")), F.count("*")).first()
        assert far[0] < 1e-5 and far[1] < 1e-5 and far[2] == 1000
        radius = got.agg(F.max(F.abs(F.hypot(F.col("pose.tx") - half, F.col("pose.ty") - float(0.5 / np.tan(np.pi / 1000))))) .alias("r")).first()[0]
        assert abs(radius - 0.5 / np.sin(np.pi / 1000)) < 1e-4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_track_is_a_pose_graph_and_back(spark):
    s = steps(200, 4)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(s)], "i long, v array<double>").select("i", poses.struct(tuple(F.col("v")[j] for j in range(7))).alias("step"))
    track = tracks.running_poses(df, ["i"])
    variables, factors = tracks.pose_graph(track, ["i"], F.floor(F.col("i") / 30), "i")
    assert variables.where("fixed").count() == 1 and factors.count() == 199
    own = factors.select(F.col("variables")[1].alias("i"), "step").orderBy("i").collect()
    assert apart(column(own, "step"), s[1:]) < 1e-9


def frame(spark, p, ids=None):
    rows = [(int(ids[i]) if ids is not None else i, [float(x) for x in v]) for i, v in enumerate(p)]
    return spark.createDataFrame(rows, "id long, v array<double>").select("id", poses.struct(tuple(F.col("v")[j] for j in range(7))).alias("pose"))


@pytest.mark.parametrize("shuffled", [False, True])
def test_a_long_chain_takes_few_rounds(spark, shuffled):
    n = 30_000
    truth = np.zeros((n, 7))
    a = np.arange(n) * 0.01
    truth[:, 0], truth[:, 1], truth[:, 5], truth[:, 6] = 100 * np.sin(a), np.arange(n) * 0.1, np.sin(a / 2), np.cos(a / 2)
    ids = np.random.default_rng(5).permutation(n) if shuffled else np.arange(n)
    step = tracks.compose(inverse(truth[:-1]), truth[1:])
    rows = [(i, int(ids[i]), int(ids[i + 1]), [float(x) for x in step[i]]) for i in range(n - 1)]
    df = spark.createDataFrame(rows, "id long, a long, b long, v array<double>").select("id", "a", "b", poses.struct(tuple(F.col("v")[j] for j in range(7))).alias("step"))
    rounds = []
    got = spread.spread_poses(frame(spark, truth[:1], ids[:1]), df.repartition(4), rounds).collect()
    found = {r.id: [r.pose[f] for f in poses.FIELDS] for r in got}
    assert len(found) == n and apart(np.array([found[int(i)] for i in ids]), truth) < 1e-6
    assert len(rounds) < (20 if not shuffled else 40), rounds


def test_rounds_take_blocks_of_a_chain_and_not_its_poses(spark, monkeypatch):
    """A round that doubles ways writes every component; of a chain only what crosses blocks may come that far."""
    written, plain = [], spread.keep
    monkeypatch.setattr(spread, "keep", lambda df, name: written.append((name, kept := plain(df, name))) or kept)
    n = 20_000
    steps = spark.range(1, n).select("id", (F.col("id") - 1).alias("a"), F.col("id").alias("b"), poses.struct((F.lit(1.0), F.lit(0.0), F.lit(0.0), *poses.yaw(F.lit(2 * np.pi / 1000)))).alias("step"))
    got = spread.spread_poses(frame(spark, np.array([[0, 0, 0, 0, 0, 0, 1.0]])), steps)
    far = got.where("id % 1000 = 0").agg(F.max(F.hypot("pose.tx", "pose.ty")), F.count("*")).first()
    assert got.count() == n and far[0] < 1e-6 and far[1] == n // 1000
    assert sum(t.count() for name, t in written if name != "spread-members") < 200 and sum(name == "spread-members" for name, _ in written) == 1


def test_poses_of_a_graph_with_loops_and_islands(spark):
    rng = np.random.default_rng(6)
    truth = walk(steps(60, 7))
    pairs = [(i, int(rng.integers(0, i))) for i in range(1, 50)] + [tuple(map(int, rng.integers(0, 50, 2))) for _ in range(60)] + [(i, i + 1) for i in range(50, 59)]
    rows = []
    for k, (a, b) in enumerate(pairs):
        s = tracks.compose(inverse(truth[a : a + 1]), truth[b : b + 1])[0]
        rows.append((k, a, b, [float(x) for x in s]))
    df = spark.createDataFrame(rows, "id long, a long, b long, v array<double>").select("id", "a", "b", poses.struct(tuple(F.col("v")[j] for j in range(7))).alias("step"))
    known = frame(spark, truth[[3, 20]], [3, 20])
    got = {r.id: [r.pose[f] for f in poses.FIELDS] for r in spread.spread_poses(known, df).collect()}
    assert set(got) == set(range(50)) and apart(np.array([got[i] for i in range(50)]), truth[:50]) < 1e-9
    assert {r.id for r in spread.spread_poses(known, df.where("false")).collect()} == {3, 20}
    assert spread.spread_poses(known.where("false"), df).collect() == []


def point_case(kind, rng, truth, point):
    """Measurements of a point from poses."""
    out = []
    for i, p in enumerate(truth):
        local = tracks.compose(inverse(p[None]), np.array([[*point, 0, 0, 0, 1.0]]))[0, :3]
        offset = np.array([[0.1, -0.2, 0.3, 0, 0, np.sin(0.2), np.cos(0.2)]])
        seen = tracks.compose(inverse(offset), np.array([[*local, 0, 0, 0, 1.0]]))[0, :3]
        k = (500.0, 480.0, 320.0, 240.0)
        if kind == "pose_point":
            m, own = local, []
        elif kind == "pose_point_2d":
            m, own = local[:2], []
        elif kind == "pose_point_offset":
            m, own = seen, [999]
        elif kind == "pose_bearing_2d":
            m, own = [np.arctan2(local[1], local[0])], []
        elif kind == "pose_omni":
            m, own = seen / np.linalg.norm(seen), [999]
        elif kind == "pose_pinhole":
            m, own = [k[0] * seen[0] / seen[2] + k[2], k[1] * seen[1] / seen[2] + k[3], *k], [999]
        else:
            bf = 60.0
            m, own = [k[0] * seen[0] / seen[2] + k[2], k[1] * seen[1] / seen[2] + k[3], bf / seen[2], *k, bf], [999]
        out.append((1000 + i, kind, [i, 500, *own], [float(x) for x in m]))
    return out, offset


@pytest.mark.parametrize("kind", sorted(spread.RULES))
def test_points_start_when_enough_factors_have_met(spark, kind):
    rng = np.random.default_rng(8)
    planar = kind.endswith("2d")
    truth = np.zeros((6, 7))
    truth[:, :3] = rng.normal(size=(6, 3)) * 3
    if planar:
        truth[:, 2] = 0
    angle = rng.normal(size=6) * 0.3
    truth[:, 5], truth[:, 6] = np.sin(angle / 2), np.cos(angle / 2)
    point = np.array([4.0, 5.0, 0.0 if planar else 7.0])
    rows, offset = point_case(kind, rng, truth, point)
    if kind == "pose_omni":  # wide angles
        point = truth[:, :3].mean(axis=0)
        rows, offset = point_case(kind, rng, truth, point)
    variables = [(i, [float(x) for x in p], True) for i, p in enumerate(truth)] + [(999, [float(x) for x in offset[0]], True), (500, None, False), (501, None, False)]
    least = {"pose_bearing_2d": 2, "pose_omni": 3, "pose_pinhole": 3}.get(kind, 1)
    few = [(2000 + r[0], r[1], [r[2][0], 501, *r[2][2:]], r[3]) for r in rows[: least - 1]]
    v = spark.createDataFrame(variables, "id long, v array<double>, fixed boolean").select("id", "fixed", F.when(F.col("v").isNotNull(), poses.struct(tuple(F.col("v")[j] for j in range(7)))).alias("estimate"))
    f = spark.createDataFrame(rows + few, "id long, kind string, variables array<long>, measurement array<double>")
    got = {r.id: r for r in spread.initialise(v, f).collect()}
    assert got[500].initialised and np.abs(np.array(got[500].estimate[:3]) - point).max() < 1e-6
    assert not got[501].initialised and got[501].estimate is None
    assert sum(r.initialised for r in got.values()) == 8


def test_poses_start_from_points_and_go_on(spark):
    rng = np.random.default_rng(9)
    truth, points = walk(steps(4, 10)), rng.normal(size=(9, 3)) * 4
    local = lambda i, j: [float(x) for x in tracks.compose(inverse(truth[i : i + 1]), np.array([[*points[j], 0, 0, 0, 1.0]]))[0, :3]]
    step = lambda a, b: [float(x) for x in tracks.compose(inverse(truth[a : a + 1]), truth[b : b + 1])[0]]
    rows = [(j, "pose_point", [0, 100 + j], local(0, j)) for j in range(6)]  # pose 0 starts points
    rows += [(20 + j, "pose_point", [1, 100 + j], local(1, j)) for j in range(5)]  # which start pose 1
    rows += [(30, "pose_pose", [2, 1], step(2, 1)), (31, "pose_point", [2, 107], local(2, 7))]  # which starts pose 2, and that a point
    rows += [(40 + j, "pose_point", [3, 100 + j], local(3, j)) for j in range(3)]  # three points are too few
    v = spark.createDataFrame([(0, [float(x) for x in truth[0]], True)] + [(i, None, False) for i in [1, 2, 3, *range(100, 109)]], "id long, v array<double>, fixed boolean").select("id", "fixed", F.when(F.col("v").isNotNull(), poses.struct(tuple(F.col("v")[j] for j in range(7)))).alias("estimate"))
    f = spark.createDataFrame(rows, "id long, kind string, variables array<long>, measurement array<double>")
    got = {r.id: r for r in spread.initialise(v, f).collect()}
    assert apart(np.array([list(got[i].estimate) for i in (1, 2)]), truth[1:3]) < 1e-6
    assert np.abs(np.array(got[107].estimate[:3]) - points[7]).max() < 1e-6
    assert {i for i, r in got.items() if r.initialised} == {0, 1, 2, *range(100, 106), 107}
