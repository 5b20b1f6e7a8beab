"""Poses as columns, trajectory errors, transforms and normals, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanweave.functions import geometry as g, poses
from scanweave.operators import associate, evaluate, grids, messages, normals
from scanweave.sources import formats

KIND = f"id int, a {poses.STRUCT}, b {poses.STRUCT}, u double"


def random_poses(rng, n):
    q = rng.normal(size=(n, 4))
    return rng.normal(size=(n, 3)), q / np.linalg.norm(q, axis=1, keepdims=True)


def named(t, q):
    return dict(zip(poses.FIELDS, map(float, (*t, *q)), strict=True))


def matrix(r):
    v = np.array([r[c] for c in poses.FIELDS])
    return g.pose(v[:3], v[3:])


def test_pose_columns_equal_the_matrices(spark):
    rng = np.random.default_rng(1)
    (ta, qa), (tb, qb), u = random_poses(rng, 30), random_poses(rng, 30), rng.uniform(0, 1, 30)
    qb[0] = qa[0]
    qb[1] = -qa[1]
    rows = [(i, named(ta[i], qa[i]), named(tb[i], qb[i]), float(u[i])) for i in range(30)]
    a, b = poses.of(F.col("a")), poses.of(F.col("b"))
    df = spark.createDataFrame(rows, KIND).select("id", poses.struct(poses.compose(a, b)).alias("c"), poses.struct(poses.inverse(a)).alias("i"), poses.struct(poses.between(a, b)).alias("d"), poses.struct(poses.interpolate(a, b, F.col("u"))).alias("m"), poses.angle(a[3:]).alias("angle"), F.array(*poses.euler(a[3:])).alias("euler"))
    ma, mb = g.pose(ta, qa), g.pose(tb, qb)
    for r in df.collect():
        i = r.id
        assert np.allclose(matrix(r.c), ma[i] @ mb[i]) and np.allclose(matrix(r.i), g.inverse(ma[i : i + 1])[0])
        assert np.allclose(matrix(r.d), g.inverse(ma[i : i + 1])[0] @ mb[i])
        assert np.allclose(matrix(r.m), g.interpolate(ma[i : i + 1], mb[i : i + 1], u[i : i + 1])[0], atol=1e-7)
        assert np.isclose(r.angle, np.linalg.norm(g.log_so3(ma[i : i + 1, :3, :3])[0]))
        x, y, z = (g.rotations(k, np.array([v]))[0] for k, v in zip("xyz", r.euler, strict=True))
        assert np.allclose(z @ y @ x, ma[i, :3, :3])


def test_alignment_undoes_a_rigid_motion(spark):
    rng = np.random.default_rng(2)
    rows, moves = [], {}
    for run in range(3):
        (t,), (q,) = random_poses(rng, 1)
        x, noise = g.pose(t, q), 0.01 * run
        moves[run] = x
        for p in rng.normal(size=(40, 3)):
            e = x[:3, :3].T @ (p - x[:3, 3])
            rows.append((run, *map(float, p), *map(float, e + noise * rng.normal(size=3))))
    df = spark.createDataFrame(rows, "run int, tx double, ty double, tz double, ex double, ey double, ez double")
    for r in evaluate.alignment(df).collect():
        assert np.allclose(matrix(r.align), moves[r.run], atol=1e-9 if r.run == 0 else 0.03)
    got = {r.run: r for r in evaluate.absolute_errors(df).collect()}
    assert got[0].rmse < 1e-9 and 0.005 < got[1].rmse < 0.03 and all(r.n == 40 and r.mean <= r.rmse <= r.largest for r in got.values())


def test_perfect_estimates_have_no_errors(spark):
    rng = np.random.default_rng(3)
    t, q = random_poses(rng, 60)
    rows = [("r", i, float(i), named(t[i], q[i]), named(t[i], q[i])) for i in range(60)]
    path = spark.createDataFrame(rows, f"run string, frame long, distance double, truth {poses.STRUCT}, estimate {poses.STRUCT}")
    found = evaluate.segment_errors(path, [10.0, 100.0], every=10).collect()
    assert [(r.first, r.last) for r in sorted(found, key=lambda r: r.first)] == [(i, i + 11) for i in range(0, 49, 10)]
    assert all(r.rotation_error < 1e-6 and r.translation_error < 1e-9 for r in found)
    steps = evaluate.relative_errors(path, "frame").collect()
    assert len(steps) == 59 and all(max(r.dx, r.dy, r.dz, r.droll, r.dpitch, r.dyaw) < 1e-6 for r in steps)


EVENT = "child string, t double, tx double, ty double, tz double, qx double, qy double, qz double, qw double"


def test_transforms_are_looked_up_and_chained(spark):
    rng = np.random.default_rng(4)
    frames, times = ["a", "b", "c"], np.arange(0.0, 10.0)
    held = {f: random_poses(rng, 10) for f in frames}
    events = spark.createDataFrame([(f, float(s) + 1, *map(float, t), *map(float, q)) for f in frames for s, t, q in zip(times, *held[f], strict=True)] + [("lone", 1.0, *[0.0] * 6, 1.0)], EVENT)

    def at(f, s):
        m = g.pose(*held[f])
        i = min(int(s - 1), 8)
        return g.interpolate(m[i : i + 1], m[i + 1 : i + 2], np.array([s - 1 - i]))[0]

    asked = [("a", 1.0), ("a", 3.25), ("b", 10.0), ("a", 0.5), ("a", 10.5), ("lone", 1.0), ("none", 1.0), ("c", 0.0)]
    df = spark.createDataFrame(asked, "child string, t double")
    for width in (2.5, 1000.0):
        got = {(r.child, r.t): r for r in formats.tf_lookup(df, events, bucket=width).collect()}
        assert {k: r.status for k, r in got.items()} == {("a", 1.0): "ok", ("a", 3.25): "ok", ("b", 10.0): "ok", ("a", 0.5): "before_first", ("a", 10.5): "after_last", ("lone", 1.0): "no_data", ("none", 1.0): "no_data", ("c", 0.0): "ok"}
        assert np.allclose(matrix(got["a", 3.25].pose), at("a", 3.25)) and np.allclose(matrix(got["c", 0.0].pose), at("c", 10.0))
        assert got["a", 0.5].pose is None
    q = [(1, "a", "c", 4.5), (2, "c", "a", 4.5), (3, "a", "base", 2.0), (4, "b", "b", 2.0), (5, "a", "z", 2.0), (6, "a", "c", 99.0)]
    chain = formats.tf_chain(spark.createDataFrame(q, "query_id int, target string, reference string, t double"), events, {"a": "b", "b": "base", "c": "base"}, bucket=2.5)
    got = {r.query_id: r for r in chain.collect()}
    want = g.inverse(at("c", 4.5)[None])[0] @ at("b", 4.5) @ at("a", 4.5)
    assert np.allclose(matrix(got[1].pose), want) and np.allclose(matrix(got[2].pose), g.inverse(want[None])[0])
    assert np.allclose(matrix(got[3].pose), at("b", 2.0) @ at("a", 2.0)) and np.allclose(matrix(got[4].pose), np.eye(4))
    assert [got[i].status for i in range(1, 7)] == ["ok", "ok", "ok", "ok", "no_path", "after_last"]


def test_kalman_times_equal_the_matrix_form(spark):
    rng = np.random.default_rng(5)
    t = 1000 + 0.1 * np.arange(300) + rng.normal(size=300) * 0.004
    t[180] += 5
    df = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(t)], "stream string, arrival long, t double")
    got = [r for r in messages.kalman_times(df).orderBy("arrival").collect()]
    a, c = np.array([[1.0, 1], [0, 1]]), np.array([[1.0, 0]])
    mu, sigma = np.array([t[99], np.diff(t[:100]).mean()]), np.eye(2)
    for i in range(100, 300):
        mu, sigma = np.array([mu[0] + mu[1], mu[1]]), a @ sigma @ a.T + 1e-4 * np.eye(2)
        gain = sigma @ c.T / (c @ sigma @ c.T + 1e-3)
        if abs(t[i] - mu[0]) <= 3 * mu[1]:
            mu, sigma = mu + gain[:, 0] * (t[i] - mu[0]), (np.eye(2) - gain @ c) @ sigma
        assert abs(got[i].t_filtered - mu[0]) < 1e-9
    assert [r.ready for r in got] == [i >= 100 for i in range(300)] and abs(got[180].t_filtered - 1018) < 0.1


def organised(spark, points):
    rows = [(0, r, c, *map(float, points[r, c])) for r in range(points.shape[0]) for c in range(points.shape[1])]
    return spark.createDataFrame(rows, "image int, row long, col long, x double, y double, z double")


def test_normals_of_a_plane(spark):
    t, p = np.meshgrid(np.linspace(-0.4, 0.4, 9), np.linspace(0.3, -0.3, 7))
    n = np.array([0.9, 0.3, -0.2])
    n /= np.linalg.norm(n)
    ray = np.stack([np.cos(p) * np.cos(t), np.cos(p) * np.sin(t), np.sin(p)], -1)
    points = ray * (3.0 / (ray @ n))[..., None]
    df = organised(spark, points)
    for r in normals.sliding(df, ["image"], 2).collect():
        assert np.allclose([r.nx, r.ny, r.nz], -n, atol=1e-6) and r.curvature < 1e-9 and 2 <= r.row <= 4 and 2 <= r.col <= 6
    assert normals.sliding(df, ["image"], 2).count() == 15
    assert all(np.dot([r.nx, r.ny, r.nz], points[r.row, r.col]) < 0 for r in normals.spherical(df, ["image"]).collect())


def test_line_normals_against_a_loop(spark):
    rng = np.random.default_rng(6)
    x = np.stack([np.linspace(1, 4, 40), 2 + 0.01 * rng.normal(size=40)], -1)
    x[20:, 1] += np.linspace(0, 3, 20)
    df = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(x)], "scan int, i int, x double, y double")
    got = {r.i: np.array([r.nx, r.ny]) for r in normals.line(df, ["scan"], "i").collect()}
    want = {}
    for i, p in enumerate(x):
        low = high = i
        while low > 0 and ((x[low - 1] - p) ** 2).sum() < 0.3:
            low -= 1
        while high < 40 and ((x[high] - p) ** 2).sum() < 0.3:
            high += 1
        if high - low >= 5:
            values, vectors = np.linalg.eigh(np.cov(x[low:high].T, bias=True))
            if values[0] <= 0.2 * values.sum():
                v = vectors[:, 0]
                want[i] = -v if v @ p > 0 else v
    assert got.keys() == want.keys() and len(want) > 30 and all(np.allclose(got[i], want[i], atol=1e-6) for i in want)


def test_rings(spark):
    df = spark.createDataFrame([(float(a),) for a in (-0.1, 0.0, 0.6, 1.0, 1.05, 0.26, 2.4, 7.2)], "a double")
    got = [tuple(r) for r in df.select(normals.ring(F.col("a"), 0.0, 1.0, 4), normals.uneven_ring(F.col("a"), [1.0, 0.5, 0.2, 0.0])).collect()]
    assert [x for x, _ in got] == [None, 0, 1, 3, None, 0, None, 3]
    assert [x for _, x in got] == [3, 3, 1, 0, 0, 2, None, None]


@pytest.mark.parametrize("tile", [4, 256])
def test_ways_over_tiles_and_astar(spark, tile):
    rng = np.random.default_rng(7)
    cost = rng.choice([1.0, 2.0, 9.0], (11, 13))
    rows = [(0, r, c, float(cost[r, c])) for r in range(11) for c in range(13) if (r, c) != (5, 5)]
    cells = spark.createDataFrame(rows, "image int, row long, col long, cost double")
    goal, start = cells.where("row = 10 and col = 12"), cells.where("row = 0 and col = 0")
    got = {(r.row, r.col): r for r in grids.cheapest(cells, start, tile).collect()}
    assert len(got) == len(rows) and got[0, 0].distance == 0
    for (r, c), v in got.items():
        near = [got[r + i, c + j].distance + d * cost[r, c] for i, j, d in grids._STEPS if (r + i, c + j) in got]
        assert (r, c) == (0, 0) or (abs(v.distance - min(near)) < 1e-9 and abs(got[v.parent_row, v.parent_col].distance + np.hypot(v.parent_row - r, v.parent_col - c) * cost[r, c] - v.distance) < 1e-9)
    way = grids.astar(cells, start, goal).orderBy("place").collect()
    assert abs(way[-1].distance - got[10, 12].distance) < 1e-9 and (way[0].row, way[0].col) == (0, 0)
    assert all(max(abs(a.row - b.row), abs(a.col - b.col)) == 1 for a, b in zip(way, way[1:], strict=False))
    assert grids.astar(cells, start, goal, expansions=3).count() == 0


def test_correspondences_skip_what_has_no_partner(spark):
    points = spark.createDataFrame([(i, float(i)) for i in range(4)], "point_id int, x double")
    pairs = spark.createDataFrame([(0, 1), (1, -1), (-1, 2), (2, 9), (3, 3)], "fixed_idx int, moving_idx int")
    got = sorted((r.fixed_idx, r.moving_idx, r.fixed.x, r.moving.x) for r in associate.correspond(pairs, points, points, "point_id").collect())
    assert got == [(0, 1, 0.0, 1.0), (3, 3, 3.0, 3.0)]


@pytest.mark.parametrize("tile", [3, 256])
def test_components_over_tiles(spark, tile):
    rng = np.random.default_rng(8)
    a = rng.random((14, 17)) < 0.42
    cells = spark.createDataFrame([(0, r, c) for r in range(14) for c in range(17) if a[r, c]], "image int, row long, col long")
    got = {(r.row, r.col): r.component for r in grids.components(cells, tile).collect()}
    want, todo = {}, sorted(zip(*map(lambda x: x.tolist(), np.nonzero(a)), strict=True))
    for start in todo:
        stack = [start]
        while stack:
            x = stack.pop()
            if x not in want:
                want[x] = (start[0] << 32) + start[1]
                stack += [(x[0] + i, x[1] + j) for i, j, _ in grids._STEPS if 0 <= x[0] + i < 14 and 0 <= x[1] + j < 17 and a[x[0] + i, x[1] + j]]
    assert got == want
