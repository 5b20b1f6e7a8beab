import numpy as np
import pytest
from pyspark.sql import functions as F

from scanweave.functions import geometry as g
from scanweave.operators import adjust, associate, tree


def arc(n):
    steps = np.array([[3.0, 3.0, 2.0, 0.0, 0.0, 0.0]] + [[0.4, 0.5, 0.01, 0.005, 0.004, 0.02]] * (n - 1))
    out = [np.eye(4)]
    for s in g.v2t(steps):
        out.append(out[-1] @ s)
    return np.array(out[1:])


def test_geometry_round_trips():
    rng = np.random.default_rng(1)
    w = rng.normal(size=(200, 3))
    r = g.exp_so3(w)
    assert np.allclose(r @ np.swapaxes(r, 1, 2), np.eye(3)) and np.allclose(g.exp_so3(g.log_so3(r)), r)
    q = g.matrix_to_quaternion(r)
    assert np.allclose(g.quaternion_to_matrix(q), r)
    x = g.pose(rng.normal(size=(200, 3)), q)
    assert np.allclose(g.v2t(g.t2v(x)), x) and np.allclose(g.inverse(x) @ x, np.eye(4))
    a, b = x[:100], x[100:]
    assert np.allclose(g.interpolate(a, b, np.zeros(100)), a) and np.allclose(g.interpolate(a, b, np.ones(100)), b)
    u, v = (t / np.linalg.norm(t, axis=1, keepdims=True) for t in (rng.normal(size=(50, 3)), rng.normal(size=(50, 3))))
    assert np.allclose(np.einsum("kij,kj->ki", g.rotation_between(u, v), u), v)
    assert np.allclose(g.rotation_between(u, -u), np.eye(3))
    s = g.similarity(np.full(200, 1.7), x)
    assert np.allclose(g.similarity_inverse(s) @ s, np.eye(4))


def test_jacobian_against_differences():
    rng = np.random.default_rng(2)
    x = g.v2t(np.hstack([rng.normal(size=(50, 3)), rng.uniform(-0.4, 0.4, (50, 3))]))
    mean, normal = (rng.normal(size=(50, 3)) for _ in range(2))
    # the closed form is the derivative where the measurement is the prediction
    seen = np.einsum("kji,kj->ki", x[:, :3, :3], mean - x[:, :3, 3])
    _, jac = adjust.residuals(x[:, :3, :3], x[:, :3, 3], mean, normal, seen)
    for k in range(6):
        d = np.zeros((50, 6))
        d[:, k] = 1e-6
        up, down = x @ g.v2t(d), x @ g.v2t(-d)
        diff = (adjust.residuals(up[:, :3, :3], up[:, :3, 3], mean, normal, seen)[0] - adjust.residuals(down[:, :3, :3], down[:, :3, 3], mean, normal, seen)[0]) / 2e-6
        assert np.abs(diff - jac[:, k]).max() < 1e-6


@pytest.mark.parametrize("points", [np.zeros((1, 3)), np.zeros((5, 3)), np.arange(30).reshape(10, 3) * 0.1, np.random.default_rng(3).normal(size=(3000, 3))])
def test_tree_invariants(points):
    nodes, leaves = tree.build(points, 0.2, 0.1)
    assert sum(x["n"] for x in leaves) == len(points)
    for x in leaves:
        assert np.isfinite(x["normal"]).all() and abs(np.linalg.norm(x["normal"]) - 1) < 1e-9
        assert x["box"][2] < 0.2 or x["n"] == len(points) or x["n"] == 1
    arrays = {k: np.array([n[k] for n in nodes]) for k in ("left", "right", "leaf", "mean", "split")}
    assert (np.bincount(tree.descend(arrays, points), minlength=len(leaves)) == [x["n"] for x in leaves]).all()


def test_scans_larger_than_a_task_have_the_tree_that_one_task_builds(spark):
    rng = np.random.default_rng(8)
    flat = np.column_stack([rng.uniform(0, 4, 1500), rng.uniform(0, 3, 1500), rng.normal(0, 0.005, 1500)])
    scans = [rng.normal(size=(2000, 3)) + 3, np.vstack([flat, np.full((900, 3), 7.0)]), rng.normal(size=(40, 3))]
    rows = [(s, int(k), *map(float, p)) for s, own in enumerate(scans) for k, p in enumerate(own)]
    rows += [(0, -1, float("nan"), 0.0, 0.0), (1, -2, 0.0, float("inf"), 0.0), (2, -3, None, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "scan_id int, point_id long, x double, y double, z double").repartition(5)

    def get(task_points):
        found = tree.trees(points, 0.3, 0.1, task_points).orderBy("scan_id", "node_id").toPandas()
        return found, found[["scan_id", "node_id", "left_id", "right_id", "leaf_id", "n_points"]].fillna(-1).astype(int).to_numpy(), found.drop(columns=["n_points"]).to_numpy(float)

    _, want_ids, want = get(10_000)
    for task_points in (700, 60):
        _, ids, got = get(task_points)
        assert (ids == want_ids).all()
        far = ~np.isclose(got, want, atol=1e-9, equal_nan=True)
        assert not far.any(), (got[far.any(axis=1)][:5], want[far.any(axis=1)][:5], far.sum())
    for s, own in enumerate(scans):
        nodes, leaves = tree.build(own, 0.3, 0.1)
        assert (want_ids[want_ids[:, 0] == s][:, 4] == [n["leaf"] for n in nodes]).all() and (want_ids[:, 0] == s).sum() == len(nodes) > len(leaves)


def test_no_task_builds_more_points_than_it_may(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(0, k, *map(float, p)) for k, p in enumerate(rng.normal(size=(3000, 3)))]
    points = spark.createDataFrame(rows, "scan_id int, point_id long, x double, y double, z double")
    limit, whole = 500, tree.build

    def build(points, *rest):
        assert len(points) <= limit
        return whole(points, *rest)

    monkeypatch.setattr(tree, "build", build)
    assert tree.leaves(points, 0.5, 0.1, limit).agg(F.sum("n_points")).first()[0] == 3000


def test_schur_equals_the_full_system():
    import pandas as pd

    rng = np.random.default_rng(4)
    poses = arc(4)
    rows = []
    for s in range(40):
        n = rng.normal(size=3)
        mean, n = rng.normal(size=3) * 3, n / np.linalg.norm(n)
        for scan in sorted(rng.choice(4, rng.integers(2, 5), replace=False)):
            seen = poses[scan, :3, :3].T @ (mean - poses[scan, :3, 3]) + rng.normal(size=3) * 0.01
            rows.append((s, int(scan), [*mean, *n, *seen, rng.uniform(0.1, 1)]))
    f = pd.DataFrame(rows, columns=["surfel_id", "scan_id", "v"])
    lam = 1e-3
    out = pd.concat(adjust.partial_system(poses, 1e9, lam)(iter([f.iloc[:33], f.iloc[33:]])))
    step = adjust.solve_reduced(out.to_dict("records"), 4)
    sparse = adjust.solve_reduced(out.to_dict("records"), 4, dense=0)
    v = np.array(f["v"].tolist())
    scan, surfel = f["scan_id"].to_numpy(), f["surfel_id"].to_numpy()
    e, jac = adjust.residuals(poses[scan, :3, :3], poses[scan, :3, 3], v[:, :3], v[:, 3:6], v[:, 6:9])
    full = np.zeros((len(e), 24 + 40))
    for k in range(len(e)):
        full[k, 6 * scan[k] : 6 * scan[k] + 6], full[k, 24 + surfel[k]] = jac[k], 1
    full = full[:, 6:]
    h = full.T @ (v[:, 9:] * full)
    h[np.diag_indices(len(h))] *= 1 + lam
    want = np.linalg.solve(h, -full.T @ (v[:, 9] * e))[:18].reshape(3, 6)
    assert np.allclose(step[1:], want, atol=1e-6) and np.allclose(sparse[1:], want, atol=1e-6)


def test_replay_rules():
    gates = associate.Gates(0.5, 0.5, 5.0)
    up = np.array([0.0, 0.0, 1.0])
    mean = {(s, l): np.array([0.1 * s, float(l) * 3, 0.0]) for s in range(4) for l in range(2)}
    normal = dict.fromkeys(mean, up)
    found = associate.replay([(0, 0, 1, 0), (0, 1, 1, 1), (1, 0, 2, 0), (2, 0, 3, 1), (0, 0, 2, 0)], mean, normal, gates)
    assert found[0, 0] == found[1, 0] == found[2, 0] != found[0, 1] == found[1, 1]
    # near along the normal is enough: the two distances must both be large to refuse
    assert found[3, 1] == found[2, 0]


def test_room_is_refined(spark):
    truth = arc(4)
    rng = np.random.default_rng(5)
    start = truth @ g.v2t(np.hstack([rng.normal(0, 0.05, (4, 3)), rng.normal(0, 0.005, (4, 3))]))
    start[0] = truth[0]
    points = adjust.room(spark, truth, per_metre=3, noise=0.01).cache()
    assert points.groupBy("scan_id").agg(F.count("*")).count() == 4
    poses, history = adjust.adjust(points, start, adjust.Config(iterations=3, leaf_size=1.0, gates=associate.Gates(0.5, 0.3, 5.0)))
    error = lambda p: np.sqrt(((p[1:, :3, 3] - truth[1:, :3, 3]) ** 2).sum(axis=1).mean())
    assert all(h["after"] <= h["before"] and h["factors"] > 100 for h in history)
    assert error(poses) < 0.4 * error(start)
