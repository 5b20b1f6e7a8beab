import heapq

import numpy as np

from scanweave.functions import epipolar, geometry as g, simulate
from scanweave.operators import grids
from scanweave.operators.solver import Options, Problem


def table(spark, a, name):
    rows = [(0, int(r), int(c), float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, f"image int, row long, col long, {name} double")


def test_cheapest_ways(spark):
    rng = np.random.default_rng(1)
    cost = rng.choice([1.0, 2.0, 9.0], (9, 11))
    cells = table(spark, cost, "cost")
    got = {(r.row, r.col): r.distance for r in grids.cheapest(cells, cells.where("row = 2 and col = 3")).collect()}
    best, heap = {}, [(0.0, 2, 3)]
    while heap:
        d, r, c = heapq.heappop(heap)
        if (r, c) in best:
            continue
        best[r, c] = d
        for i, j, s in grids._STEPS:
            if 0 <= r + i < 9 and 0 <= c + j < 11:
                heapq.heappush(heap, (d + s * cost[r + i, c + j], r + i, c + j))
    assert got.keys() == best.keys() and all(abs(got[k] - best[k]) < 1e-9 for k in best)


def test_components_and_statistics(spark):
    a = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 0, 1]])
    cells = table(spark, a, "v").where("v = 1").drop("v")
    got = grids.cluster_statistics(grids.components(cells)).collect()
    assert sorted(r.n_cells for r in got) == [1, 2, 2, 2]


def test_lines_and_bilinear(spark):
    line = grids.line_cells(spark.createDataFrame([(1, 0, 0, 2, 5), (2, 3, 3, 3, 3)], "line_id int, r0 int, c0 int, r1 int, c1 int"))
    assert [(r.row, r.col) for r in line.where("line_id = 1").orderBy("k").collect()] == [(0, 0), (0, 1), (1, 2), (1, 3), (2, 4), (2, 5)]
    a = np.arange(12.0).reshape(3, 4)
    q = spark.createDataFrame([(1, 0, 0.25, 0.5), (2, 0, 1.5, 2.0), (3, 0, 2.0, 1.0), (4, 0, -0.5, 1.0)], "query_id int, image int, r double, c double")
    got = {r.query_id: r.v for r in grids.bilinear(table(spark, a, "v"), q, "v").collect()}
    assert got == {1: 1.5, 2: 8.0, 3: None, 4: None}


def test_closure_votes(spark):
    rows = [(1, 0.01)] * 4 + [(1, 1.0)] * 2 + [(2, 1.0)] * 5 + [(3, 0.01)] * 4 + [(4, 0.01)] * 4 + [(4, 1.0)] * 6
    got = {r.closure_id: r.status for r in grids.validate_closures(spark.createDataFrame(rows, "closure_id int, chi double")).collect()}
    assert got == {1: "accepted", 2: "rejected", 3: "open", 4: "open"}


def test_ransac_finds_the_pose(spark):
    rng = np.random.default_rng(2)
    x = g.v2t(np.array([[0.6, 0.1, 0.2, 0.05, -0.1, 0.07]]))[0]
    p = rng.uniform(-2, 2, (120, 3)) + [0, 0, 6]
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    a, b = unit(p), unit((p - x[:3, 3]) @ x[:3, :3])
    b[:30] = unit(rng.normal(size=(30, 3)))
    got, inliers = epipolar.ransac(spark, a, b, rounds=400, threshold=1e-3)
    assert inliers[30:].all() and np.allclose(got[:3, :3], x[:3, :3], atol=1e-4) and np.allclose(got[:3, 3], x[:3, 3] / np.linalg.norm(x[:3, 3]), atol=1e-3)
    r, inliers = epipolar.ransac(spark, a, unit(a @ x[:3, :3]), "rotation", rounds=20, threshold=1e-3)
    assert inliers.all() and np.allclose(r, x[:3, :3], atol=1e-6)


def test_simulated_graphs_are_solved(spark):
    for truth in (simulate.sphere(25), simulate.torus(25), simulate.manhattan(25)):
        assert np.allclose(truth[:, :3, :3] @ np.swapaxes(truth[:, :3, :3], 1, 2), np.eye(3))
    truth = simulate.manhattan(25)
    v, f = simulate.pose_graph(spark, truth, noise=0.005)
    p = Problem(v, f, Options("lm", iterations=10))
    p.solve()
    assert p.history[-1]["after"] <= p.history[0]["before"]
    m, c = simulate.unscented(np.array([1.0, 2.0]), np.diag([0.1, 0.2]), lambda q: np.array([[2.0, 1.0], [0.0, 3.0]]) @ q)
    assert np.allclose(m, [4, 6], atol=1e-6) and np.allclose(c, [[0.6, 0.6], [0.6, 1.8]], atol=1e-4)
