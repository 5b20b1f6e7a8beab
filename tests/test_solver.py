import numpy as np
import pytest

from scanweave.functions import geometry as g, simulate
from scanweave.operators import factors as fa
from scanweave.operators.solver import Options, Problem, initialise

VAR = "variable_id long, type string, status string, estimate array<double>"
FAC = "factor_id long, type string, variables array<long>, measurement array<double>, information array<double>"


def poses(n, seed=1, size=2.0):
    rng = np.random.default_rng(seed)
    return g.v2t(np.hstack([rng.normal(0, size, (n, 3)), rng.uniform(-0.4, 0.4, (n, 3))]))


def noise(x, seed, far=0.1):
    rng = np.random.default_rng(seed)
    return x @ g.v2t(rng.uniform(-far, far, (len(x), 6)))


def graph(spark, n=12, status="fixed"):
    x = poses(n)
    start = noise(x, 2)
    start[0] = x[0]
    pairs = [(i, i + 1) for i in range(n - 1)] + [(i, (i + 5) % n) for i in range(n)]
    rows = [(k, "se3_pose_pose", [i, j], (g.inverse(x[i]) @ x[j]).ravel().tolist(), []) for k, (i, j) in enumerate(pairs)]
    v = [(i, "se3", "fixed" if i == 0 else "active", start[i].ravel().tolist()) for i in range(n)]
    return x, spark.createDataFrame(v, VAR), spark.createDataFrame(rows, FAC)


@pytest.mark.parametrize("algorithm", ["gn", "lm", "dogleg", "linesearch"])
def test_pose_graph_is_recovered(spark, algorithm):
    x, v, f = graph(spark)
    p = Problem(v, f, Options(algorithm, iterations=15, damping=1e-9))
    got = {r.variable_id: np.array(r.estimate).reshape(4, 4) for r in p.solve().collect()}
    assert p.history[-1]["after"] < 1e-6
    assert max(np.abs(got[i] - x[i]).max() for i in range(len(x))) < 1e-5


def test_initialisation_spreads_from_fixed_variables(spark):
    x, v, f = graph(spark)
    got = {r.variable_id: np.array(r.estimate).reshape(4, 4) for r in initialise(v, f).collect()}
    assert len(got) == len(x) and max(np.abs(got[i] - x[i]).max() for i in got) < 1e-9


def test_registration_with_outliers_needs_a_kernel(spark):
    rng = np.random.default_rng(3)
    x = poses(1)[0]
    moving = rng.normal(size=(80, 3))
    fixed = moving @ x[:3, :3].T + x[:3, 3]
    fixed[:12] += rng.normal(0, 5, (12, 3))
    rows = [(k, "se3_point_point", [0], [*fixed[k].tolist(), *moving[k].tolist()], []) for k in range(80)]
    v, f = spark.createDataFrame([(0, "se3", "active", noise(x[None], 4)[0].ravel().tolist())], VAR), spark.createDataFrame(rows, FAC)
    error = {}
    for kernel in (None, "cauchy", "huber"):
        got = Problem(v, f, Options("lm", iterations=30, kernel=kernel, threshold=0.01)).solve().first()
        error[kernel] = np.abs(np.array(got.estimate).reshape(4, 4) - x).max()
    assert error["cauchy"] < 0.01 < error[None] and error["huber"] < error[None]


def test_planar_landmarks(spark):
    rng = np.random.default_rng(5)
    x = np.stack([np.arange(6) * 1.0, np.sin(np.arange(6)), np.linspace(0, 1, 6)], axis=1)
    p = rng.uniform(-3, 8, (8, 2))
    c, s = np.cos(x[:, 2]), np.sin(x[:, 2])
    rows = []
    for i in range(6):
        for k in range(8):
            d = p[k] - x[i, :2]
            rows.append((len(rows), "se2_pose_point", [i, 100 + k], [float(c[i] * d[0] + s[i] * d[1]), float(-s[i] * d[0] + c[i] * d[1])], [1.0, 0.0, 1.0]))
    v = [(i, "se2", "fixed" if i == 0 else "active", (x[i] + (rng.normal(0, 0.1, 3) if i else 0)).tolist()) for i in range(6)]
    v += [(100 + k, "point2", "active", (p[k] + rng.normal(0, 0.2, 2)).tolist()) for k in range(8)]
    problem = Problem(spark.createDataFrame(v, VAR), spark.createDataFrame(rows, FAC), Options(iterations=20))
    got = {r.variable_id: np.array(r.estimate) for r in problem.solve().collect()}
    assert max(np.abs(got[100 + k] - p[k]).max() for k in range(8)) < 1e-5
    assert all(np.linalg.eigvalsh(m).min() > 0 for m in problem.marginals().values())


@pytest.mark.parametrize("kind", sorted(fa.FACTORS))
def test_every_factor_has_its_size_and_derivatives(kind):
    rng = np.random.default_rng(6)
    f, n = fa.FACTORS[kind], 7
    x = []
    for k, name in enumerate(f.variables):
        if fa.VARIABLES[name].size == 16:
            x.append(poses(n, 10 + k).reshape(n, 16))
        elif name in ("so3", "so3_relaxed"):
            x.append(poses(n, 20 + k)[:, :3, :3].reshape(n, 9))
        else:
            x.append(rng.uniform(0.5, 1.5, (n, fa.VARIABLES[name].size)))
    z = np.hstack([poses(n, 30).reshape(n, 16), poses(n, 31).reshape(n, 16), poses(n, 32).reshape(n, 16), np.full((n, 4), 0.7)])
    e, jac = fa.evaluate(kind, x, z)
    assert e.shape == (n, f.size) and np.isfinite(e).all()
    for j, name in zip(jac, f.variables, strict=True):
        assert j.shape == (n, f.size, fa.VARIABLES[name].dof) and np.isfinite(j).all()


def test_factors_vanish_at_the_truth():
    a, b, p = poses(5, 1), poses(5, 2), np.random.default_rng(7).normal(size=(5, 3)) + [0, 0, 9]
    flat = lambda m: m.reshape(5, -1)
    zero = lambda kind, x, z: np.abs(fa.FACTORS[kind].residual(*x, z)).max() < 1e-9
    z = flat(g.inverse(a) @ b)
    assert zero("se3_pose_pose", [flat(a), flat(b)], z) and zero("se3_pose_pose_chordal", [flat(a), flat(b)], z) and zero("sim3_pose_pose", [flat(a), flat(b)], z)
    assert zero("se3_prior", [flat(a)], flat(a)) and zero("gps", [flat(a)], a[:, :3, 3])
    assert zero("se3_hand_eye", [flat(a)], np.hstack([flat(b), flat(g.inverse(a) @ b @ a)]))
    seen = np.einsum("kij,kj->ki", g.inverse(a)[:, :3, :3], p) + g.inverse(a)[:, :3, 3]
    k = np.tile([500.0, 510.0, 320.0, 240.0], (5, 1))
    pixel = fa._pixel(seen, k)
    assert zero("se3_pose_point", [flat(a), p], seen) and zero("ba_pinhole", [flat(a), p], np.hstack([pixel, k]))
    assert zero("se3_projective_depth", [flat(a)], np.hstack([pixel, seen[:, 2:], k, p]))
    other = np.einsum("kij,kj->ki", g.inverse(b)[:, :3, :3], p) + g.inverse(b)[:, :3, 3]
    assert zero("epipolar", [flat(a), flat(b)], np.hstack([seen, other]))


def test_imu_preintegration_and_factor():
    rng = np.random.default_rng(8)
    samples = np.hstack([np.full((50, 1), 0.01), rng.normal(0, 1, (50, 3)), rng.normal(0, 0.3, (50, 3))])
    d = fa.preintegrate(samples, np.zeros(6))
    x, v, t = poses(1, 9)[0], np.array([0.3, -0.2, 0.1]), d["time"]
    y = np.eye(4)
    y[:3, :3] = x[:3, :3] @ d["rotation"]
    y[:3, 3] = x[:3, 3] + v * t + 0.5 * fa.GRAVITY * t * t + x[:3, :3] @ d["position"]
    w = v + fa.GRAVITY * t + x[:3, :3] @ d["velocity"]
    z = np.concatenate([d["rotation"].ravel(), d["velocity"], d["position"], [t]])[None]
    e = fa.FACTORS["imu"].residual(x.reshape(1, 16), v[None], y.reshape(1, 16), w[None], np.zeros((1, 6)), np.zeros((1, 6)), z)
    assert np.abs(e).max() < 1e-9


def test_sparse_factorisation_equals_the_dense_solution():
    from scanweave.operators.solver import Blocks

    rng = np.random.default_rng(9)
    dofs = rng.integers(1, 4, 40)
    ends = np.cumsum(dofs)
    at = {int(i): slice(int(e - d), int(e)) for i, (e, d) in enumerate(zip(ends, dofs, strict=True))}
    blocks, dense = Blocks(at, int(ends[-1])), np.zeros((ends[-1], ends[-1]))
    for i, j in [(i, i + 1) for i in range(39)] + [tuple(sorted(map(int, rng.choice(40, 2, replace=False)))) for _ in range(25)]:
        m = rng.normal(size=(3, dofs[i] + dofs[j]))
        for a, ma in ((i, m[:, : dofs[i]]), (j, m[:, dofs[i] :])):
            blocks.add(a, a, ma.T @ ma)
            dense[at[a], at[a]] += ma.T @ ma
        own = m[:, : dofs[i]].T @ m[:, dofs[i] :]
        blocks.add(i, j, own)
        dense[at[i], at[j]] += own
        dense[at[j], at[i]] += own.T
    b, extra = rng.normal(size=ends[-1]), np.full(ends[-1], 0.1)
    assert np.allclose(blocks.times(b), dense @ b) and np.allclose(blocks.diagonal(), np.diag(dense))
    assert np.allclose(blocks.factor(extra)(b), np.linalg.solve(dense + np.diag(extra), b))


def test_two_thousand_poses_need_no_dense_matrix(spark):
    import tracemalloc

    variables, factors = simulate.pose_graph(spark, simulate.manhattan(2000), noise=0.001)
    problem = Problem(variables, factors, Options("gn", iterations=2))
    tracemalloc.start()
    problem.solve()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert problem.history[-1]["after"] < 1e-2 * problem.history[0]["before"] and peak < 600e6  # 12,000 unknowns: 1,152 MB dense
