"""Bundle adjustment of scan poses and surfels by robust point-to-plane least squares.

A factor ties a pose and a surfel: e = n_s . (p_s - m), with the surfel seen in the scan's frame and m its leaf there. A
surfel only moves along its normal, so it is eliminated inside its group; what reaches the driver is the system of the
poses, one 6 x 6 block for each pair of scans that share a surfel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanweave.functions import geometry
from scanweave.operators import associate, surfels, tree
from scanweave.operators.associate import Gates
from scanweave.sources.tables import keep

WEIGHT_FLOOR = 0.05
PARTIAL = "i int, j int, h array<double>, b array<double>, chi double, n long"


@dataclass
class Config:
    iterations: int = 10
    huber: float = 0.1
    gates: Gates = field(default_factory=Gates)
    leaf_size: float = 0.2
    flatness: float = 0.1
    damping: float = 1e-7
    trials: int = 10
    dense_scans: int = 500


def huber(chi: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(cost, weight); see graph.robust for its form."""
    root = np.sqrt(chi)
    far = root >= t
    return np.where(far, 2 * t * np.abs(root - t), chi), np.where(far, 2 * t / np.maximum(root, 1e-12), 1.0)


def residuals(rotation: np.ndarray, translation: np.ndarray, mean: np.ndarray, normal: np.ndarray, measured: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """e and its derivative by the pose's six parameters (right perturbation by translation and imaginary quaternion); the
    derivative by the surfel's offset is 1."""
    seen = np.einsum("kji,kj->ki", rotation, mean - translation)
    n = np.einsum("kji,kj->ki", rotation, normal)
    return (n * (seen - measured)).sum(axis=1), np.hstack([-n, -2 * np.cross(measured, n)])


def partial_system(poses: np.ndarray, threshold: float, damping: float | None, fixed: int = 0):
    """A function for mapInPandas over factors sorted by surfel: partial sums of the reduced system of one task.

    damping None: only costs. Groups are whole within a task; a surfel has one leaf per scan at most, so they are small.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks: dict[tuple[int, int], np.ndarray] = {}
        rhs: dict[int, np.ndarray] = {}
        cost, n, rest = 0.0, 0, None

        def add(group: pd.DataFrame) -> None:
            nonlocal cost, n
            scan = group["scan_id"].to_numpy()
            v = np.array(group["v"].tolist())
            e, jac = residuals(poses[scan, :3, :3], poses[scan, :3, 3], v[:, :3], v[:, 3:6], v[:, 6:9])
            chi = v[:, 9] * e * e
            c, r = huber(chi, threshold)
            cost, n = cost + c.sum(), n + len(e)
            if damping is None:
                return
            w = v[:, 9] * r
            edges = np.flatnonzero(np.diff(group["surfel_id"].to_numpy(), prepend=-1))
            for low, high in zip(edges, [*edges[1:], len(e)], strict=True):
                own = slice(low, high)
                h, g = (1 + damping) * w[own].sum(), -(w[own] * e[own]).sum()
                wj = w[own, None] * jac[own]
                for k, i in enumerate(scan[own]):
                    if i == fixed:
                        continue
                    hk = np.outer(wj[k], jac[low + k])
                    hk[np.diag_indices(6)] *= 1 + damping
                    blocks[i, i] = blocks.get((i, i), 0) + hk
                    rhs[i] = rhs.get(i, 0) - wj[k] * e[low + k] - wj[k] * g / h
                    for l, j in enumerate(scan[own]):
                        if j != fixed and i <= j:
                            blocks[i, j] = blocks.get((i, j), 0) - np.outer(wj[k], wj[l]) / h

        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            last = frame["surfel_id"].to_numpy() == frame["surfel_id"].iloc[-1] if len(frame) else np.zeros(0, bool)
            rest = frame[last]
            if len(done := frame[~last]):
                add(done.reset_index(drop=True))
        if rest is not None and len(rest):
            add(rest.reset_index(drop=True))
        rows = [(-1, -1, [], [], cost, n)] + [(int(i), int(j), m.ravel().tolist(), rhs[i].tolist() if i == j else [], 0.0, 0) for (i, j), m in blocks.items()]
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in PARTIAL.split(", ")])

    return run


def _sums(factors: DataFrame, run) -> list:
    add = lambda c: F.expr(f"aggregate(collect_list({c}), array_repeat(0D, size(first({c}))), (s, x) -> zip_with(s, x, (p, q) -> p + q))")
    parts = factors.mapInPandas(run, PARTIAL)  # one row a task and block
    return parts.groupBy("i", "j").agg(add("h").alias("h"), add("b").alias("b"), F.sum("chi").alias("chi"), F.sum("n").alias("n")).collect()


def solve_reduced(rows: list, n_scans: int, fixed: int = 0, dense: int = 500) -> np.ndarray:
    """(n_scans, 6) steps from the blocks: dense Cholesky, or conjugate gradients over the blocks for long runs."""
    step = np.zeros((n_scans, 6))
    pairs = [(r["i"], r["j"], np.array(r["h"]).reshape(6, 6), np.array(r["b"])) for r in rows if r["i"] >= 0]
    used = sorted({i for i, _, _, _ in pairs} | {j for _, j, _, _ in pairs} - {fixed})
    at = {s: k for k, s in enumerate(used)}
    b = np.zeros((len(used), 6))
    for i, j, _, v in pairs:
        if i == j:
            b[at[i]] += v
    if not used:
        return step
    if len(used) <= dense:
        h = np.zeros((len(used), 6, len(used), 6))
        for i, j, m, _ in pairs:
            h[at[i], :, at[j]] += m
            if i != j:
                h[at[j], :, at[i]] += m.T
        h = h.reshape(6 * len(used), -1)
        h[np.diag_indices(len(h))] += 1e-12 * np.trace(h) / len(h)
        step[used] = np.linalg.solve(h, b.ravel()).reshape(-1, 6)
        return step
    ii, jj, m = np.array([at[p[0]] for p in pairs]), np.array([at[p[1]] for p in pairs]), np.array([p[2] for p in pairs])
    off, diag = ii != jj, np.zeros((len(used), 6, 6))
    np.add.at(diag, ii[~off], m[~off])
    precondition = np.linalg.inv(diag + 1e-12 * np.eye(6))

    def times(x: np.ndarray) -> np.ndarray:
        y = np.einsum("kab,kb->ka", diag, x)
        np.add.at(y, ii[off], np.einsum("kab,kb->ka", m[off], x[jj[off]]))
        np.add.at(y, jj[off], np.einsum("kba,kb->ka", m[off], x[ii[off]]))
        return y

    x, r = np.zeros_like(b), b.copy()
    z = np.einsum("kab,kb->ka", precondition, r)
    p, rz = z.copy(), (r * z).sum()
    for _ in range(10 * len(used)):
        q = times(p)
        alpha = rz / (p * q).sum()
        x, r = x + alpha * p, r - alpha * q
        if np.abs(r).max() < 1e-10 * np.abs(b).max():
            break
        z = np.einsum("kab,kb->ka", precondition, r)
        p, rz = z + (r * z).sum() / rz * p, (r * z).sum()
    step[used] = x
    return step


def _factors(leaves: DataFrame, groups: DataFrame, poses: np.ndarray) -> DataFrame:
    """(surfel_id, scan_id, v): v holds the surfel's mean and normal in the world, the leaf's mean in its scan, the weight."""
    weighted = surfels.beam_weight(leaves).withColumn("w", F.greatest("weight", F.lit(WEIGHT_FLOOR)))
    own = groups.join(weighted, ["scan_id", "leaf_id"])
    world = own.mapInPandas(_to_world(poses), "surfel_id long, scan_id int, m array<double>, w double, wm array<double>, wn array<double>")
    flat = world.select("surfel_id", *[F.col("wm")[i].alias(f"m{c}") for i, c in enumerate("xyz")], *[F.col("wn")[i].alias(f"n{c}") for i, c in enumerate("xyz")])
    mean = surfels.average(flat).select("surfel_id", F.array("mx", "my", "mz", "nx", "ny", "nz").alias("s"))
    joined = world.join(mean, "surfel_id").select("surfel_id", "scan_id", F.concat("s", "m", F.array("w")).alias("v"))
    return keep(joined.repartition("surfel_id").sortWithinPartitions("surfel_id", "scan_id"), "factors")


def _to_world(poses: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            scan = f["scan_id"].to_numpy()
            m, n = f[["mx", "my", "mz"]].to_numpy(), f[["nx", "ny", "nz"]].to_numpy()
            r = poses[scan, :3, :3]
            world = np.einsum("kij,kj->ki", r, m) + poses[scan, :3, 3]
            yield pd.DataFrame({"surfel_id": f["surfel_id"], "scan_id": scan, "m": list(m), "w": f["w"], "wm": list(world), "wn": list(np.einsum("kij,kj->ki", r, n))})

    return run


def _moved(df: DataFrame, poses: np.ndarray, direction: str) -> DataFrame:
    names = [f"{direction}{c}" for c in "xyz"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            r = poses[f["scan_id"].to_numpy()]
            f[["mx", "my", "mz"]] = np.einsum("kij,kj->ki", r[:, :3, :3], f[["mx", "my", "mz"]].to_numpy()) + r[:, :3, 3]
            f[names] = np.einsum("kij,kj->ki", r[:, :3, :3], f[names].to_numpy())
            yield f

    return df.mapInPandas(run, df.schema)


def adjust(points: DataFrame, poses: np.ndarray, config: Config = Config()) -> tuple[np.ndarray, list[dict]]:
    """Refined poses (n, 4, 4) of the scans 0..n-1 and statistics of each iteration; scan 0 stays where it is.

    points has (scan_id, point_id, x, y, z) in each scan's frame. Each iteration associates anew, then takes one
    Levenberg-Marquardt step: more damping until the robust cost falls, at most config.trials times.
    """
    trees = keep(tree.trees(points, config.leaf_size, config.flatness), "trees")
    leaves, nodes = tree.leaves_of(trees), tree.nodes_of(trees)
    poses, history = np.array(poses, float), []
    for _ in range(config.iterations):
        matches = keep(associate.match(_moved(nodes, poses, "s"), _moved(leaves, poses, "n"), config.gates), "matches")
        groups = keep(associate.merge(matches, _moved(leaves, poses, "n"), config.gates), "surfel-leaves")
        radius = surfels.max_radius(groups.join(leaves, ["scan_id", "leaf_id"]), "surfel_id").select("surfel_id")
        factors = _factors(leaves, groups.join(radius, "surfel_id", "left_semi"), poses)
        damping, grow, accepted = config.damping, 2.0, False
        before = after = None
        for _ in range(config.trials):
            rows = _sums(factors, partial_system(poses, config.huber, damping))
            before = sum(r["chi"] for r in rows if r["i"] < 0)
            step = solve_reduced(rows, len(poses), dense=config.dense_scans)
            trial = poses @ geometry.v2t(step)
            trial[0] = poses[0]
            after = _trial_cost(factors, trial, config.huber)
            if after <= before:
                poses, accepted = trial, True
                break
            damping, grow = max(damping, 1e-7) * grow * 10, grow * 2
        history.append({"factors": int(sum(r["n"] for r in rows if r["i"] < 0)), "before": before, "after": after if accepted else before, "accepted": accepted, "damping": damping})
    return poses, history


def _trial_cost(factors: DataFrame, poses: np.ndarray, threshold: float) -> float:
    """The robust cost after each surfel has taken its best offset along its normal, a weighted mean of its residuals."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None

        def cost(f: pd.DataFrame) -> float:
            scan, v = f["scan_id"].to_numpy(), np.array(f["v"].tolist())
            e, _ = residuals(poses[scan, :3, :3], poses[scan, :3, 3], v[:, :3], v[:, 3:6], v[:, 6:9])
            w = v[:, 9] * huber(v[:, 9] * e * e, threshold)[1]
            _, at = np.unique(f["surfel_id"].to_numpy(), return_inverse=True)
            e = e - (np.bincount(at, w * e) / np.bincount(at, w))[at]
            return float(huber(v[:, 9] * e * e, threshold)[0].sum())

        total = 0.0
        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            if len(f):
                last = f["surfel_id"] == f["surfel_id"].iloc[-1]
                rest = f[last]
                total += cost(f[~last]) if (~last).any() else 0.0
        if rest is not None and len(rest):
            total += cost(rest)
        yield pd.DataFrame({"chi": [total]})

    return factors.mapInPandas(run, "chi double").agg(F.sum("chi")).first()[0] or 0.0


def room(spark: SparkSession, poses: np.ndarray, size: tuple[float, float, float] = (10.0, 15.0, 5.0), per_metre: int = 5, noise: float = 0.03, seed: int = 1) -> DataFrame:
    """A box-shaped room's wall points as each pose sees them: (scan_id, point_id, x, y, z)."""
    held = np.array(poses, float)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for scan in f["id"]:
                rng = np.random.default_rng([seed, int(scan)])
                walls = []
                for axis in range(3):
                    a, b = (i for i in range(3) if i != axis)
                    u, v = np.meshgrid(np.arange(0, size[a], 1 / per_metre), np.arange(0, size[b], 1 / per_metre))
                    for end in (0.0, size[axis]):
                        p = np.zeros((u.size, 3))
                        p[:, a], p[:, b], p[:, axis] = u.ravel(), v.ravel(), end
                        walls.append(p)
                p = np.concatenate(walls) + rng.normal(0, noise, (sum(map(len, walls)), 3))
                p = (p - held[scan, :3, 3]) @ held[scan, :3, :3]
                yield pd.DataFrame({"scan_id": np.full(len(p), scan, "int32"), "point_id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

    return spark.range(len(held)).mapInPandas(run, "scan_id int, point_id long, x double, y double, z double")
