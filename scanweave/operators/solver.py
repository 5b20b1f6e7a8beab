"""Generic non-linear least squares over factor tables: Gauss-Newton, Levenberg-Marquardt, dog-legs, line search, by levels.

Factors stay distributed: each task evaluates its factors in batches and adds up its share of the normal equations; sums
over blocks are taken by Spark, and the driver factorises one sparse block system per step, in memory that grows with the
graph and its fill-in, not with its square. Estimates of variables are broadcast for each step; a graph whose variables
outgrow that should be solved by views.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.operators.factors import FACTORS, VARIABLES, evaluate

FACTOR = "factor_id long, type string, variables array<long>, measurement array<double>, information array<double>"
PARTIAL = "i long, j long, h array<double>, b array<double>, chi double, cost double, n long"


@dataclass
class Options:
    algorithm: str = "lm"  # gn, lm, dogleg, double_dogleg or linesearch
    iterations: int = 50
    kernel: str | None = None
    threshold: float = 1.0
    damping: float = 1e-6
    scaled: bool = True  # damping times the diagonal, else times the identity
    trials: int = 10
    min_change: float = 1e-9
    min_step: float = 1e-12
    radius: float = 100.0
    criterion: str | None = None  # chi, step, gradient, step_violation or gradient_violation; None: min_change and min_step
    epsilon: float = 1e-6
    epsilon_violation: float = 1e-6
    policies: dict[str, tuple[str | None, float]] = field(default_factory=dict)  # kernel and threshold of factor types that have their own

    def robust(self, kind: str, chi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cost, weight) of squared errors of a factor type."""
        return robust(chi, *self.policies.get(kind, (self.kernel, self.threshold)))


def robust(chi: np.ndarray, kernel: str | None, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(cost, weight) in numpy; see graph.robust."""
    one = np.ones_like(chi)
    if kernel is None:
        return chi, one
    root = np.sqrt(chi)
    if kernel == "huber":
        return np.where(root < t, chi, 2 * t * np.abs(root - t)), np.where(root < t, 1.0, 2 * t / np.maximum(root, 1e-12))
    if kernel == "cauchy":
        return t * np.log1p(chi / t), 1 / (1 + chi / t)
    inside = chi < t
    return np.where(inside, chi, t if kernel == "saturated" else 0.0), inside.astype(float)


def floor(diagonal: np.ndarray, tiny: float, algorithm: str) -> np.ndarray:
    """What keeps a diagonal from zero. Levenberg-Marquardt damps, and takes back bad steps, so it gets it only where nothing else is:
    everywhere it would outlast the damping and slow long bends of large graphs, step by step."""
    return np.where(diagonal < tiny, tiny, 0.0) if algorithm == "lm" else np.full(len(diagonal), tiny)


def _information(rows: list, size: int) -> np.ndarray:
    """Full matrices from upper triangles by rows; an empty list is the identity."""
    out = np.tile(np.eye(size), (len(rows), 1, 1))
    upper = np.triu_indices(size)
    for k, r in enumerate(rows):
        if r is not None and len(r):
            m = np.zeros((size, size))
            m[upper] = r
            out[k] = m + m.T - np.diag(np.diag(m))
    return out


def batches_of(frame: pd.DataFrame, held: dict) -> Iterator[tuple]:
    """The factors of a frame by type: (type, their rows, variable ids, estimates of each variable, measurements)."""
    for kind, group in frame.groupby("type"):
        ids = np.array(group["variables"].tolist()).reshape(len(group), -1)
        x = [np.array([held[i][1] for i in ids[:, k]]) for k in range(ids.shape[1])]
        yield kind, group, ids, x, np.array(group["measurement"].tolist()).reshape(len(group), -1)


def add_share(blocks: dict, rhs: dict, held: dict, ids: np.ndarray, jac: list, weighted: list, gradients: list) -> None:
    """Adds a batch's blocks J^T W J and gradients to those of the task; fixed variables have none."""
    for a, g in enumerate(gradients):
        for b, wj in enumerate(weighted):
            h = np.einsum("kid,kie->kde", jac[a], wj)
            for k in range(len(ids)):
                i, j = int(ids[k, a]), int(ids[k, b])
                if held[i][2] or held[j][2] or i > j or (i == j and a > b):
                    continue
                blocks[i, j] = blocks.get((i, j), 0) + (h[k] if i != j or a == b else h[k] + h[k].T)
        for k in range(len(ids)):
            if not held[int(ids[k, a])][2]:
                rhs[int(ids[k, a])] = rhs.get(int(ids[k, a]), 0) + g[k]


def partial_rows(blocks: dict, rhs: dict, totals: np.ndarray) -> pd.DataFrame:
    """A task's share: blocks, and in rows -1 and -2 the chi, cost and number of inliers and of outliers."""
    rows = [(-1 - k, -1 - k, [], [], chi, cost, int(n)) for k, (chi, cost, n) in enumerate(totals)]
    rows += [(i, j, h.ravel().tolist(), rhs[i].tolist() if i == j else [], 0.0, 0.0, 0) for (i, j), h in blocks.items()]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PARTIAL.split(", ")])


def _linearise(estimates, options: Options, derivatives: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = estimates.value
        blocks: dict[tuple[int, int], np.ndarray] = {}
        rhs: dict[int, np.ndarray] = {}
        totals = np.zeros((2, 3))
        for frame in frames:
            for kind, group, ids, x, z in batches_of(frame, held):
                e, jac = evaluate(kind, x, z, derivatives)
                omega = _information(group["information"].tolist(), FACTORS[kind].size)
                chi = np.einsum("ki,kij,kj->k", e, omega, e)
                cost, weight = options.robust(kind, chi)
                for k, of in enumerate((cost == chi, cost != chi)):
                    totals[k] += chi[of].sum(), cost[of].sum(), of.sum()
                if derivatives:
                    wj = [np.einsum("k,kij,kjd->kid", weight, omega, j) for j in jac]
                    add_share(blocks, rhs, held, ids, jac, wj, [-np.einsum("kid,ki->kd", w, e) for w in wj])
        yield partial_rows(blocks, rhs, totals)

    return run


class Blocks:
    """A symmetric matrix of blocks, of which only those that factors couple are held, and its factorisation.

    Variables are eliminated in the order of their number of neighbours at that time, smallest first, which keeps new blocks
    few: a chain of poses with closures stays nearly as sparse as its graph.
    """

    def __init__(self, at: dict[int, slice], n: int):
        self.at, self.n = at, n
        self.blocks: dict[int, dict[int, np.ndarray]] = {i: {i: np.zeros((own.stop - own.start,) * 2)} for i, own in at.items()}

    def add(self, i: int, j: int, block: np.ndarray) -> None:
        for a, c, m in ((i, j, block), (j, i, block.T))[: 1 if i == j else 2]:
            self.blocks[a][c] = self.blocks[a][c] + m if c in self.blocks[a] else m

    def diagonal(self) -> np.ndarray:
        return np.concatenate([np.diag(self.blocks[i][i]) for i in self.at])

    def times(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for i, row in self.blocks.items():
            for j, m in row.items():
                out[self.at[i]] += m @ x[self.at[j]]
        return out

    def factor(self, extra: np.ndarray):
        """A function that solves (H + diag(extra)) x = b for any b."""
        rows = {i: dict(row) for i, row in self.blocks.items()}
        for i, own in self.at.items():
            rows[i][i] = rows[i][i] + np.diag(extra[own])
        queue = [(len(row), i) for i, row in rows.items()]
        heapq.heapify(queue)
        steps = []
        while queue:
            size, i = heapq.heappop(queue)
            if i not in rows or len(rows[i]) != size:
                continue  # its neighbours have changed since; a newer entry stands for it
            row = rows.pop(i)
            inverse = np.linalg.inv(row.pop(i))
            down = [(j, m.T @ inverse) for j, m in row.items()]
            for j, left in down:
                del rows[j][i]
                for k, m in row.items():
                    change = left @ m
                    rows[j][k] = rows[j][k] - change if k in rows[j] else -change
            for j in row:
                heapq.heappush(queue, (len(rows[j]), j))
            steps.append((self.at[i], inverse, [(self.at[j], left) for j, left in down]))

        def solve(b: np.ndarray) -> np.ndarray:
            x = b.astype(float).copy()
            for own, _, down in steps:
                for place, left in down:
                    x[place] -= left @ x[own]
            for own, inverse, down in reversed(steps):
                x[own] = inverse @ x[own]
                for place, left in down:
                    x[own] -= left.T @ x[place]
            return x

        return solve


class Problem:
    """Variables (variable_id, type, status, estimate) and factors (FACTOR, and `enabled` if there is one)."""

    def __init__(self, variables: DataFrame, factors: DataFrame, options: Options = Options()):
        self.options, self.spark = options, factors.sparkSession
        self.factors = factors.where("enabled") if "enabled" in factors.columns else factors
        rows = variables.select("variable_id", "type", "status", "estimate").collect()  # one row a variable
        self.types = {r["variable_id"]: r["type"] for r in rows}
        self.fixed = {r["variable_id"] for r in rows if r["status"] != "active"}
        self.x = {r["variable_id"]: np.array(r["estimate"], float) for r in rows}
        self.order = sorted(set(self.x) - self.fixed)
        self.history: list[dict] = []

    def held(self, x: dict):
        """Type, estimate and whether it is fixed of each variable, for the tasks."""
        return self.spark.sparkContext.broadcast({i: (self.types[i], v, i in self.fixed) for i, v in x.items()})

    def added(self, parts: DataFrame) -> list:
        """The shares of all tasks, added up by block."""
        add = lambda c: F.expr(f"aggregate(collect_list({c}), array_repeat(0D, size(first({c}))), (s, v) -> zip_with(s, v, (p, q) -> p + q))").alias(c)
        return parts.groupBy("i", "j").agg(add("h"), add("b"), F.sum("chi").alias("chi"), F.sum("cost").alias("cost"), F.sum("n").alias("n")).collect()

    def sums(self, x: dict, derivatives: bool = True) -> list:
        held = self.held(x)
        out = self.added(self.factors.select("type", "variables", "measurement", "information").mapInPandas(_linearise(held, self.options, derivatives), PARTIAL))
        held.unpersist()
        return out

    def system(self, rows: list) -> tuple[Blocks, np.ndarray, dict[int, slice]]:
        """Sparse H and b over the active variables that factors touch, and their places."""
        used = sorted({r["i"] for r in rows if r["i"] >= 0 and r["i"] == r["j"]})
        at, n = {}, 0
        for i in used:
            at[i] = slice(n, n := n + VARIABLES[self.types[i]].dof)
        h, b = Blocks(at, n), np.zeros(n)
        for r in rows:
            if r["i"] >= 0:
                a, c = at[r["i"]], at[r["j"]]
                h.add(r["i"], r["j"], np.array(r["h"]).reshape(a.stop - a.start, c.stop - c.start))
                if r["i"] == r["j"]:
                    b[a] += r["b"]
        return h, b, at

    def moved(self, step: np.ndarray, at: dict[int, slice]) -> dict:
        x = dict(self.x)
        for i, own in at.items():
            x[i] = VARIABLES[self.types[i]].retract(x[i][None], step[None, own])[0]
        return x

    def cost(self, x: dict) -> float:
        return sum(r["cost"] for r in self.sums(x, False) if r["i"] < 0)

    def record(self, rows: list, b: np.ndarray, step: np.ndarray, before: float, after: float, accepted: bool, violation: float = 0.0) -> None:
        """A row of the history: what the rows at the estimates before the step say, and the step."""
        parts = {r["i"]: r for r in rows if r["i"] < 0}
        counts = {f"{n}_{w}": parts[k][n] if k in parts else 0 for k, w in ((-1, "inliers"), (-2, "outliers")) for n in ("n", "chi")}
        self.history.append({"before": before, "after": after, "step": float(np.linalg.norm(step)), "gradient": float(np.linalg.norm(b)), "accepted": accepted, "violation": violation, **counts})

    def stopped(self) -> bool:
        """Whether the criterion of the options holds after the last iteration.

        chi: numbers of inliers and outliers are steady, and neither chi fell by more than the share epsilon. step: its norm is
        at most epsilon. gradient: its norm is at most epsilon * (1 + sqrt(cost)). The forms with _violation also ask for a largest
        violation of at most epsilon_violation.
        """
        o, now = self.options, self.history[-1]
        name, _, violation = o.criterion.partition("_")
        if violation and now["violation"] > o.epsilon_violation:
            return False
        if name == "step":
            return now["step"] <= o.epsilon
        if name == "gradient":
            return now["gradient"] <= o.epsilon * (1 + np.sqrt(now["before"]))
        if name != "chi":
            raise ValueError(f"no criterion named {o.criterion}")
        if len(self.history) < 2:
            return False
        was = self.history[-2]
        steady = all(now[f"n_{w}"] == was[f"n_{w}"] for w in ("inliers", "outliers"))
        return steady and all(was[f"chi_{w}"] <= 0 or 1 - now[f"chi_{w}"] / was[f"chi_{w}"] <= o.epsilon for w in ("inliers", "outliers"))

    def estimates(self) -> DataFrame:
        """The variables with their estimates as they are."""
        rows = [(i, self.types[i], "fixed" if i in self.fixed else "active", self.x[i].tolist()) for i in self.x]
        return self.spark.createDataFrame(rows, "variable_id long, type string, status string, estimate array<double>")

    def solve(self) -> DataFrame:
        """Runs the algorithm and gives the variables with their new estimates; self.history has a row per iteration."""
        o, damping, grow, radius = self.options, self.options.damping, 2.0, self.options.radius
        for _ in range(o.iterations):
            rows = self.sums(self.x)
            before = sum(r["cost"] for r in rows if r["i"] < 0)
            h, b, at = self.system(rows)
            if not len(b):
                break
            step, accepted, after = np.zeros_like(b), False, before
            diagonal = h.diagonal()
            scale = diagonal if o.scaled else np.ones(len(b))
            tiny = 1e-12 * max(diagonal.mean(), 1e-300) * np.ones(len(b))
            newton = None
            for _ in range(o.trials if o.algorithm != "gn" else 1):
                if o.algorithm in ("lm", "gn"):
                    step = h.factor(floor(diagonal, tiny[0], o.algorithm) + damping * scale)(b)
                else:
                    newton = h.factor(tiny)(b) if newton is None else newton
                    step = newton if o.algorithm == "linesearch" else _dogleg(h, b, newton, radius, o.algorithm == "double_dogleg")
                share = 1.0
                if o.algorithm == "linesearch":
                    while share > 1e-4 and self.cost(self.moved(share * step, at)) > before - 1e-4 * share * (b @ step):
                        share /= 2
                x = self.moved(share * step, at)
                after = self.cost(x)
                expected = step @ (2 * b - h.times(step))
                gain = (before - after) / expected if expected > 0 else -1.0
                if o.algorithm in ("gn", "linesearch") or gain > 0:
                    self.x, accepted = x, True
                    if o.algorithm == "lm":
                        damping *= float(np.clip(1 - (2 * gain - 1) ** 3, 1 / 3, 2 / 3))
                    grow, radius = 2.0, radius * (2.0 if gain > 0.75 else 0.5 if gain < 0.25 else 1.0)
                    break
                damping, grow, radius = damping * grow, grow * 2, radius / 4
            self.record(rows, b, step, before, after if accepted else before, accepted)
            small = np.linalg.norm(step) < o.min_step or before - after <= o.min_change * max(before, 1e-300)
            if not accepted or (self.stopped() if o.criterion else small):
                break
        return self.estimates()

    def marginals(self, ids: list[int] | None = None) -> dict[int, np.ndarray]:
        """Covariance blocks of active variables, all or those named, at the estimates as they are: columns of the inverse, from
        one factorisation."""
        h, b, at = self.system(self.sums(self.x))
        solve, out = h.factor(np.zeros(len(b))), {}
        for i in at if ids is None else ids:
            unit = np.zeros((len(b), at[i].stop - at[i].start))
            unit[at[i]] = np.eye(unit.shape[1])
            out[i] = np.stack([solve(u)[at[i]] for u in unit.T], axis=-1)
        return out


def solve_levels(variables: DataFrame, factors: DataFrame, options: dict[int, Options]) -> tuple[DataFrame, dict[int, list[dict]]]:
    """Solves the factors of one `level` after the other, the highest first, each from the estimates of the one before: the
    variables and the history of each level. Levels without options keep their factors out."""
    history = {}
    for level in sorted(options, reverse=True):
        problem = Problem(variables, factors.where(F.col("level") == level), options[level])
        variables, history[level] = problem.solve(), problem.history
    return variables, history


def _dogleg(h: Blocks, b: np.ndarray, newton: np.ndarray, radius: float, double: bool = False) -> np.ndarray:
    """The step towards the Gauss-Newton point along the steepest descent's bend, inside the radius. The double form bends once
    more, at the share |steep|^2 / (steep . newton) of the Gauss-Newton point."""
    if np.linalg.norm(newton) <= radius:
        return newton
    steep = b * (b @ b) / (b @ h.times(b))
    if np.linalg.norm(steep) >= radius:
        return steep * radius / np.linalg.norm(steep)
    end = newton * ((steep @ steep) / (steep @ newton)) if double else newton
    if np.linalg.norm(end) < radius:
        return newton * radius / np.linalg.norm(newton)
    d = end - steep
    a, m, c = d @ d, steep @ d, steep @ steep - radius * radius
    return steep + d * (-m + np.sqrt(m * m - a * c)) / a


def initialise(variables: DataFrame, factors: DataFrame, kind: str = "se3_pose_pose") -> DataFrame:
    """Estimates of variables spread from the fixed ones over pose-pose factors, breadth first: (variable_id, estimate).

    One round per hop; each new variable takes the factor of the smallest id among those that reach it.
    """
    from scanweave.sources.tables import keep

    product = lambda a, b, t: F.array(*[sum((a[4 * i + k] * (b[4 * k + j] if not t else b[4 * k + j]) for k in range(4)), F.lit(0.0)) for i in range(4) for j in range(4)])
    inverse = lambda a: F.array(*[e for i in range(3) for e in (a[i], a[4 + i], a[8 + i], -(a[i] * a[3] + a[4 + i] * a[7] + a[8 + i] * a[11]))], F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    edges = factors.where(F.col("type") == kind).select("factor_id", F.col("variables")[0].alias("a"), F.col("variables")[1].alias("b"), "measurement")
    both = keep(edges.select("factor_id", "a", "b", "measurement").unionByName(edges.select("factor_id", F.col("b").alias("a"), F.col("a").alias("b"), inverse(F.col("measurement")).alias("measurement"))), "initial-edges")
    known = keep(variables.where("status = 'fixed'").select("variable_id", "estimate"), "initial")
    frontier = known
    while True:
        reach = both.join(frontier.withColumnRenamed("variable_id", "a"), "a").select(F.col("b").alias("variable_id"), "factor_id", product(F.col("estimate"), F.col("measurement"), False).alias("estimate"))
        reach = reach.join(known.select("variable_id"), "variable_id", "left_anti").groupBy("variable_id").agg(F.min_by("estimate", "factor_id").alias("estimate"))
        frontier = keep(reach, "initial")
        if not frontier.limit(1).count():
            return known
        known = known.unionByName(frontier)
