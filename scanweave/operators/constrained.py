"""Least squares under equality and inequality constraints, by multipliers and adaptive penalties (primal-dual Gauss-Newton).

Constraints stay distributed like factors. Each has a multiplier, a penalty and a last violation for every component; they are
columns of a table that is written anew whenever they change, so a lost executor costs its tasks only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.operators.factors import CONSTRAINTS, evaluate
from scanweave.operators.solver import FACTOR, PARTIAL, Options, Problem, add_share, batches_of, partial_rows
from scanweave.sources.tables import keep

BOUND = f"{FACTOR}, multiplier array<double>, rho array<double>, violation array<double>, active array<double>"


@dataclass
class Penalty:
    """How a penalty follows its constraint: towards `high` while the violation falls, towards `low` while it grows."""

    low: float = 0.1
    high: float = 100.0
    base: float = 0.1
    share: float = 1.0  # of the new penalty; the rest is the old one's
    release: bool = False  # whether an inequality that was met once may become inactive again


def _arrays(column: pd.Series, size: int, missing: float) -> np.ndarray:
    return np.array([[missing] * size if v is None else v for v in column], float).reshape(len(column), size)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, np.divide(a, b, out=np.zeros_like(a), where=b > 0))


def _advance(estimates, p: Penalty):
    """Multipliers, penalties and the active set at the estimates; the first time only the violation and the active set."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for kind, group, _, x, z in batches_of(frame, estimates.value):
                c, _ = evaluate(kind, x, z, False)
                equality, size = CONSTRAINTS[kind] == "equality", c.shape[1]
                began = np.array([v is not None for v in group["multiplier"]])[:, None]
                m, rho, was = (_arrays(group[n], size, d) for n, d in (("multiplier", 0.0), ("rho", p.base), ("violation", 0.0)))
                raised = m + rho * c
                m = np.where(began, raised if equality else np.maximum(0.0, raised), m)
                now = np.abs(c) if equality else np.maximum(c, 0.0)
                active = np.ones_like(c)
                if not equality:
                    held = np.zeros_like(c) if p.release else _arrays(group["active"], size, 0.0)
                    active = np.where(c + m / rho > 0, 1.0, held)
                target = p.base + _ratio(was - now, was) * (p.high - p.base) + _ratio(now - was, now) * (p.low - p.base)
                rho = np.where(began, p.share * target + (1 - p.share) * rho, rho)
                yield group.assign(multiplier=m.tolist(), rho=rho.tolist(), violation=now.tolist(), active=active.tolist())[[c.split()[0] for c in BOUND.split(", ")]]

    return run


def _linearise_bound(estimates):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks, rhs = {}, {}
        for frame in frames:
            for kind, group, ids, x, z in batches_of(frame, estimates.value):
                c, jac = evaluate(kind, x, z)
                m, rho, active = (_arrays(group[n], c.shape[1], 0.0) for n in ("multiplier", "rho", "active"))
                jac = [active[:, :, None] * j for j in jac]
                add_share(blocks, rhs, estimates.value, ids, jac, [rho[:, :, None] * j for j in jac], [-np.einsum("kid,ki->kd", j, m + rho * c) for j in jac])
        yield partial_rows(blocks, rhs, np.zeros((2, 3)))

    return run


class Constrained(Problem):
    """A Problem some of whose factors are constraints (their types are in CONSTRAINTS).

    Each iteration takes `runs` dual steps at the same estimates, which move multipliers and penalties, and then one primal step.
    """

    def __init__(self, variables: DataFrame, factors: DataFrame, options: Options = Options(), penalty: Penalty = Penalty(), runs: int = 1):
        super().__init__(variables, factors, options)
        self.penalty, self.runs = penalty, runs
        bound = F.col("type").isin(*sorted(CONSTRAINTS))
        names = [c.split()[0] for c in FACTOR.split(", ")]
        empty = [F.lit(None).cast("array<double>").alias(n) for n in ("multiplier", "rho", "violation", "active")]
        self.bound = keep(self.factors.where(bound).select(*names, *empty), "bound")
        self.factors = self.factors.where(~bound)

    def advance(self) -> None:
        held = self.held(self.x)
        self.bound = keep(self.bound.mapInPandas(_advance(held, self.penalty), BOUND), "bound")
        held.unpersist()

    def violation(self) -> float:
        """The largest violation at the last dual step."""
        return self.bound.agg(F.max(F.array_max("violation"))).first()[0] or 0.0

    def sums(self, x: dict, derivatives: bool = True) -> list:
        rows = super().sums(x, derivatives)
        if derivatives:
            held = self.held(x)
            rows += self.added(self.bound.mapInPandas(_linearise_bound(held), PARTIAL))
            held.unpersist()
        return rows

    def solve(self) -> DataFrame:
        o = self.options
        for _ in range(o.iterations):
            for _ in range(self.runs):
                self.advance()
                rows = self.sums(self.x)
                h, b, at = self.system(rows)
                step = h.factor(np.full(len(b), max(o.damping, 1e-12)))(b)
            before = sum(r["cost"] for r in rows if r["i"] < 0)
            self.x = self.moved(step, at)
            self.record(rows, b, step, before, before, True, self.violation())
            if o.criterion and self.stopped():
                break
        return self.estimates()
