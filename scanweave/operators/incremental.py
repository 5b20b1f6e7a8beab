"""Solving a factor graph as it grows: epochs of factors, local solutions, and one over everything from time to time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.operators.solver import Options, Problem, initialise
from scanweave.sources.tables import keep


def surroundings(edges: DataFrame, pending: DataFrame, parameters: DataFrame) -> DataFrame:
    """(variable_id): what shares a factor with a pending variable, is not pending itself and is no parameter. A local solution
    holds these fixed. edges (factor_id, variable_id); pending and parameters (variable_id)."""
    ids = pending.select("variable_id").distinct()
    touched = edges.join(ids, "variable_id", "left_semi").select("factor_id").distinct()
    outer = edges.join(touched, "factor_id", "left_semi").select("variable_id").distinct()
    return outer.join(ids, "variable_id", "left_anti").join(parameters.select("variable_id").distinct(), "variable_id", "left_anti")


class Incremental:
    """Variables and factors as in Problem, and the epoch of each factor: (factor_id, epoch).

    An epoch's new variables of type `gauge` are spread over its factors of `kind` from those known before; other new variables
    start at the estimates they come with. Factors wait until all their variables are known. Factors since the last global
    solution are pending: their variables are solved with the first pending variable of the gauge's type and everything
    around them held. Every `global_step` epochs, and at the end, all factors so far are solved with the very first gauge held.
    The driver holds the variables of the solution at hand only.
    """

    def __init__(self, variables: DataFrame, factors: DataFrame, epochs: DataFrame, global_step: int = 10, local: Options = Options("gn", iterations=3), overall: Options = Options("gn", iterations=10), gauge: str = "se3", kind: str = "se3_pose_pose"):
        self.variables = keep(variables.select("variable_id", "type", "status", "estimate"), "incremental")
        self.arrived = keep(factors.join(epochs.select("factor_id", "epoch"), "factor_id"), "incremental")
        self.edges = keep(self.arrived.select("factor_id", "epoch", F.explode("variables").alias("variable_id")), "incremental")
        self.global_step, self.local, self.overall, self.gauge, self.kind = global_step, local, overall, gauge, kind
        self.parameters = self.variables.where("status = 'fixed'").select("variable_id")
        self.known = self.variables.where("status = 'fixed'").select("variable_id", "estimate")
        self.first: int | None = None
        self.history: list[dict] = []

    def spread(self, epoch, start: int) -> None:
        """Estimates for the variables that come with an epoch."""
        new = self.edges.where(F.col("epoch") == epoch).select("variable_id").distinct()
        given = self.variables.join(new, "variable_id", "left_semi").where((F.col("type") != self.gauge) | (F.col("variable_id") == start))
        known = self.known.unionByName(given.select("variable_id", "estimate").join(self.known.select("variable_id"), "variable_id", "left_anti"))
        self.known = initialise(known.withColumn("status", F.lit("fixed")), self.arrived.where(F.col("epoch") == epoch), self.kind)

    def solve(self, factors: DataFrame, edges: DataFrame, held: DataFrame, options: Options, epoch, scope: str) -> None:
        """The given factors as far as their variables are known, with `held` (variable_id) and the parameters fixed."""
        waiting = edges.join(self.known.select("variable_id"), "variable_id", "left_anti").select("factor_id").distinct()
        ready = factors.join(waiting, "factor_id", "left_anti")
        ids = ready.select(F.explode("variables").alias("variable_id")).distinct()
        still = held.select("variable_id").unionByName(self.parameters).distinct().withColumn("_held", F.lit(True))
        own = self.variables.select("variable_id", "type").join(self.known, "variable_id").join(ids, "variable_id", "left_semi").join(still, "variable_id", "left")
        problem = Problem(own.select("variable_id", "type", F.when(F.col("_held"), "fixed").otherwise("active").alias("status"), "estimate"), ready, options)
        solved = problem.solve().select("variable_id", "estimate")
        self.known = keep(self.known.join(solved.select("variable_id"), "variable_id", "left_anti").unionByName(solved), "incremental")
        self.history.append({"epoch": epoch, "scope": scope, "variables": len(problem.x), "active": len(problem.order), "after": problem.history[-1]["after"] if problem.history else 0.0})

    def one(self, variable_id) -> DataFrame:
        return self.variables.where(F.col("variable_id") == variable_id).select("variable_id")

    def run(self) -> DataFrame:
        """All epochs in order and the last global solution: (variable_id, estimate) of every variable that became known."""
        since, steps, epoch = None, 0, None
        for (epoch,) in self.arrived.select("epoch").distinct().orderBy("epoch").collect():  # one row an epoch
            since = epoch if since is None else since
            so_far = self.edges.where(F.col("epoch") <= epoch)
            pending = so_far.where(F.col("epoch") >= since).select("variable_id").distinct()
            of_gauge = self.variables.where(F.col("type") == self.gauge).join(self.parameters, "variable_id", "left_anti")
            start = of_gauge.join(pending, "variable_id", "left_semi").agg(F.min("variable_id")).first()[0]
            if start is None:
                start = self.first
            if start is None:
                continue
            self.first = start if self.first is None else self.first
            steps += 1
            self.spread(epoch, start)
            released = self.arrived.where(F.col("epoch") <= epoch)
            if steps < self.global_step:
                near = so_far.join(pending, "variable_id", "left_semi").select("factor_id").distinct()
                held = surroundings(so_far, pending, self.parameters).unionByName(self.one(start))
                self.solve(released.join(near, "factor_id", "left_semi"), so_far, held, self.local, epoch, "local")
            else:
                self.solve(released, so_far, self.one(self.first), self.overall, epoch, "global")
                since, steps = None, 0
        if self.first is not None:
            self.solve(self.arrived, self.edges, self.one(self.first), self.overall, epoch, "final")
        return self.known
