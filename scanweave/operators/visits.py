"""Visits of a factor graph by cost: cheapest ways over factors, what they say about the graph, and partitions around closures.

Edges are (factor_id, type, variable_id, position). An arc leads from one variable of a factor to another; its cost is set by
policies over the factor's type and the two positions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.operators.graph import connected
from scanweave.sources.tables import keep

#: Tables of improvements that are kept apart.
TABLES = 8


def policy_cost(policies: list[tuple[str | None, int | None, int | None, float]]) -> Column:
    """The cost of an arc (type, from, to): that of the first policy that fits and is positive; null, which closes the arc, if
    there is none. None in a policy fits anything."""
    cost = F.lit(None).cast("double")
    for kind, start, end, value in reversed(policies):
        if value > 0:
            fits = F.lit(True)
            for name, wanted in (("type", kind), ("from", start), ("to", end)):
                fits = fits & (F.col(name) == F.lit(wanted)) if wanted is not None else fits
            cost = F.when(fits, F.lit(float(value))).otherwise(cost)
    return cost


def arcs(edges: DataFrame, cost: Column, tainted: DataFrame | None = None) -> DataFrame:
    """(factor_id, source, target, cost): the ordered pairs of variables of each factor that the cost leaves open and that
    touch no tainted variable (variable_id). A factor's few variables are paired, never a variable's many factors."""
    members = edges.groupBy("factor_id", "type").agg(F.collect_list(F.struct("position", "variable_id")).alias("members"))
    return arcs_of(members, cost, tainted)


def arcs_of(factors: DataFrame, cost: Column, tainted: DataFrame | None = None) -> DataFrame:
    """The arcs of factors that hold their variables: (factor_id, type, members), an array of (position, variable_id)."""
    pairs = factors.withColumn("_a", F.explode("members")).withColumn("_b", F.explode("members"))
    pairs = pairs.select("factor_id", "type", F.col("_a.position").alias("from"), F.col("_b.position").alias("to"), F.col("_a.variable_id").alias("source"), F.col("_b.variable_id").alias("target"))
    pairs = pairs.where("source != target").withColumn("cost", cost).where("cost is not null").select("factor_id", "source", "target", "cost")
    if tainted is not None:
        tainted = tainted.select("variable_id").distinct()
        for end in ("source", "target"):
            pairs = pairs.join(tainted.withColumnRenamed("variable_id", end), end, "left_anti")
    return pairs.select("factor_id", "source", "target", "cost")


def cheapest(arcs: DataFrame, sources: DataFrame, max_cost: float = 0.0, below: bool = False, keys: list[str] = ()) -> DataFrame:
    """(keys, variable_id, cost) of all variables that a way from a source reaches; sources (keys, variable_id) cost nothing.

    With a positive max_cost, ways that cost more are not taken; nor, with `below`, those that cost just as much. A round takes two
    steps from what the round before improved and appends only what is better than all before, so there are half as many
    rounds as the longest cheapest way has arcs. What is best is the minimum over the appended tables, which are put together every
    TABLES rounds; nothing is collected. Both steps are written, so that their size is known and a small one goes to the arcs instead
    of the arcs to it.
    """
    keys = list(keys)
    own = [*keys, "variable_id"]
    arcs = keep(arcs.select("source", F.col("target").alias("variable_id"), F.col("cost").alias("_step")), "visit-arcs")
    frontier = keep(sources.select(*own).distinct().withColumn("cost", F.lit(0.0)), "visit")
    tables = [frontier]

    def known() -> DataFrame:
        return reduce(DataFrame.unionByName, tables).groupBy(*own).agg(F.min("cost").alias("cost")) if len(tables) > 1 else tables[0]

    def step(start: DataFrame) -> DataFrame:
        offers = arcs.join(start.withColumnRenamed("variable_id", "source"), "source").withColumn("cost", F.col("cost") + F.col("_step"))
        if max_cost > 0:
            offers = offers.where(F.col("cost") < max_cost if below else F.col("cost") <= max_cost)
        return offers.groupBy(*own).agg(F.min("cost").alias("cost"))

    def better(offers: DataFrame) -> DataFrame:
        return offers.join(known().withColumnRenamed("cost", "_was"), own, "left").where("_was is null or cost < _was").drop("_was")

    while True:
        one = keep(better(step(frontier)), "visit")
        both = one.withColumn("hop", F.lit(1)).unionByName(step(one).withColumn("hop", F.lit(2))).groupBy(*own).agg(F.min(F.struct("cost", "hop")).alias("_new"))
        new = keep(better(both.select(*own, "_new.cost", "_new.hop")), "visit")
        if not new.limit(1).count():
            return tables[0] if len(tables) == 1 else keep(known(), "visit")
        tables.append(new.drop("hop"))
        frontier = new.where("hop = 2").drop("hop")  # from what the first step improved the second has gone on
        if len(tables) > TABLES:
            tables = [keep(known(), "visit")]


def parents(visited: DataFrame, arcs: DataFrame) -> DataFrame:
    """visited (variable_id, cost) with n_visits, the open arcs that reach a variable from visited ones, and with the factor_id
    and parent of its cheapest way: of equal ways that of the smallest factor, null at a source."""
    near = arcs.withColumnRenamed("cost", "_step").join(visited.select(F.col("variable_id").alias("source"), F.col("cost").alias("_from")), "source")
    near = near.join(visited.select(F.col("variable_id").alias("target"), "cost"), "target")
    by = F.when((F.col("_from") + F.col("_step") == F.col("cost")) & (F.col("cost") > 0), F.struct("factor_id", "source"))
    found = near.groupBy(F.col("target").alias("variable_id")).agg(F.count("*").alias("n_visits"), F.min(by).alias("_by"))
    joined = visited.join(found, "variable_id", "left")
    return joined.select("variable_id", "cost", F.coalesce("n_visits", F.lit(0)).alias("n_visits"), F.col("_by.factor_id").alias("factor_id"), F.col("_by.source").alias("parent"))


def statistics(visited: DataFrame) -> DataFrame:
    """One row: the number of variables with a visit (n_visits), and their average and largest cost, 0 if there are none."""
    seen = visited.where("n_visits > 0")
    return seen.agg(F.count("*").alias("n_variables"), F.coalesce(F.avg("cost"), F.lit(0.0)).alias("average_cost"), F.coalesce(F.max("cost"), F.lit(0.0)).alias("max_cost"))


def best_neighbour(visited: DataFrame, arcs: DataFrame) -> DataFrame:
    """(variable_id, best): the smallest cost among the visited neighbours of each variable."""
    near = arcs.select(F.col("target").alias("_of"), F.col("source").alias("variable_id")).join(visited.select("variable_id", "cost"), "variable_id")
    return near.groupBy(F.col("_of").alias("variable_id")).agg(F.min("cost").alias("best"))


def closure_partitions(arcs: DataFrame, closures: DataFrame, reach: float, constants: DataFrame | None = None) -> DataFrame:
    """(variable_id, part): the graph around the ends of closures, cut into parts; a part is named by its smallest variable.

    Ways lead from each end over arcs that are no closures, as far as they cost less than `reach`; ends whose surroundings
    share a variable are one part. Constants end a way and join no parts. closures has (closure_id, a, b).
    """
    ends = closures.select(F.explode(F.array("a", "b")).alias("variable_id")).distinct()
    if constants is not None:
        held = constants.select("variable_id").distinct()
        ends = ends.join(held, "variable_id", "left_anti")
        for side in ("source", "target"):
            arcs = arcs.join(held.withColumnRenamed("variable_id", side), side, "left_anti")
    around = cheapest(arcs, ends.withColumn("_root", F.col("variable_id")), reach, True, ["_root"])
    return connected(around.select(F.col("_root").alias("factor_id"), "variable_id")).select("variable_id", F.col("component").alias("part"))
