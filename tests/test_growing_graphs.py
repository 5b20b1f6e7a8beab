import heapq

import numpy as np
import pytest

from scanweave.functions import geometry as g, simulate
from scanweave.operators import visits
from scanweave.operators.constrained import Constrained, Penalty
from scanweave.operators.incremental import Incremental
from scanweave.operators.solver import Options, Problem, _dogleg, Blocks, solve_levels
from test_solver import FAC, VAR, graph


def test_pose_stays_on_a_circle(spark):
    """The point of a circle next to a wanted pose is on the ray towards it."""
    v = spark.createDataFrame([(0, "se2", "active", [0.9, 0.1, 0.3])], VAR)
    f = spark.createDataFrame([(0, "se2_prior", [0], [0.9, 1.2, 0.2], []), (1, "se2_circle_constraint", [0], [1.0], [])], FAC)
    p = Constrained(v, f, Options(iterations=25, damping=0.5, criterion="step_violation", epsilon=1e-5, epsilon_violation=1e-5), Penalty(base=10.0, low=10.0))
    got = np.array(p.solve().first().estimate)
    assert np.abs(got - [0.6, 0.8, 0.2]).max() < 1e-4 and len(p.history) < 25 and p.history[-1]["violation"] <= 1e-5


@pytest.mark.parametrize("wanted, expected", [([0.5, 0.0], 2.0), ([5.0, 0.0], 5.0)])
def test_range_constraint_holds_only_where_it_is_broken(spark, wanted, expected):
    v = spark.createDataFrame([(0, "se2", "fixed", [0.0, 0.0, 0.0]), (1, "point2", "active", [1.0, 0.1])], VAR)
    f = spark.createDataFrame([(0, "se2_pose_point", [0, 1], wanted, []), (1, "se2_range_constraint", [0, 1], [2.0], [])], FAC)
    p = Constrained(v, f, Options(iterations=15, damping=0.0), Penalty(base=5.0, low=5.0, release=True))
    got = {r.variable_id: r.estimate for r in p.solve().collect()}
    assert abs(np.linalg.norm(got[1]) - expected) < 1e-2 and abs(got[1][1]) < 3e-2


@pytest.mark.parametrize("criterion", ["chi", "step", "gradient"])
def test_criteria_stop_at_the_solution(spark, criterion):
    x, v, f = graph(spark)
    p = Problem(v, f, Options("gn", iterations=15, damping=1e-9, criterion=criterion, epsilon=1e-4))
    p.solve()
    assert 1 < len(p.history) < 15 and p.history[-1]["after"] < 1e-6
    assert all(h["n_inliers"] == 23 and h["n_outliers"] == 0 for h in p.history)


def test_double_dogleg(spark):
    x, v, f = graph(spark)
    p = Problem(v, f, Options("double_dogleg", iterations=15, radius=0.5))
    got = {r.variable_id: np.array(r.estimate).reshape(4, 4) for r in p.solve().collect()}
    assert max(np.abs(got[i] - x[i]).max() for i in range(len(x))) < 1e-5
    h, b = Blocks({0: slice(0, 2)}, 2), np.array([1.0, 2.0])
    h.add(0, 0, np.diag([1.0, 10.0]))
    newton = h.factor(np.zeros(2))(b)
    for radius in (0.05, 0.3, 0.6, 0.9, 5.0):
        step = _dogleg(h, b, newton, radius, True)
        assert abs(np.linalg.norm(step) - min(radius, np.linalg.norm(newton))) < 1e-9 and step @ (2 * b - h.times(step)) > 0


def test_levels_are_solved_from_the_highest(spark):
    from pyspark.sql import functions as F

    x, v, f = graph(spark)
    levelled = f.withColumn("level", F.when(F.col("factor_id") < 11, 1).otherwise(0))
    got, history = solve_levels(v, levelled, {0: Options("gn", iterations=8), 1: Options("gn", iterations=8)})
    assert list(history) == [1, 0] and history[0][0]["before"] < 1e-6  # the chain of level 1 puts every pose where it belongs
    assert max(np.abs(np.array(r.estimate).reshape(4, 4) - x[r.variable_id]).max() for r in got.collect()) < 1e-5


def test_graph_that_grows_by_epochs(spark):
    from pyspark.sql import functions as F

    truth = simulate.manhattan(16)
    v, f = simulate.pose_graph(spark, truth, noise=0.0)
    v = v.withColumn("status", F.lit("active"))
    wrong = v.withColumn("estimate", F.when(F.col("variable_id") == 0, F.col("estimate")).otherwise(F.lit(None).cast("array<double>")))
    epochs = f.select("factor_id", F.ceil(F.array_max("variables") / 4).alias("epoch"))
    s = Incremental(wrong, f, epochs, global_step=3, local=Options("gn", iterations=2), overall=Options("gn", iterations=2))
    got = {r.variable_id: np.array(r.estimate).reshape(4, 4) for r in s.run().collect()}
    assert len(got) == 16 and max(np.abs(got[i] - truth[i]).max() for i in got) < 1e-6
    assert [h["scope"] for h in s.history] == ["local", "local", "global", "local", "final"]
    assert s.history[3]["variables"] < 16 and s.history[-1]["variables"] == 16


def test_visits_equal_dijkstra(spark):
    rng = np.random.default_rng(4)
    rows = [(k, str(k % 3), int(v), p) for k in range(120) for p, v in enumerate(rng.choice(50, 3, replace=False))]
    edges = spark.createDataFrame(rows, "factor_id long, type string, variable_id long, position int")
    policies = [("0", 0, None, 2.0), ("1", None, 2, 0.5), (None, 0, 1, 3.0), ("0", 2, 1, -1.0)]
    arcs = visits.arcs(edges, visits.policy_cost(policies), spark.createDataFrame([(7,), (9,)], "variable_id long"))
    ways = [(r.factor_id, r.source, r.target, r.cost) for r in arcs.collect()]
    wanted = []
    for k in range(120):
        own = [(p, v) for f, _, v, p in rows if f == k]
        for p, a in own:
            for q, b in own:
                fit = [c for t, s, e, c in policies if c > 0 and t in (None, str(k % 3)) and s in (None, p) and e in (None, q)]
                if a != b and not {a, b} & {7, 9} and fit:
                    wanted.append((k, a, b, fit[0]))
    assert sorted(ways) == sorted(wanted)
    best, heap = {1: 0.0}, [(0.0, 1)]
    while heap:
        d, a = heapq.heappop(heap)
        for _, s, t, c in ways:
            if s == a and d + c <= 6 and d + c < best.get(t, 1e9):
                best[t] = d + c
                heapq.heappush(heap, (d + c, t))
    visited = visits.cheapest(arcs, spark.createDataFrame([(1,)], "variable_id long"), 6.0)
    assert {r.variable_id: r.cost for r in visited.collect()} == best
    for r in visits.parents(visited, arcs).collect():
        assert r.n_visits == sum(t == r.variable_id and s in best for _, s, t, _ in ways)
        if r.cost > 0:
            assert (r.factor_id, r.parent) == min((f, s) for f, s, t, c in ways if t == r.variable_id and best.get(s, 1e9) + c == r.cost)
    nothing = visits.statistics(visits.parents(visits.cheapest(arcs, spark.createDataFrame([], "variable_id long")), arcs)).first()
    assert tuple(nothing) == (0, 0.0, 0.0)


def test_constants_end_ways_and_join_no_parts(spark):
    path = [(i, i + 1) for i in range(10)]
    arcs = spark.createDataFrame([(a, b, 1.0) for x in path for a, b in (x, x[::-1])], "source long, target long, cost double")
    closures = spark.createDataFrame([(0, 1, 8)], "closure_id long, a long, b long")
    parts = lambda held, reach: {r.variable_id: r.part for r in visits.closure_partitions(arcs, closures, reach, held).collect()}
    assert set(parts(None, 5.0).values()) == {0} and set(parts(None, 3.5).values()) == {0, 5}
    held = spark.createDataFrame([(4,)], "variable_id long")
    assert parts(held, 50.0) == {i: 0 if i < 4 else 5 for i in range(11) if i != 4}
