"""Registered queries of the tree, association, solver and grid operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from scanweave.functions import geometry, poses
from scanweave.operators import adjust, associate, cloud, closures, dissect, grids, register, solver, spread, tracks, tree, two_view
from scanweave.plans import views
from scanweave.plans.catalog import _CELLS, _cells, query, rounded
from scanweave.plans.views import NRM, PTS
from scanweave.sources.tables import keep


@query()
def surfel_tree(spark, sf_dir):
    return tree.leaves(views.points(spark, sf_dir), 0.2, 0.1)


@query()
def data_association(spark, sf_dir):
    p = views.points(spark, sf_dir)
    return associate.match(tree.nodes(p, 0.2, 0.1), tree.leaves(p, 0.2, 0.1), associate.Gates(0.5, 1.0, 30.0))


@query()
def surfel_merge(spark, sf_dir):
    p = views.points(spark, sf_dir)
    gates = associate.Gates(0.5, 1.0, 30.0)
    leaves = tree.leaves(p, 0.2, 0.1)
    return associate.merge(associate.match(tree.nodes(p, 0.2, 0.1), leaves, gates), leaves, gates)


def _walls(spark, sf_dir, poses_: np.ndarray):
    """Line items as points on the walls of a room of 4 x 5 x 3 metres, as four poses that turn about z see them."""
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    u, v = ((k * m) % 9973 / 9973 for m in (7919, 6151))
    wall, noise = F.col("l_partkey") % 6, (F.round(F.col("l_extendedprice") * 100).cast("long") % 101 - 50) / 5000
    size = (4.0, 5.0, 3.0)
    axis, end = F.floor(wall / 2), wall % 2
    place = [F.when(axis == 0, end * size[0] + noise).otherwise(u * size[0]), F.when(axis == 1, end * size[1] + noise).when(axis == 0, u * size[1]).otherwise(v * size[1]), F.when(axis == 2, end * size[2] + noise).otherwise(v * size[2])]
    table = views.table(spark, sf_dir, "lineitem").select(((F.col("l_suppkey") % 4).cast("int")).alias("scan_id"), (k * 4096 + F.col("l_partkey") % 4096).alias("point_id"), *[c.alias(n) for c, n in zip(place, "xyz", strict=True)])
    at = lambda i, j: F.element_at(F.array(*[F.lit(float(p[i, j])) for p in poses_]), F.col("scan_id") + 1)
    d = [F.col(c) - at(i, 3) for i, c in enumerate("xyz")]
    return table.select("scan_id", "point_id", *[(at(0, i) * d[0] + at(1, i) * d[1] + at(2, i) * d[2]).alias(n) for i, n in enumerate("xyz")])


@query("select i as pose_id, round(1 + 0.2 * i, 1)::double as tx, round(1 + 0.3 * i, 1)::double as ty, 1.0::double as tz, 0.0::double as qx, 0.0::double as qy, round(sin(0.02 * i), 1) + 0.0 as qz, 1.0::double as qw from range(4) r(i) where (select count(*) from lineitem) > 0")
def bundle_adjust(spark, sf_dir):
    """A room whose wall points are the line items, seen from four poses that start beside the truth."""
    truth = geometry.v2t(np.array([[1.0 + 0.2 * i, 1.0 + 0.3 * i, 1.0, 0.0, 0.0, 0.02 * i] for i in range(4)]))
    start = truth @ geometry.v2t(np.array([[0.0] * 6, [0.05, -0.04, 0.03, 0.004, 0.0, -0.003], [-0.05, 0.02, 0.04, 0.0, 0.005, 0.002], [0.03, 0.05, -0.04, -0.003, 0.002, 0.004]]))
    config = adjust.Config(iterations=2, leaf_size=1.0, gates=associate.Gates(0.5, 0.3, 5.0))
    found, _ = adjust.adjust(_walls(spark, sf_dir, truth), start, config)
    rows = [(i, *map(float, x[:3, 3]), *map(float, geometry.matrix_to_quaternion(x[:3, :3]))) for i, x in enumerate(found)]
    out = spark.createDataFrame(rows, "pose_id long, tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    return rounded(out, dict.fromkeys(out.columns[1:], 1))


def _customers(spark, sf_dir):
    """Customers as poses in the plane on a spiral, coupled to the next one and to one 97 places on."""
    c, k = views.table(spark, sf_dir, "customer"), F.col("c_custkey")
    at = lambda v: (F.sqrt(v) * F.cos(F.sqrt(v) / 3), F.sqrt(v) * F.sin(F.sqrt(v) / 3), (v % 60) * F.lit(0.1) - 3)
    truth = c.select(k.alias("variable_id"), F.array(*at(k)).alias("truth"), "c_acctbal")
    off = lambda m: ((k * m) % 101 - 50) / 1000
    start = F.array(*[F.col("truth")[i] + F.when(k > 1, o).otherwise(F.lit(0.0)) for i, o in enumerate((off(7), off(13), off(29)))])
    variables = truth.withColumn("c_custkey", F.col("variable_id")).select("variable_id", F.lit("se2").alias("type"), F.when(F.col("variable_id") == 1, "fixed").otherwise("active").alias("status"), start.alias("estimate"))
    pairs = truth.select(F.col("variable_id").alias("a"), F.explode(F.array(F.lit(1), F.lit(97))).alias("far")).withColumn("b", F.col("a") + F.col("far"))
    both = pairs.join(truth.select(F.col("variable_id").alias("a"), F.col("truth").alias("p")), "a").join(truth.select(F.col("variable_id").alias("b"), F.col("truth").alias("q")), "b")
    p, q = F.col("p"), F.col("q")
    x, y, cos, sin = q[0] - p[0], q[1] - p[1], F.cos(p[2]), F.sin(p[2])
    measured = F.array(cos * x + sin * y, cos * y - sin * x, q[2] - p[2])
    factors = both.select((F.col("a") * 2 + (F.col("far") > 1).cast("long")).alias("factor_id"), F.lit("se2_pose_pose").alias("type"), F.array("a", "b").alias("variables"), measured.alias("measurement"), F.array(*[F.lit(v) for v in (4.0, 0.0, 0.0, 4.0, 0.0, 9.0)]).alias("information"))
    return variables, factors


_SPIRAL = "select c_custkey as variable_id, round(sqrt(c_custkey) * cos(sqrt(c_custkey) / 3), 4) + 0.0 as x, round(sqrt(c_custkey) * sin(sqrt(c_custkey) / 3), 4) + 0.0 as y, round(sin((c_custkey % 60) * 0.1::double - 3), 4) + 0.0 as sin_a from customer"


@query(_SPIRAL)
def lm_solve(spark, sf_dir):
    """Poses of customers from a start beside the truth; measurements agree, so that the truth is the solution. Damping slows long
    bends of the graph, more so the larger it is, so the steps end when they move nothing, not after a number of them."""
    variables, factors = _customers(spark, sf_dir)
    found = dissect.least_squares(variables, factors, solver.Options("lm", min_step=1e-6))
    e = F.col("estimate")
    return rounded(found.select("variable_id", e[0].alias("x"), e[1].alias("y"), F.sin(e[2]).alias("sin_a")), {"x": 4, "y": 4, "sin_a": 4})


@query("""with p as (select c_custkey as k, sqrt(c_custkey) * cos(sqrt(c_custkey) / 3) as x, sqrt(c_custkey) * sin(sqrt(c_custkey) / 3) as y, (c_custkey % 60) * 0.1::double - 3 as a from customer),
 c as (select a.k, a.k // 50 as p, b.k // 50 as q, a.x as ax, a.y as ay, a.a as aa, b.x as bx, b.y as byy, b.a as ba, cos(a.a) * (b.x - a.x) + sin(a.a) * (b.y - a.y) + case when a.k % 9 = 0 then 5 else 0 end as zx, cos(a.a) * (b.y - a.y) - sin(a.a) * (b.x - a.x) as zy, b.a - a.a + case when a.k % 9 = 0 then 0.3::double else 0 end as za from p a join p b on b.k = a.k + 97),
 t as (select *, aa + za - ba as ta from c), m as (select *, ax + cos(aa) * zx - sin(aa) * zy - cos(ta) * bx + sin(ta) * byy as tx, ay + sin(aa) * zx + cos(aa) * zy - sin(ta) * bx - cos(ta) * byy as ty from t),
 d as (select g.k, g.p, g.q, g.zx, g.zy, g.aa, cos(f.ta) * g.bx - sin(f.ta) * g.byy + f.tx - g.ax as dx, sin(f.ta) * g.bx + cos(f.ta) * g.byy + f.ty - g.ay as dy, g.ba + f.ta - g.aa - g.za as turn from m f join m g on f.p = g.p and f.q = g.q),
 v as (select k, p, q, count(*) as n_checks, count(*) filter (pow(cos(aa) * dx + sin(aa) * dy - zx, 2) + pow(cos(aa) * dy - sin(aa) * dx - zy, 2) + 4 * pow(sin(turn / 2), 2) < 0.05) as n_good from d group by 1, 2, 3)
 select k as closure_id, p, q, n_checks, n_good, case when n_checks >= 5 and n_good / n_checks > 0.5 then 'accepted' when n_checks >= 5 and n_good / n_checks < 0.3 then 'rejected' else 'open' end as status from v""")
def closure_votes(spark, sf_dir):
    """Customers on a spiral in maps of fifty; each has a closure with the one 97 places on, a ninth of them false."""
    k = F.col("c_custkey")
    c = views.table(spark, sf_dir, "customer").select(k.alias("id"), (F.sqrt(k) * F.cos(F.sqrt(k) / 3)).alias("x"), (F.sqrt(k) * F.sin(F.sqrt(k) / 3)).alias("y"), ((k % 60) * F.lit(0.1) - 3).alias("a"))
    v = c.select("id", poses.struct((F.col("x"), F.col("y"), F.lit(0.0), *poses.yaw(F.col("a")))).alias("pose"))
    side = lambda s: v.select(F.col("id").alias(s), F.col("pose").alias(f"{s}_pose"))
    wrong = F.col("a") % 9 == 0
    both = v.select(F.col("id").alias("a"), (F.col("id") + 97).alias("b")).join(side("a"), "a").join(side("b"), "b")
    true = poses.struct(poses.between(poses.of(F.col("a_pose")), poses.of(F.col("b_pose"))))
    # a false one adds a shift and a turn to the true step
    both = both.withColumn("true", true)
    t = poses.of(F.col("true"))
    turned = poses.multiply(t[3:], poses.yaw(F.when(wrong, F.lit(0.3)).otherwise(F.lit(0.0))))
    step = poses.struct((t[0] + F.when(wrong, F.lit(5.0)).otherwise(F.lit(0.0)), t[1], t[2], *turned))
    parts = v.select(F.col("id").alias("variable_id"), F.expr("id div 50").alias("part"))
    statuses, _ = closures.validate(v, both.select(F.col("a").alias("closure_id"), "a", "b", step.alias("step")), parts)
    return statuses.select("closure_id", "p", "q", "n_checks", "n_good", "status")


@query("select c_custkey as customer, round(c_acctbal, 3) + 0.0 as x, round(c_acctbal / 2, 3) + 0.0 as y from customer")
def sparse_solve(spark, sf_dir):
    """A linear system over customers, two unknowns each, with couplings to the next one, to one 50 places on and to the first of
    100: the right side is the matrix times balances, so that the solution is the balances."""
    c = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), F.array("c_acctbal", F.col("c_acctbal") / 2).alias("v"))
    pairs = c.select("i", F.explode(F.array(F.col("i") + 1, F.col("i") + 50, F.col("i") - F.col("i") % 100 + 100)).alias("j")).where("i != j").join(c.select(F.col("i").alias("j")), "j").select("i", "j").distinct()
    # a block [[2, 1], [1, 3]] in the corner of each pair, its negative across, and the identity
    pairs = keep(pairs, "sparse-pairs")
    degree = pairs.select("i").unionAll(pairs.select(F.col("j").alias("i"))).groupBy("i").count()
    diagonal = c.join(degree, "i", "left").select("i", F.coalesce("count", F.lit(0)).alias("d"), "v")
    block = lambda d, one: F.array(2.0 * d + one, 1.0 * d, 1.0 * d, 3.0 * d + one)
    d = keep(diagonal.select("i", F.col("i").alias("j"), block(F.col("d"), 1.0).alias("h"), "v"), "sparse-diagonal")
    across = pairs.select("i", "j", block(F.lit(-1.0), 0.0).alias("h"))
    both = d.select("i", "j", "h").unionByName(across).unionByName(across.select(F.col("j").alias("i"), F.col("i").alias("j"), "h"))  # symmetric blocks
    h, v = F.col("h"), F.col("w")
    right = both.join(c.select(F.col("i").alias("j"), F.col("v").alias("w")), "j").groupBy("i").agg(F.array(F.sum(h[0] * v[0] + h[1] * v[1]), F.sum(h[2] * v[0] + h[3] * v[1])).alias("b"))
    blocks = d.join(right, "i").select("i", "j", "h", "b").unionByName(across.select("i", "j", "h", F.array().cast("array<double>").alias("b")))
    x = F.col("x")
    return rounded(dissect.solve(keep(blocks, "sparse-blocks")).select(F.col("i").alias("customer"), x[0].alias("x"), x[1].alias("y")), {"x": 3, "y": 3})


_TRACK = """s as (select event_id, event_type as run, value / 100 as dx, (event_id % 7 - 3) * 0.01::double as dy, (event_id % 11 - 5) * 0.02::double as turn from events)"""


def _walked(over: str) -> str:
    return f"""h as (select *, sum(turn) over ({over}) as a, sum(turn) over ({over}) - turn as b from s),
 p as (select *, sum(cos(b) * dx - sin(b) * dy) over ({over}) as x, sum(sin(b) * dx + cos(b) * dy) over ({over}) as y from h)"""


def _steps(spark, sf_dir):
    """The log as planar odometry: event_id, run, dx, dy, turn."""
    e = F.col("event_id")
    return views.messages(spark, sf_dir).select("event_id", F.col("topic").alias("run"), (F.col("value") / 100).alias("dx"), ((e % 7 - 3) * F.lit(0.01)).alias("dy"), ((e % 11 - 5) * F.lit(0.02)).alias("turn"))


def _planar(pose: str) -> list:
    p = poses.of(F.col(pose))
    return [p[0].alias("x"), p[1].alias("y"), (2 * p[5] * p[6]).alias("sin_a")]


@query(f"""with {_TRACK}, {_walked('partition by run order by event_id')} select run, event_id, round(x, 4) + 0.0 as x, round(y, 4) + 0.0 as y, round(sin(a), 5) + 0.0 as sin_a from p""")
def odometry_track(spark, sf_dir):
    """The poses that odometry steps add up to, in runs of a fifth of the log each."""
    step = poses.struct((F.col("dx"), F.col("dy"), F.lit(0.0), *poses.yaw(F.col("turn"))))
    track = tracks.running_poses(_steps(spark, sf_dir).select("run", "event_id", step.alias("step")), ["event_id"], ["run"])
    return rounded(track.select("run", "event_id", *_planar("pose")), {"x": 4, "y": 4, "sin_a": 5})


@query(f"""with {_TRACK.replace('from events', 'from events where event_id > 0')}, {_walked('order by event_id')}, v as (select event_id as id, x, y, a from p union all select 0, 0.0::double, 0.0::double, 0.0::double)
 select id, 'pose' as kind, round(x, 4) + 0.0 as x, round(y, 4) + 0.0 as y, round(sin(a), 5) + 0.0 as sin_a from v
 union all select 1000000000 + id, 'point', round(x + cos(a) * 2 - sin(a) * (id % 5), 4) + 0.0, round(y + sin(a) * 2 + cos(a) * (id % 5), 4) + 0.0, 0.0 from v where id % 10 = 0""")
def graph_initialise(spark, sf_dir):
    """The log as a factor graph: a chain of poses from the first event, which is fixed, and a point seen from each tenth pose."""
    s, e = _steps(spark, sf_dir), F.col("event_id")
    start = F.when(e == 0, poses.struct((F.lit(0.0), F.lit(0.0), F.lit(0.0), *poses.yaw(F.lit(0.0)))))
    seen = s.where(e % 10 == 0)
    point = e + 1_000_000_000
    variables = s.select(e.alias("id"), F.lit("pose").alias("kind"), start.alias("estimate"), (e == 0).alias("fixed"))
    variables = variables.unionByName(seen.select(point.alias("id"), F.lit("point").alias("kind"), F.lit(None).cast(poses.STRUCT).alias("estimate"), F.lit(False).alias("fixed")))
    factors = s.where(e > 0).select(e.alias("id"), F.lit("pose_pose").alias("kind"), F.array(e - 1, e).alias("variables"), F.array("dx", "dy", "turn").alias("measurement"))
    factors = factors.unionByName(seen.select(point.alias("id"), F.lit("pose_point").alias("kind"), F.array(e, point).alias("variables"), F.array(F.lit(2.0), (e % 5).cast("double"), F.lit(0.0)).alias("measurement")))
    found = spread.initialise(variables, factors)
    return rounded(found.select("id", "kind", *_planar("estimate")), {"x": 4, "y": 4, "sin_a": 5})


@query("select label::bigint as pair, count(*) as n, 0.05::double as tx, round(0.03::double - 0.01::double * label, 3) + 0.0 as ty, 0.02::double as tz, round(sin(0.002::double * label), 3) + 0.0 as sin_yaw from embeddings group by label")
def cloud_register(spark, sf_dir):
    """The vectors of each label as a cloud, and the same seen from beside it: where that is, from a start where it is not."""
    e, k = F.col("embedding"), F.col("label").cast("long")
    table = views.table(spark, sf_dir, "embeddings").select(k.alias("pair"), F.col("vec_id").alias("point_id"), *[(e[i].cast("double") * 16).alias(c) for i, c in enumerate("xyz")])
    turn = F.lit(0.002) * F.col("pair")
    q = [F.col("x") - 0.05, F.col("y") - (F.lit(0.03) - F.lit(0.01) * F.col("pair")), F.col("z") - 0.02]
    there = table.select("pair", "point_id", (F.cos(turn) * q[0] + F.sin(turn) * q[1]).alias("x"), (F.cos(turn) * q[1] - F.sin(turn) * q[0]).alias("y"), q[2].alias("z"))
    zero = F.lit(0.0)
    start = table.select("pair").distinct().withColumn("pose", poses.struct((zero, zero, zero, zero, zero, zero, F.lit(1.0))))
    found = register.register(table, there, start, 0.4, tolerance=1e-6)
    p = poses.of(F.col("pose"))
    return rounded(found.select("pair", "n", p[0].alias("tx"), p[1].alias("ty"), p[2].alias("tz"), (2 * p[5] * p[6]).alias("sin_yaw")), dict.fromkeys(("tx", "ty", "tz", "sin_yaw"), 3))


@query("""with t as (select label as pair, count(*) as n_points, 0.05::double + 0.02::double * label as yaw, 0.3::double as x, 0.4::double - 0.1::double * label as y, 0.5::double as z from embeddings group by label)
 select pair, n_points, round(cos(yaw), 2) + 0.0 as cos_yaw, round(sin(yaw), 2) + 0.0 as sin_yaw, round(x / sqrt(x * x + y * y + z * z), 2) + 0.0 as tx, round(y / sqrt(x * x + y * y + z * z), 2) + 0.0 as ty, round(z / sqrt(x * x + y * y + z * z), 2) + 0.0 as tz, true as all_fit from t""")
def essential_ransac(spark, sf_dir):
    """Vectors as points that two views of each label see, a fifth of them mistaken in the second: the second view's pose."""
    e, k = F.col("embedding"), F.col("label")
    p = [e[0].cast("double") * 16, e[1].cast("double") * 16, 6 + 4 * e[2].cast("double")]
    yaw = F.lit(0.05) + F.lit(0.02) * k
    q = [p[0] - 0.3, p[1] - (F.lit(0.4) - F.lit(0.1) * k), p[2] - 0.5]
    there = [F.cos(yaw) * q[0] + F.sin(yaw) * q[1], F.cos(yaw) * q[1] - F.sin(yaw) * q[0], q[2]]
    seen = [F.when(F.col("vec_id") % 5 == 0, e[3 + i].cast("double")).otherwise(c) for i, c in enumerate(there)]
    unit = lambda v: F.transform(F.array(*v), lambda c: c / F.sqrt(sum(x * x for x in v)))
    table = views.table(spark, sf_dir, "embeddings")
    rows = table.select(k.alias("pair"), F.col("vec_id").alias("point"), unit(p).alias("a"), unit(seen).alias("b"))
    good = table.groupBy(k.alias("pair")).agg(F.count(F.when(F.col("vec_id") % 5 != 0, 1)).alias("n_good"))
    m = F.col("model")
    found = two_view.ransac(rows, rounds=300, threshold=1e-4).join(good, "pair").select("pair", "n_points", m[0].alias("cos_yaw"), m[4].alias("sin_yaw"), m[3].alias("tx"), m[7].alias("ty"), m[11].alias("tz"), (F.col("n_inliers") >= F.col("n_good")).alias("all_fit"))
    return rounded(found, dict.fromkeys(("cos_yaw", "sin_yaw", "tx", "ty", "tz"), 2))


@query(f"""with {_CELLS}, o as (select image, "row", col from cells where v > (select 1.2 * avg(v) from cells)),
 recursive_labels as (select * from (with recursive r as (select image, "row", col, "row" as r0, col as c0 from o union select o.image, o."row", o.col, r.r0, r.c0 from r join o on o.image = r.image and abs(o."row" - r."row") <= 1 and abs(o.col - r.col) <= 1) select image, "row", col, min(r0 * 4294967296 + c0) as component from r group by 1, 2, 3))
 select image, cast(component as bigint) as component, count(*) as n_cells, min("row") as min_row, max("row") as max_row, round(avg("row"), 6) as mean_row, min(col) as min_col, max(col) as max_col, round(avg(col), 6) as mean_col from recursive_labels group by 1, 2""")
def grid_components(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    high = cells.agg((1.2 * F.avg("v")).alias("_high"))
    occupied = cells.join(F.broadcast(high), F.expr("v > _high")).select("image", "row", "col")
    return rounded(grids.cluster_statistics(grids.components(occupied)), {"mean_row": 6, "mean_col": 6})


@query()
def grid_paths(spark, sf_dir):
    cells = _cells(spark, sf_dir).withColumn("cost", 1 + F.col("v") % 7)
    return grids.cheapest(cells.select("image", "row", "col", "cost"), cells.where("`row` = 4 and col = 4"))


@query(f"""with {_CELLS}, q as (select image, image * 64 + "row" * 8 + col as query_id, "row" as r0, col as c0 from cells)
 select query_id, case when count(v) = 4 then round(sum(v * cast(abs(1 - (cells."row" - r0) - 0.25) * abs(1 - (cells.col - c0) - 0.5) as double)), 3) end as v from q left join cells on cells.image = q.image and cells."row" - r0 in (0, 1) and cells.col - c0 in (0, 1) group by query_id""")
def bilinear(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    q = cells.select((F.col("image") * 64 + F.col("row") * 8 + F.col("col")).alias("query_id"), "image", (F.col("row") + 0.25).alias("r"), (F.col("col") + 0.5).alias("c"))
    return rounded(grids.bilinear(cells, q, "v"), {"v": 3})


@query(f"""with {_CELLS} select image, max(v) as largest, min(v) as smallest, arg_min("row" * 100 + col, (-v, "row", col)) as largest_at, arg_min("row" * 100 + col, (v, "row", col)) as smallest_at from cells group by image""")
def image_extremes(spark, sf_dir):
    at = lambda c: (F.col(f"{c}.row") * 100 + F.col(f"{c}.col")).alias(c)
    return grids.extremes(_cells(spark, sf_dir), "v").select("image", "largest", "smallest", at("largest_at"), at("smallest_at"))


@query("""with l as (select n_nationkey as line_id, n_nationkey % 5 as r0, 0 as c0, n_regionkey * 3 as r1, n_nationkey as c1 from nation), n as (select *, greatest(abs(r1 - r0), abs(c1 - c0)) as n from l), k as (select *, unnest(range(0, n + 1)) as k from n)
 select line_id, cast(k as integer) as k, cast(floor(r0 + case when n = 0 then 0.0::double else k * (r1 - r0) / n::double end + 0.5) as integer) as "row", cast(floor(c0 + case when n = 0 then 0.0::double else k * (c1 - c0) / n::double end + 0.5) as integer) as col from k""")
def line_traversal(spark, sf_dir):
    n = views.table(spark, sf_dir, "nation")
    return grids.line_cells(n.selectExpr("n_nationkey as line_id", "n_nationkey % 5 as r0", "0 as c0", "n_regionkey * 3 as r1", "n_nationkey as c1"))


@query("""with c as (select l_suppkey as closure_id, count(*) as n_checks, count(*) filter (l_discount < 0.05) as n_good from lineitem group by 1)
 select closure_id, n_checks, n_good, case when n_checks >= 5 and n_good / n_checks > 0.5 then 'accepted' when n_checks >= 5 and n_good / n_checks < 0.45 then 'rejected' else 'open' end as status from c""")
def loop_validate(spark, sf_dir):
    checks = views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("closure_id"), F.col("l_discount").alias("chi"))
    return grids.validate_closures(checks, reject=0.45)


@query("""with e as (select o_orderkey as closure_id, o_custkey % 4 as p from orders union select o_orderkey, o_orderkey % 3 from orders), s as (select closure_id, string_agg(cast(p as varchar), ',' order by p) as parts from e group by 1)
 select parts, count(*) as n_closures, min(closure_id) as first_closure from s group by parts""")
def closure_clusters(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    closures = o.select(F.col("o_orderkey").alias("closure_id"), (F.col("o_custkey") % 4).alias("a"), (F.col("o_orderkey") % 3).alias("b"))
    parts = spark.range(4).select(F.col("id").alias("variable_id"), F.col("id").alias("part"))
    out = grids.cluster_closures(closures, parts)
    return out.select(F.array_join(F.col("parts").cast("array<string>"), ",").alias("parts"), "n_closures", "first_closure")


@query(f"""with {PTS}, p as (select scan_id, point_id, x, y, z + 1.0 as z from pts), q as (select *, floor(80.0 * x / z + 16.0) as col, floor(80.0 * y / z + 12.0) as "row" from p where z > 0)
 select scan_id, cast("row" as integer) as "row", cast(col as integer) as col, count(*) as n, round(min(z), 6) as depth from q where "row" between 0 and 23 and col between 0 and 31 group by 1, 2, 3""")
def pinhole_projection(spark, sf_dir):
    p = views.points(spark, sf_dir).withColumn("z", F.col("z") + 1.0)
    out = cloud.project_pinhole(p, 80.0, 80.0, 16.0, 12.0, 24, 32)
    return rounded(out.groupBy("scan_id", "row", "col").agg(F.count("*").alias("n"), F.min("depth").alias("depth")), {"depth": 6})


@query(f"""with {NRM} select obs_id, round(0.36 * nx + 0.48 * ny - 0.8 * nz, 6) + 0.0 as nx, round(-0.8 * nx + 0.6 * ny, 6) + 0.0 as ny, round(0.48 * nx + 0.64 * ny + 0.6 * nz, 6) + 0.0 as nz from nrm""")
def rotate_normals(spark, sf_dir):
    turned = cloud.transform(views.normals(spark, sf_dir), [0.36, 0.48, -0.8, 0.0, -0.8, 0.6, 0.0, 0.0, 0.48, 0.64, 0.6, 0.0], ("nx", "ny", "nz"))
    return rounded(turned.select("obs_id", "nx", "ny", "nz"), dict.fromkeys(("nx", "ny", "nz"), 6))

