"""Registered queries of trajectories, transforms and normals: evaluation, pose lookup, organised clouds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scanweave.functions import poses
from scanweave.operators import associate, cloud, evaluate, grids, normals, prefix
from scanweave.plans import views
from scanweave.plans.catalog import _cells, bucket, query, rounded
from scanweave.plans.views import MSGS, PTS, RANGES
from scanweave.sources import formats

# trajectories: planar, so that SQL can say the same with angles

_PATH = """path as (select user_id as run, row_number() over w - 1 as frame, cast(sum(cast(round(value * 100) as bigint)) over w as double) as distance, (event_id % 13)::double as ty, (event_id % 11)::double as ey, (event_id % 100) * 0.01::double as tyaw, (event_id % 90) * 0.01::double as eyaw
  from events window w as (partition by user_id order by event_id)), p as (select *, distance as tx, distance * 1.01::double as ex from path)"""


def _path(spark, sf_dir):
    """One run a frame of the log: true poses and poses that drift from them."""
    m = views.messages(spark, sf_dir).withColumn("v", F.round(F.col("value") * 100).cast("long"))
    placed = prefix.ordinal(m, ["event_id"], bucket(), ["frame"], "place")
    along = F.sum("v").over(Window.partitionBy("frame").orderBy("event_id")).cast("double")
    e, zero = F.col("event_id"), F.lit(0.0)
    p = placed.select(F.col("frame").alias("run"), F.col("place").cast("long").alias("frame"), along.alias("distance"), "event_id")
    truth = poses.struct((F.col("distance"), (e % 13).cast("double"), zero, *poses.yaw((e % 100) * F.lit(0.01))))
    estimate = poses.struct((F.col("distance") * 1.01, (e % 11).cast("double"), zero, *poses.yaw((e % 90) * F.lit(0.01))))
    return p.select("run", "frame", "distance", truth.alias("truth"), estimate.alias("estimate"))


#: The steps of truth and estimate from row a to row b, each in the frame of its start, and the turns.
_STEPS = ", ".join(f"cos(a.{k}yaw) * (b.{k}x - a.{k}x) + sin(a.{k}yaw) * (b.{k}y - a.{k}y) as {k}dx, cos(a.{k}yaw) * (b.{k}y - a.{k}y) - sin(a.{k}yaw) * (b.{k}x - a.{k}x) as {k}dy, b.{k}yaw - a.{k}yaw as {k}turn" for k in "te")


@query(f"""with {_PATH}, s as (select run, frame as first, distance + length as goal, length from p cross join (select unnest([5000.0::double, 10000.0::double]) as length) where frame % 10 = 0),
 l as (select s.run, first, length, min(p.frame) as last from s join p on p.run = s.run and p.distance > s.goal group by 1, 2, 3),
 d as (select l.*, {_STEPS} from l join p a on a.run = l.run and a.frame = l.first join p b on b.run = l.run and b.frame = l.last)
 select run, first, length, last, round(abs(atan2(sin(tturn - eturn), cos(tturn - eturn))) / length, 9) + 0.0 as rotation_error, round(sqrt((tdx - edx) * (tdx - edx) + (tdy - edy) * (tdy - edy)) / length, 6) + 0.0 as translation_error from d""")
def segment_pose_errors(spark, sf_dir):
    return rounded(evaluate.segment_errors(_path(spark, sf_dir), [5000.0, 10000.0]), {"rotation_error": 9, "translation_error": 6})


@query(f"""with {_PATH}, d as (select b.run, {_STEPS} from p a join p b on a.run = b.run and a.frame = b.frame + 1),
 e as (select run, abs(cos(eturn) * (tdx - edx) + sin(eturn) * (tdy - edy)) as dx, abs(cos(eturn) * (tdy - edy) - sin(eturn) * (tdx - edx)) as dy, abs(atan2(sin(tturn - eturn), cos(tturn - eturn))) as dyaw from d)
 select run, count(*) as n, {', '.join(f'round(avg({c}), 4) as mean_{c}, round(stddev_pop({c}), 4) as std_{c}, round(sqrt(avg({c} * {c})), 4) as rmse_{c}' for c in ('dx', 'dy', 'dyaw'))} from e group by run""")
def relative_pose_errors(spark, sf_dir):
    steps = evaluate.relative_errors(_path(spark, sf_dir), "frame")
    axes = ("dx", "dy", "dyaw")
    return rounded(evaluate.axis_errors(steps, {c: F.col(c) for c in axes}, ["run"]), {f"{k}_{c}": 4 for k in ("mean", "std", "rmse") for c in axes})


@query("""with p as (select event_type as run, value as tx, ((event_id * 7919) % 97)::double as ty, event_id from events),
 q as (select *, 0.8::double * tx + 0.6::double * ty + 3 + (event_id % 3) * 0.1::double as ex, 0.8::double * ty - 0.6::double * tx - 2 + (event_id % 5) * 0.1::double as ey from p),
 m as (select run, avg(tx) as mtx, avg(ty) as mty, avg(ex) as mex, avg(ey) as mey from q group by run),
 a as (select run, atan2(sum((ex - mex) * (ty - mty) - (ey - mey) * (tx - mtx)), sum((ex - mex) * (tx - mtx) + (ey - mey) * (ty - mty))) as a from q join m using (run) group by run),
 d as (select run, sqrt(pow(cos(a) * (ex - mex) - sin(a) * (ey - mey) - (tx - mtx), 2) + pow(sin(a) * (ex - mex) + cos(a) * (ey - mey) - (ty - mty), 2)) as far from q join m using (run) join a using (run))
 select run, count(*) as n, round(sqrt(avg(far * far)), 5) as rmse, round(avg(far), 5) as mean, round(max(far), 5) as largest from d group by run""")
def absolute_pose_errors(spark, sf_dir):
    x, y, e = F.col("value"), ((F.col("event_id") * 7919) % 97).cast("double"), F.col("event_id")
    m = views.messages(spark, sf_dir).select(F.col("topic").alias("run"), x.alias("tx"), y.alias("ty"), F.lit(0.0).alias("tz"), (0.8 * x + 0.6 * y + 3 + (e % 3) * F.lit(0.1)).alias("ex"), (0.8 * y - 0.6 * x - 2 + (e % 5) * F.lit(0.1)).alias("ey"), F.lit(0.0).alias("ez"))
    return rounded(evaluate.absolute_errors(m), dict.fromkeys(("rmse", "mean", "largest"), 5))


# transforms

_EVENTS = """e as (select event_type as child, epoch_us(ts)::double as t, min(value) as x, arg_min(event_id % 50, value) * 0.05::double as a from events where event_id % 2 = 0 group by 1, 2)"""


def _links(spark, sf_dir):
    """Transform events of each topic: a shift along x and a turn about z; and what is asked."""
    m = views.messages(spark, sf_dir).withColumn("t", F.col("t").cast("double"))
    turn = poses.yaw((F.col("event_id") % 50) * F.lit(0.05))
    named = [c.alias(n) for c, n in zip((F.col("value"), F.lit(0.0), F.lit(0.0), *turn), poses.FIELDS, strict=True)]
    return m.where("event_id % 2 = 0").select(F.col("topic").alias("child"), "t", *named), m.where("event_id % 2 = 1")


@query(f"""with {_EVENTS}, q as (select event_type as child, event_id, epoch_us(ts)::double as t from events where event_id % 2 = 1),
 l as (select q.*, e.t as t0, e.x as x0, e.a as a0 from q asof left join e on q.child = e.child and q.t >= e.t), h as (select q.event_id, e.t as t1, e.x as x1, e.a as a1 from q asof left join e on q.child = e.child and q.t <= e.t),
 u as (select *, case when t1 > t0 then (t - t0) / (t1 - t0) else 0 end as u from l join h using (event_id))
 select event_id, round(x0 + u * (x1 - x0), 4) + 0.0 as tx, round(a0 + u * (a1 - a0), 5) + 0.0 as yaw from u""")
def tf_pose(spark, sf_dir):
    events, asked = _links(spark, sf_dir)
    out = formats.tf_lookup(asked.select(F.col("topic").alias("child"), "t", "event_id"), events, bucket=float(views.HOUR))
    return rounded(out.select("event_id", F.col("pose.tx").alias("tx"), (2 * F.atan2("pose.qz", "pose.qw")).alias("yaw")), {"tx": 4, "yaw": 5})


def _at(name: str) -> str:
    return f"""{name}_l as (select q.event_id, q.t, e.t as t0, e.x as x0, e.a as a0 from q asof left join (from e where child = '{name}') e on q.t >= e.t), {name}_h as (select q.event_id, e.t as t1, e.x as x1, e.a as a1 from q asof left join (from e where child = '{name}') e on q.t <= e.t),
 {name}_u as (select *, case when t1 > t0 then (t - t0) / (t1 - t0) else 0 end as u from {name}_l join {name}_h using (event_id)),
 {name}_p as (select event_id, case when t0 is null then 'before_first' when t1 is null then 'after_last' else 'ok' end as status, x0 + u * (x1 - x0) as x, a0 + u * (a1 - a0) as a from {name}_u)"""


@query(f"""with {_EVENTS}, q as (select event_id, epoch_us(ts)::double as t from events where event_id % 2 = 1 and event_type = 'view'), {_at('click')}, {_at('view')}, {_at('purchase')},
 j as (select event_id, case when r.status <> 'ok' then r.status when b.status <> 'ok' then b.status else c.status end as status, b.x + cos(b.a) * c.x - r.x as dx, sin(b.a) * c.x as dy, r.a as ra, b.a + c.a - r.a as yaw from view_p b join click_p c using (event_id) join purchase_p r using (event_id))
 select event_id as query_id, status, case when status = 'ok' then round(cos(ra) * dx + sin(ra) * dy, 4) + 0.0 end as tx, case when status = 'ok' then round(cos(ra) * dy - sin(ra) * dx, 4) + 0.0 end as ty, case when status = 'ok' then round(sin(yaw), 5) + 0.0 end as sin_yaw from j""")
def tf_chain(spark, sf_dir):
    """click is carried by view; view and purchase by the base: click is asked for in the frame of purchase."""
    events, asked = _links(spark, sf_dir)
    q = asked.where("topic = 'view'").select(F.col("event_id").alias("query_id"), F.lit("click").alias("target"), F.lit("purchase").alias("reference"), "t")
    out = formats.tf_chain(q, events, {"click": "view", "view": "base", "purchase": "base"}, bucket=float(views.HOUR))
    p = F.col("pose")
    return rounded(out.select("query_id", "status", p["tx"].alias("tx"), p["ty"].alias("ty"), (2 * (p["qw"] * p["qz"] + p["qx"] * p["qy"])).alias("sin_yaw")), {"tx": 4, "ty": 4, "sin_yaw": 5})


# organised clouds


@query(f"""with {RANGES}, n as (select a.*, b.x as x_b, b.y as y_b, b.z as z_b, c.x as x_c, c.y as y_c, c.z as z_c from rng a join rng b on b.image = a.image and b."row" = a."row" and b.col = a.col + 1 join rng c on c.image = a.image and c."row" = a."row" + 1 and c.col = a.col),
 s as (select *, atan2(y, x) as t, atan2(z, sqrt(x*x + y*y)) as p, sqrt(x*x + y*y + z*z) as r, atan2(y_b, x_b) as ta, sqrt(x_b*x_b + y_b*y_b + z_b*z_b) as ra, atan2(z_c, sqrt(x_c*x_c + y_c*y_c)) as pb, sqrt(x_c*x_c + y_c*y_c + z_c*z_c) as rb from n),
 g as (select *, cos(p) / r * (ra - r) / (2 * (t - ta)) as g, (rb - r) / (2 * (p - pb)) / r as h from s)
 select image, "row", col, round(-(cos(t) * (cos(p) + sin(p) * h) - sin(t) * g) / sqrt(1 + g*g + h*h), 5) + 0.0 as nx, round(-(sin(t) * (cos(p) + sin(p) * h) + cos(t) * g) / sqrt(1 + g*g + h*h), 5) + 0.0 as ny, round(-(cos(p) * h - sin(p)) / sqrt(1 + g*g + h*h), 5) + 0.0 as nz from g""")
def spherical_normals(spark, sf_dir):
    return rounded(normals.spherical(views.range_images(spark, sf_dir), ["image"]), dict.fromkeys(("nx", "ny", "nz"), 5))


def _near(name: str, row: int, col: int) -> str:
    return f'join rng {name} on {name}.image = a.image and {name}."row" = a."row" + {row} and {name}.col = a.col + {col}'


@query(f"""with {RANGES}, d as (select a.image, a."row", a.col, a.x, a.y, a.z, {', '.join(f'r.{c} - l.{c} as u{c}, u.{c} - d.{c} as v{c}' for c in 'xyz')} from rng a {_near('r', 0, 1)} {_near('l', 0, -1)} {_near('u', 1, 0)} {_near('d', -1, 0)}),
 n as (select *, uy * vz - uz * vy as cx, uz * vx - ux * vz as cy, ux * vy - uy * vx as cz from d where ux*ux + uy*uy + uz*uz < 4 and vx*vx + vy*vy + vz*vz < 4),
 s as (select *, sqrt(cx*cx + cy*cy + cz*cz) as norm, case when cx*x + cy*y + cz*z > 0 then -1.0::double else 1.0::double end as sign from n)
 select image, "row", col, {', '.join(f'round(sign * c{c} / norm, 5) + 0.0 as n{c}' for c in 'xyz')} from s where norm > 0""")
def cross_normals(spark, sf_dir):
    return rounded(cloud.range_image_normals(views.range_images(spark, sf_dir), ["image"], 1, 4.0), dict.fromkeys(("nx", "ny", "nz"), 5))


@query(f"""with {RANGES} select a.image, a."row", a.col, count(*)::double as s_n, {', '.join(f'round(sum(b.{c}), 5) + 0.0 as s_{c}' for c in 'xyz')}, {', '.join(f'round(sum(b.{a} * b.{b}), 4) + 0.0 as s_{a}{b}' for a, b in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))}
 from rng a join rng b on a.image = b.image and abs(a."row" - b."row") <= 2 and abs(a.col - b.col) <= 2 group by 1, 2, 3""")
def window_moments(spark, sf_dir):
    found = normals.moments(views.range_images(spark, sf_dir), ["image"], 2).drop("x", "y", "z")
    return rounded(found, {f"s_{c}": 5 for c in "xyz"} | {f"s_{c}": 4 for c in ("xx", "xy", "xz", "yy", "yz", "zz")})


@query()
def sliding_normals(spark, sf_dir):
    return normals.sliding(views.range_images(spark, sf_dir), ["image"], 2)


@query()
def line_normals(spark, sf_dir):
    """Normals along each row of the range images, taken as a scan line."""
    return normals.line(views.range_images(spark, sf_dir), ["image", "row"], "col", squared_distance=2.0, least=3)


@query(f"""with {PTS}, a as (select scan_id, point_id, atan2(y, x) as azimuth, atan2(z, sqrt(x * x + y * y)) as elevation from pts),
 b as (select *, (azimuth + 3.0) - floor((azimuth + 3.0) / (2 * pi())) * 2 * pi() as along from a),
 r as (select a.point_id, arg_min(i, (abs(elevation - v), i)) as ring from a cross join (select unnest([-0.9, -0.5, -0.2, 0.0, 0.1, 0.4, 0.8]::double[]) as v, unnest(range(0, 7)) as i) group by a.point_id)
 select scan_id, point_id, case when along <= 5.0 then cast(trunc(greatest(0, along / (5.0::double / 64) - 0.5)) as bigint) end as col, case when elevation between -0.9 - 1.7::double / 6 and 0.8 + 1.7::double / 6 then ring end as ring from b join r using (point_id)""")
def ring_spacing(spark, sf_dir):
    p = views.points(spark, sf_dir)
    azimuth, elevation = F.atan2("y", "x"), F.atan2(F.col("z"), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))
    return p.select("scan_id", "point_id", normals.ring(azimuth, -3.0, 2.0, 64).alias("col"), normals.uneven_ring(elevation, [-0.9, -0.5, -0.2, 0.0, 0.1, 0.4, 0.8]).alias("ring"))


@query(f"""with {PTS}, k as (select point_id as fixed_idx, case when point_id % 5 = 0 then -1 else (point_id * 7) % (select count(*) from pts) end as moving_idx from pts)
 select fixed_idx, moving_idx, round((f.x - m.x) * (f.x - m.x) + (f.y - m.y) * (f.y - m.y) + (f.z - m.z) * (f.z - m.z), 6) + 0.0 as chi from k join pts f on f.point_id = fixed_idx join pts m on m.point_id = moving_idx where fixed_idx >= 0 and moving_idx >= 0""")
def correspondence_chi(spark, sf_dir):
    p = views.points(spark, sf_dir)
    pairs = p.select(F.col("point_id").alias("fixed_idx"), F.when(F.col("point_id") % 5 == 0, F.lit(-1)).otherwise((F.col("point_id") * 7) % p.count()).alias("moving_idx"))
    both = associate.correspond(pairs, p.select("point_id", "x", "y", "z"), p.select("point_id", "x", "y", "z"), "point_id")
    chi = sum((F.col(f"fixed.{c}") - F.col(f"moving.{c}")) ** 2 for c in "xyz")
    return rounded(both.select("fixed_idx", "moving_idx", chi.alias("chi")), {"chi": 6})


@query()
def grid_astar(spark, sf_dir):
    """The way from one corner of each image to the opposite one."""
    cells = _cells(spark, sf_dir).withColumn("cost", 1.0 + F.col("v") % 7)
    return grids.astar(cells, cells.where("`row` = 0 and col = 0"), cells.where("`row` = 7 and col = 7"))
