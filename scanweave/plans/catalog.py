"""Registered queries of the sensor-log and mapping operators, each with its SQL where SQL can express it.

Results are whole tables. Sums that are compared are of integers, or rounded last, so that they do not depend on the order
in which partitions are added up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanweave.operators import associate, cloud, evaluate, graph, messages, prefix, surfels
from scanweave.plans import views
from scanweave.plans.views import HOUR, MSGS, NRM, OBS, PTS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def bucket() -> Column:
    """Ten thousand rows of the event stream make one bucket of an ordinal."""
    return F.floor(F.col("event_id") / 10_000)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, names: dict[str, int]) -> DataFrame:
    """Rounds, and makes -0.0 a plain zero."""
    return df.withColumns({c: F.round(F.col(c), d) + F.lit(0.0) for c, d in names.items()})


# messages


@query(f"with {MSGS} select event_id, topic, t, value from msgs where topic in ('click', 'view')")
def topic_select(spark, sf_dir):
    return messages.select_topics(views.messages(spark, sf_dir), ["click", "view"]).select("event_id", "topic", "t", "value")


@query(f"with {MSGS} select event_id, topic from (select *, row_number() over (partition by topic order by event_id) - 1 as k from msgs) where k % 5 = 0")
def decimate(spark, sf_dir):
    return messages.decimate(views.messages(spark, sf_dir), 5, ["event_id"], bucket()).select("event_id", "topic")


@query(f"with {MSGS} select event_id, topic from (select *, row_number() over (order by event_id) - 1 as k from msgs) where k >= 20 and k < 220")
def skip_take(spark, sf_dir):
    return messages.skip_take(views.messages(spark, sf_dir), 10, 100, ["event_id"], bucket()).select("event_id", "topic")


@query(f"""with {MSGS}, c as (select event_id, t, row_number() over (order by event_id) - 1 as pair from msgs where topic = 'click'),
 o as (select event_id, value, row_number() over (order by event_id) - 1 as pair from msgs where topic = 'view')
 select pair, c.event_id as left_event_id, o.event_id as right_event_id from c join o using (pair)""")
def ordinal_pair(spark, sf_dir):
    m = views.messages(spark, sf_dir)
    return messages.ordinal_pair(m.where("topic = 'click'"), m.where("topic = 'view'"), ["event_id"], bucket(), ["event_id"])


@query(f"""with {MSGS}, s as (select event_id, t + ((event_id * 7919) % 13) * {HOUR} as t from msgs),
 r as (select *, max(t) over (order by event_id rows between unbounded preceding and 1 preceding) as latest from s)
 select event_id, t from r where latest is null or t >= latest - 8 * {HOUR}""")
def sorted_late_drop(spark, sf_dir):
    m = views.messages(spark, sf_dir).withColumn("t", F.col("t") + ((F.col("event_id") * 7919) % 13) * HOUR)
    return messages.drop_late(m, "t", "event_id", 8 * HOUR, bucket()).select("event_id", "t")


@query(f"""with {MSGS}, s as (select t, avg(value) as v from msgs where topic = 'view' group by t), q as (select event_id, t from msgs where topic = 'click'),
 a as (select q.event_id, q.t, s.t as t0, s.v as v0 from q asof left join s on q.t >= s.t), b as (select q.event_id, s.t as t1, s.v as v1 from q asof left join s on q.t <= s.t)
 select event_id, round(case when t0 = t1 then v0 else v0 + (t - t0) / (t1 - t0) * (v1 - v0) end, 4) as value_at from a join b using (event_id)""")
def asof_interp(spark, sf_dir):
    m = views.messages(spark, sf_dir)
    out = messages.as_of_interpolate(m.where("topic = 'click'").select("event_id", "t"), m.where("topic = 'view'").select("t", "value"), "t", "value", bucket=HOUR)
    return rounded(out.select("event_id", "value_at"), {"value_at": 4})


@query(f"with {MSGS} select event_id, t - lag(t) over w as dt, cast(round(value * 100) as bigint) - lag(cast(round(value * 100) as bigint)) over w as dv from msgs window w as (partition by topic order by event_id)")
def consecutive_delta(spark, sf_dir):
    m = views.messages(spark, sf_dir).withColumn("v", F.round(F.col("value") * 100).cast("long"))
    out = prefix.previous(m, ["event_id"], bucket(), ["t", "v"], ["topic"])
    return out.select("event_id", (F.col("t") - F.col("prev_t")).alias("dt"), (F.col("v") - F.col("prev_v")).alias("dv"))


@query(f"with {MSGS} select frame, min_by(event_id, event_id) as event_id, t from msgs group by frame, t")
def odometry_first(spark, sf_dir):
    return views.messages(spark, sf_dir).groupBy("frame", "t").agg(F.min("event_id").alias("event_id"))


@query(f"with {MSGS} select event_id, t from msgs where t % {24 * HOUR} < {HOUR} or t % {24 * HOUR} > {HOUR} + 3000000")
def time_exclude(spark, sf_dir):
    day = F.col("t") % (24 * HOUR)
    return views.messages(spark, sf_dir).where((day < HOUR) | (day > HOUR + 3_000_000)).select("event_id", "t")


@query(f"""with recursive {MSGS}, m as (select frame as stream, topic, t / 1000000.0::double as t, event_id, row_number() over (partition by frame order by event_id) as k from msgs where topic in ('click', 'view')),
 r as (select distinct stream, 0::bigint as k, null::double as ct, null::bigint as ca, null::double as vt, null::bigint as va, 0::bigint as pack, false as fired, null::double as begun, null::varchar as arrivals from m
  union all select stream, k, case when not fires then ct end, case when not fires then ca end, case when not fires then vt end, case when not fires then va end, pack + case when fires then 1 else 0 end, fires, least(ct, vt), ca || ',' || va
   from (select *, coalesce(abs(ct - vt) < 7200, false) as fires from (select r.stream, m.k, r.pack, case when topic = 'click' then m.t else r.ct end as ct, case when topic = 'click' then event_id else r.ca end as ca, case when topic = 'view' then m.t else r.vt end as vt, case when topic = 'view' then event_id else r.va end as va
         from r join m on m.stream = r.stream and m.k = r.k + 1)))
 select stream, pack - 1 as pack, begun as t, arrivals from r where fired""")
def sync_pack(spark, sf_dir):
    m = views.messages(spark, sf_dir).select(F.col("frame").alias("stream"), "topic", (F.col("t") / 1e6).alias("t"), F.col("event_id").alias("arrival"))
    packs = messages.synchronise(m, ["click", "view"], 7200.0)
    return packs.withColumn("arrivals", F.array_join(F.col("arrivals").cast("array<string>"), ","))


@query(f"""with recursive {MSGS}, m as (select frame as stream, event_id as arrival, coalesce(abs(value - lag(value) over w), 0) as distance, (event_id % 7) * 0.02::double as angle, row_number() over w as k from msgs window w as (partition by frame order by event_id)),
 r as (select distinct stream, 0::bigint as arrival, 0::double as distance, 0::double as angle, 0::bigint as k, 0::double as far, 0::double as turned, false as given from m
  union all select stream, arrival, distance, angle, k, case when given then 0 else far end, case when given then 0 else turned end, given
   from (select *, far > 25 or turned > 0.25 as given from (select m.stream, m.arrival, m.distance, m.angle, m.k, r.far + m.distance as far, r.turned + m.angle as turned from r join m on m.stream = r.stream and m.k = r.k + 1)))
 select stream, arrival, distance, angle from r where given""")
def motion_subsample(spark, sf_dir):
    m = prefix.previous(views.messages(spark, sf_dir), ["event_id"], bucket(), ["value"], ["frame"])
    steps = m.select(F.col("frame").alias("stream"), F.col("event_id").alias("arrival"), F.coalesce(F.abs(F.col("value") - F.col("prev_value")), F.lit(0.0)).alias("distance"), ((F.col("event_id") % 7) * F.lit(0.02)).alias("angle"))
    return messages.subsample_motion(steps, 25.0, 0.25)


@query(f"""with recursive {MSGS}, m as (select topic, event_id, t / 1000000.0::double as t, row_number() over (partition by topic order by event_id) as n from msgs),
 s as (select topic, max(t) filter (n = 100) as t, (max(t) filter (n = 100) - max(t) filter (n = 1)) / 99 as p from m group by topic having count(*) > 100),
 r as (select topic, 100::bigint as n, t, p, 1::double as s00, 0::double as s01, 1::double as s11 from s
  union all select topic, n, case when near then t + k0 * step else t end, case when near then p + k1 * step else p end, case when near then (1 - k0) * s00 else s00 end, case when near then (1 - k0) * s01 else s01 end, case when near then s11 - k1 * s01 else s11 end
   from (select *, abs(step) <= 3 * p as near, s00 / (s00 + 0.001::double) as k0, s01 / (s00 + 0.001::double) as k1 from (select m.topic, m.n, r.t + r.p as t, r.p, m.t - (r.t + r.p) as step, r.s00 + 2 * r.s01 + r.s11 + 0.0001::double as s00, r.s01 + r.s11 as s01, r.s11 + 0.0001::double as s11 from r join m on m.topic = r.topic and m.n = r.n + 1)))
 select m.topic as stream, event_id as arrival, m.t, round(case when m.n <= 100 then m.t else r.t end, 3) as t_filtered, m.n > 100 as ready from m left join r on r.topic = m.topic and r.n = m.n""")
def kalman_times(spark, sf_dir):
    m = views.messages(spark, sf_dir).select(F.col("topic").alias("stream"), F.col("event_id").alias("arrival"), (F.col("t") / 1e6).alias("t"))
    return rounded(messages.kalman_times(m), {"t_filtered": 3})


# point clouds


@query(f"with {PTS} select scan_id, point_id from pts where abs(x - 0.01) < 0.1 and abs(z) < 0.15")
def clip_box(spark, sf_dir):
    return cloud.clip(views.points(spark, sf_dir), {"x": 0.01}, {"x": 0.1, "y": 0.0, "z": 0.15}).select("scan_id", "point_id")


@query(f"""with {PTS} select scan_id, cast(trunc(x / 0.05) as bigint) as x_cell, cast(trunc(y / 0.05) as bigint) as y_cell, count(*) as n_points, round(avg(x), 6) + 0.0 as x, round(avg(y), 6) + 0.0 as y, round(avg(z), 6) + 0.0 as z
 from pts group by 1, 2, 3""")
def voxel_mean(spark, sf_dir):
    return rounded(cloud.voxelise(views.points(spark, sf_dir), {"x": 0.05, "y": 0.05, "z": 0.0}, ["scan_id"]), {"x": 6, "y": 6, "z": 6})


_PROJECTED = """pr as (select scan_id, point_id, sqrt(x*x+y*y+z*z) as depth, cast(floor((atan2(z, sqrt(x*x+y*y)) - (-1.5707963267948966)) / (1.5707963267948966 - (-1.5707963267948966)) * 16) as integer) as "row",
 least(cast(floor((atan2(y, x) + 3.141592653589793) / (2 * 3.141592653589793) * 32) as integer), 31) as col from pts)"""


@query(f"""with {PTS}, {_PROJECTED}, k as (select *, row_number() over (partition by scan_id, "row", col order by depth, point_id desc) as k from pr where "row" between 0 and 15 and depth > 0)
 select scan_id, "row", col, point_id, round(depth, 6) as depth from k where k = 1""")
def zbuffer(spark, sf_dir):
    projected = cloud.project_spherical(views.points(spark, sf_dir), 16, 32)
    return rounded(cloud.depth_buffer(projected, ["scan_id"]), {"depth": 6})


@query(f'with {PTS}, {_PROJECTED} select scan_id, "row", col, max(point_id) as point_id from pr where "row" between 0 and 15 and depth > 0 group by 1, 2, 3')
def index_image(spark, sf_dir):
    return cloud.index_image(cloud.project_spherical(views.points(spark, sf_dir), 16, 32), ["scan_id"])


@query(f"""with {PTS} select a.scan_id, a.point_id as left_id, b.point_id as right_id, round((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z), 8) as distance2
 from pts a join pts b on a.scan_id = b.scan_id and a.point_id <> b.point_id and (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) < 0.01""")
def radius_neighbors(spark, sf_dir):
    p = views.points(spark, sf_dir)
    return rounded(cloud.radius_pairs(p, p, 0.1, ["scan_id"]).where("left_id != right_id"), {"distance2": 8})


_HALVES = """a as (select * from pts where point_id % 2 = 0), b as (select * from pts where point_id % 2 = 1),
 d as (select a.point_id as left_id, b.point_id as right_id, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) as d2 from a join b on (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) < 0.0225)"""


@query(f"with {PTS}, {_HALVES} select left_id, arg_min(right_id, (d2, right_id)) as right_id, round(min(d2), 8) as distance2 from d group by left_id")
def nearest_neighbor(spark, sf_dir):
    p = views.points(spark, sf_dir)
    return rounded(cloud.nearest(p.where("point_id % 2 = 0"), p.where("point_id % 2 = 1"), 0.15), {"distance2": 8})


@query(f"""with {PTS}, {_HALVES}, l as (select left_id, arg_min(right_id, (d2, right_id)) as right_id, min(d2) as d2 from d group by left_id), r as (select right_id, arg_min(left_id, (d2, left_id)) as left_id from d group by right_id)
 select left_id, right_id, round(d2, 8) as distance2 from l join r using (left_id, right_id)""")
def mutual_nearest(spark, sf_dir):
    p = views.points(spark, sf_dir)
    return rounded(cloud.mutual_nearest(p.where("point_id % 2 = 0"), p.where("point_id % 2 = 1"), 0.15), {"distance2": 8})


@query(f"with {PTS} select scan_id, point_id, round(0.8 * x - 0.6 * y + 1.5, 6) as x, round(0.6 * x + 0.8 * y - 2.0, 6) as y, round(z + 0.25, 6) as z from pts")
def rigid_transform(spark, sf_dir):
    return rounded(cloud.transform(views.points(spark, sf_dir), [0.8, -0.6, 0.0, 1.5, 0.6, 0.8, 0.0, -2.0, 0.0, 0.0, 1.0, 0.25]), dict.fromkeys("xyz", 6))


@query(f"with {PTS} select point_id, round(sqrt(x*x+y*y+z*z), 6) as range, round(x, 6) + 0.0 as x, round(y, 6) + 0.0 as y, round(z, 6) + 0.0 as z from pts")
def polar_roundtrip(spark, sf_dir):
    out = cloud.from_polar(cloud.polar(views.points(spark, sf_dir)))
    return rounded(out.select("point_id", "range", "x", "y", "z"), dict.fromkeys(("range", "x", "y", "z"), 6))


@query(f"with {NRM} select obs_id, round(atan2(sqrt((py*nz-pz*ny)*(py*nz-pz*ny)+(pz*nx-px*nz)*(pz*nx-px*nz)+(px*ny-py*nx)*(px*ny-py*nx)), px*nx+py*ny+pz*nz), 6) as angle from nrm")
def angle_between(spark, sf_dir):
    n = views.normals(spark, sf_dir)
    return rounded(n.select("obs_id", cloud.angle_between([F.col(f"p{c}") for c in "xyz"], [F.col(f"n{c}") for c in "xyz"]).alias("angle")), {"angle": 6})


@query(f"""with {PTS} select scan_id, count(*) as n_points, round(avg(x), 6) + 0.0 as mean_x, round(avg(y), 6) + 0.0 as mean_y, round(avg(z), 6) + 0.0 as mean_z,
 {', '.join(f"round(coalesce(covar_samp({a}, {b}), 0), 7) + 0.0 as cov_{a}{b}" for i, a in enumerate("xyz") for b in "xyz"[i:])} from pts group by scan_id""")
def scan_mean_cov(spark, sf_dir):
    return rounded(cloud.mean_covariance(views.points(spark, sf_dir), ["scan_id"]), {**{f"mean_{c}": 6 for c in "xyz"}, **{f"cov_{a}{b}": 7 for i, a in enumerate("xyz") for b in "xyz"[i:]}})


@query(f"with {PTS} select scan_id, {', '.join(f'round(max(greatest({c}, 0)) - min(least({c}, 0)), 6) as extent_{c}' for c in 'xyz')} from pts group by scan_id")
def oriented_extent(spark, sf_dir):
    return rounded(cloud.extents(views.points(spark, sf_dir), ["scan_id"]), {f"extent_{c}": 6 for c in "xyz"})


_CELLS = """cells as (select vec_id as image, (i - 1) // 8 as "row", (i - 1) % 8 as col, cast(floor(abs(embedding[i]::double) * 1000) as bigint) as v from (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings))"""


def _cells(spark, sf_dir) -> DataFrame:
    """Dense 8 x 8 images, one for each vector: image, row, col, v in thousandths."""
    e = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("i", "x"))
    return e.select("image", F.floor(F.col("i") / 8).alias("row"), (F.col("i") % 8).cast("long").alias("col"), F.floor(F.abs(F.col("x").cast("double")) * 1000).alias("v"))


@query(f"""with {_CELLS}, a as (select *, sum(v) over (partition by image, "row" order by col) as s from cells) select image, "row", col, v, cast(sum(s) over (partition by image, col order by "row") as bigint) as integral from a""")
def integral_image(spark, sf_dir):
    return cloud.integral_image(_cells(spark, sf_dir), ["image"], "v")


@query(f"""with {_CELLS} select a.image, a."row", a.col, cast(sum(b.v) as bigint) as box_sum from cells a join cells b on a.image = b.image and abs(a."row" - b."row") <= 2 and abs(a.col - b.col) <= 2 group by 1, 2, 3""")
def box_blur(spark, sf_dir):
    return cloud.box_sums(cloud.integral_image(_cells(spark, sf_dir), ["image"], "v"), ["image"], 2).withColumn("box_sum", F.col("box_sum").cast("long"))


@query(f"""with {_CELLS} select image, cast(floor("row" / 4) as integer) as block_row, cast(floor(col / 4) as integer) as block_col, count(*) as n_cells, round(avg(v), 3) as mean_v from cells group by 1, 2, 3""")
def block_downsample(spark, sf_dir):
    return rounded(cloud.block_means(_cells(spark, sf_dir), ["image"], "v", 4), {"mean_v": 3})


@query(f"""with {_CELLS}, s as (select * from cells where v > (select 2 * avg(v) from cells) or v = 0 or ("row" * 7 + col) % 31 = 0)
 select a.image, a."row", a.col, cast(least(min((a."row" - s."row") * (a."row" - s."row") + (a.col - s.col) * (a.col - s.col)), 36) as bigint) as d2 from cells a join s on a.image = s.image group by 1, 2, 3""")
def distance_transform(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    high = cells.agg((2 * F.avg("v")).alias("_high"))
    seeds = cells.join(F.broadcast(high), F.expr("v > _high or v = 0 or (`row` * 7 + col) % 31 = 0")).drop("_high")
    return graph.distance_transform(cells, seeds, 6)


_WORD = "list_sum([case when embedding[i + {0}] > 0 then 1::bigint << (i - 1) else 0::bigint end for i in range(1, 33)])::bigint"


@query(f"""with d as (select vec_id, {_WORD.format(0)} as low, {_WORD.format(32)} as high from embeddings)
 select a.vec_id, cast(bit_count(xor(a.low, b.low)) + bit_count(xor(a.high, b.high)) as integer) as hamming from d a join d b on b.vec_id = a.vec_id + 1""")
def descriptor_hamming(spark, sf_dir):
    d = views.table(spark, sf_dir, "embeddings").select("vec_id", associate.binary_descriptor(F.col("embedding")).alias("d"))
    both = d.join(d.select((F.col("vec_id") - 1).alias("vec_id"), F.col("d").alias("e")), "vec_id")
    return both.select("vec_id", associate.hamming(F.col("d"), F.col("e")).alias("hamming"))


@query("select a.vec_id, round(list_sum([x * x for x in diff]), 4) as l2 from (select a.vec_id, [cast(a.embedding[i] as double) - cast(b.embedding[i] as double) for i in range(1, 65)] as diff from embeddings a join embeddings b on b.vec_id = a.vec_id + 1) a")
def descriptor_l2(spark, sf_dir):
    d = views.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    square = F.expr("aggregate(zip_with(a.embedding, b.embedding, (x, y) -> pow(cast(x as double) - cast(y as double), 2)), 0D, (s, x) -> s + x)")
    return rounded(d.alias("a").join(d.alias("b"), F.expr("b.vec_id = a.vec_id + 1")).select("a.vec_id", square.alias("l2")), {"l2": 4})


# surfels


@query(f"""with {NRM}, f as (select surfel_id, arg_min({{'px': px, 'py': py, 'pz': pz, 'nx': nx, 'ny': ny, 'nz': nz}}, obs_id) as f from nrm group by surfel_id),
 s as (select surfel_id, count(*) as n_obs, avg(f.nx * (px - f.px) + f.ny * (py - f.py) + f.nz * (pz - f.pz)) as off from nrm join f using (surfel_id) group by surfel_id)
 select surfel_id, n_obs, round("off", 6) + 0.0 as "offset", round(f.px + "off" * f.nx, 6) + 0.0 as mx, round(f.py + "off" * f.ny, 6) + 0.0 as my, round(f.pz + "off" * f.nz, 6) + 0.0 as mz from s join f using (surfel_id)""")
def surfel_offset(spark, sf_dir):
    return rounded(surfels.refine_offsets(views.normals(spark, sf_dir)), dict.fromkeys(("offset", "mx", "my", "mz"), 6))


@query(f"""with {NRM}, a as (select surfel_id, count(*) as n_leaves, avg(px) as mx, avg(py) as my, avg(pz) as mz, avg(nx) as nx, avg(ny) as ny, avg(nz) as nz from nrm group by surfel_id)
 select surfel_id, n_leaves, {', '.join(f'round(m{c}, 6) + 0.0 as m{c}, round(n{c} / sqrt(nx*nx+ny*ny+nz*nz), 5) + 0.0 as n{c}' for c in 'xyz')} from a""")
def surfel_average(spark, sf_dir):
    leaves = views.normals(spark, sf_dir).withColumnsRenamed({f"p{c}": f"m{c}" for c in "xyz"})
    return rounded(surfels.average(leaves), {**{f"m{c}": 6 for c in "xyz"}, **{f"n{c}": 5 for c in "xyz"}})


@query("select l_partkey as surfel_id, round(greatest(max(sqrt(l_discount * l_discount + l_tax * l_tax) / 2), 0.075), 6) as radius from lineitem group by 1 having max(sqrt(l_discount * l_discount + l_tax * l_tax) / 2) > 0")
def surfel_radius_filter(spark, sf_dir):
    leaves = views.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("surfel_id"), F.col("l_discount").alias("b1"), F.col("l_tax").alias("b2"))
    return surfels.max_radius(leaves).select("surfel_id", F.round(surfels.shown_radius(F.col("radius")), 6).alias("radius"))


def _ray_sql() -> str:
    return ", ".join(f"({a!r}::double, {b!r}::double)" for a, b in surfels.beams())


@query(f"""with {NRM}, rays as (select * from (values {_ray_sql()}) t(a, b)), l as (select obs_id, 10 * px as mx, 10 * py as my, 10 * pz as mz, nx, ny, nz from nrm),
 d as (select *, sqrt(mx*mx+my*my+mz*mz) as dist from l), g as (select *, mx/dist as dx, my/dist as dy, mz/dist as dz from d), h as (select *, sqrt(dx*dx+dy*dy) as flat from g),
 u as (select *, case when flat > 1e-9 then -dy/flat else 1 end as ux, case when flat > 1e-9 then dx/flat else 0 end as uy, 0.0::double as uz from h),
 v as (select *, dy*uz-dz*uy as vx, dz*ux-dx*uz as vy, dx*uy-dy*ux as vz from u),
 w as (select *, nx*dx+ny*dy+nz*dz as nd, nx*ux+ny*uy+nz*uz as nu, nx*vx+ny*vy+nz*vz as nv, nx*mx+ny*my+nz*mz as plane from v),
 r as (select obs_id, dist, plane, (nd + a*nu + b*nv) / sqrt(1 + a*a + b*b) as along from w cross join rays),
 s as (select obs_id, sqrt(avg(pow(plane / along - dist, 2)) filter (abs(along) >= 1e-6)) as sigma from r group by obs_id)
 select obs_id, round(1 - least(coalesce(sigma, 0), 0.25) / 0.25, 5) as weight from s""")
def beam_weight(spark, sf_dir):
    leaves = views.normals(spark, sf_dir).withColumns({f"m{c}": 10 * F.col(f"p{c}") for c in "xyz"})
    return rounded(surfels.beam_weight(leaves).select("obs_id", "weight"), {"weight": 5})


# factor graphs


def _graph(spark, sf_dir):
    """Orders are factors between a customer and, by their nation, a region's landmark; some are disabled or fixed."""
    o, c = views.table(spark, sf_dir, "orders"), views.table(spark, sf_dir, "customer")
    factors = o.select(F.col("o_orderkey").alias("factor_id"), (F.col("o_orderstatus") != "P").alias("enabled"))
    status = F.when(F.col("c_custkey") % 7 == 0, "fixed").when(F.col("c_custkey") % 11 == 0, "inactive").otherwise("active")
    variables = c.select(F.col("c_custkey").alias("variable_id"), status.alias("status")).unionByName(spark.range(25).select((-1 - F.col("id")).alias("variable_id"), F.when(F.col("id") % 3 == 0, "fixed").otherwise("active").alias("status")))
    near = o.join(c, o["o_custkey"] == c["c_custkey"])
    edges = near.select(F.col("o_orderkey").alias("factor_id"), F.explode(F.array(F.col("c_custkey"), (-1 - F.col("c_nationkey")).cast("long"))).alias("variable_id"))
    return factors, edges, variables


_GRAPH = """factors as (select o_orderkey as factor_id, o_orderstatus <> 'P' as enabled from orders),
 variables as (select c_custkey as variable_id, case when c_custkey % 7 = 0 then 'fixed' when c_custkey % 11 = 0 then 'inactive' else 'active' end as status from customer
   union all select -1 - n, case when n % 3 = 0 then 'fixed' else 'active' end from (select unnest(range(0, 25)) as n)),
 edges as (select o_orderkey as factor_id, c_custkey as variable_id from orders join customer on o_custkey = c_custkey union all select o_orderkey, -1 - c_nationkey from orders join customer on o_custkey = c_custkey)"""
_ACTIVE = "act as (select factor_id from factors join edges using (factor_id) join variables using (variable_id) where enabled group by factor_id having not bool_or(status = 'inactive') and not bool_and(status = 'fixed'))"


@query(f"with {_GRAPH}, {_ACTIVE} select factor_id from act")
def factor_active(spark, sf_dir):
    return graph.active_factors(*_graph(spark, sf_dir)).select("factor_id")


@query(f"with {_GRAPH}, {_ACTIVE} select variable_id, row_number() over (order by variable_id) - 1 as index from (select distinct variable_id from edges join act using (factor_id) join variables using (variable_id) where status = 'active')")
def variable_active(spark, sf_dir):
    factors, edges, variables = _graph(spark, sf_dir)
    return graph.active_variables(graph.active_factors(factors, edges, variables), edges, variables).select("variable_id", F.col("index").cast("long").alias("index"))


@query(f"with {_GRAPH} select factor_id from edges group by factor_id having bool_and(variable_id % 2 = 0)")
def graph_view(spark, sf_dir):
    _, edges, variables = _graph(spark, sf_dir)
    return graph.view_of_variables(edges, variables.where("variable_id % 2 = 0"))


@query("select distinct l_suppkey as variable_id from lineitem where l_partkey in (select l_partkey from lineitem where l_returnflag <> 'R')")
def graph_view_factors(spark, sf_dir):
    """The variables of all factors that have an enabled observation."""
    rows = views.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("factor_id"), F.col("l_suppkey").alias("variable_id"), (F.col("l_returnflag") != "R").alias("enabled"))
    return graph.view_of_factors(rows.drop("enabled"), rows.where("enabled"))


@query(f"""with {_GRAPH}, came as (select variable_id, (variable_id * 7919) % 10007 as arrival from variables where variable_id % 17 <> 0),
 m as (select e.factor_id, count(*) as n_variables, count(arrival) as there, max(arrival) as last from (select distinct factor_id, variable_id from edges) e left join came using (variable_id) group by 1)
 select factor_id, cast(n_variables as integer) as n_variables, greatest(factor_id % 10007, last) as released from m where n_variables = there""")
def factor_releases(spark, sf_dir):
    """Factors and variables that a log brings in any order; some variables never come."""
    factors, edges, variables = _graph(spark, sf_dir)
    came = variables.where("variable_id % 17 != 0").select("variable_id", ((F.col("variable_id") * 7919) % 10007).alias("arrival"))
    return graph.releases(factors.select("factor_id", (F.col("factor_id") % 10007).alias("arrival")), edges, came)


def _errors(spark, sf_dir) -> DataFrame:
    return views.table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_quantity") * F.col("l_quantity") / 100).alias("chi"), (F.col("l_returnflag") != "R").alias("enabled"))


@query("""with e as (select l_quantity * l_quantity / 100 as chi, l_returnflag <> 'R' as enabled from lineitem),
 k as (select *, case when not enabled then 'suppressed' when sqrt(chi) < 2 then 'inlier' else 'kernelized' end as status, case when sqrt(chi) < 2 then chi else 4 * abs(sqrt(chi) - 2) end as cost from e)
 select status, count(*) as n, round(sum(chi), 2) as chi, round(sum(cost), 2) as cost from k group by status""")
def chi_stats(spark, sf_dir):
    return rounded(graph.chi_statistics(_errors(spark, sf_dir), "huber", 2.0), {"chi": 2, "cost": 2})


@query("""with e as (select l_returnflag || l_linestatus as kind, l_quantity * l_quantity / 100 as chi from lineitem),
 k as (select *, case when kind = 'AF' then case when sqrt(chi) < 2 then chi else 4 * abs(sqrt(chi) - 2) end when kind = 'RF' then 3 * ln(1 + chi / 3) when kind = 'NF' then chi else least(chi, 9) end as cost from e)
 select kind, count(*) as n, round(sum(chi), 2) as chi, round(sum(cost), 2) as cost from k group by kind""")
def robust_policies(spark, sf_dir):
    """Each kind of factor under a kernel of its own."""
    e = views.table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("kind"), (F.col("l_quantity") * F.col("l_quantity") / 100).alias("chi"))
    cost, _ = graph.robust_by_type(F.col("kind"), F.col("chi"), {"AF": ("huber", 2.0), "RF": ("cauchy", 3.0), "NF": (None, 0.0)}, ("saturated", 9.0))
    return rounded(e.withColumn("cost", cost).groupBy("kind").agg(F.count("*").alias("n"), F.sum("chi").alias("chi"), F.sum("cost").alias("cost")), {"chi": 2, "cost": 2})


@query("""with e as (select distinct l_quantity, l_quantity * l_quantity / 100 as chi from lineitem) select l_quantity as q,
 round(case when sqrt(chi) < 2 then 1 else 4 / sqrt(chi) end, 8) as huber, round(1 / (1 + chi / 2), 8) as cauchy, case when chi < 2 then 1.0::double else 0.0::double end as saturated, round(case when chi < 2 then chi else 0 end, 8) as clamp_cost,
 round(2 * ln(1 + chi / 2), 8) as cauchy_cost from e""")
def robust_weights(spark, sf_dir):
    e = _errors(spark, sf_dir).select("l_quantity", "chi").distinct()
    get = lambda kernel, i: F.round(graph.robust(F.col("chi"), kernel, 2.0)[i], 8)
    return e.select(F.col("l_quantity").alias("q"), get("huber", 1).alias("huber"), get("cauchy", 1).alias("cauchy"), get("saturated", 1).alias("saturated"), get("clamp", 0).alias("clamp_cost"), get("cauchy", 0).alias("cauchy_cost"))


@query(f"""with {OBS} select kind, i, j, cast(sum(h) as bigint) as h, cast(sum(b) as bigint) as b from (
 select 'scan_id' as kind, scan_id as i, scan_id as j, w as h, w * m as b from obs union all select 'surfel_id', surfel_id, surfel_id, w, -w * m from obs union all select 'cross', scan_id, surfel_id, -w, 0 from obs) group by 1, 2, 3""")
def ba_normal_equations(spark, sf_dir):
    """Residual surfel - scan - m with unit Jacobians, weights w: one pass of map-side sums into blocks."""
    rows = views.observations(spark, sf_dir).withColumns({"js": F.lit(-1), "ju": F.lit(1)})
    return graph.normal_equations(rows, ("scan_id", "surfel_id"), ("js", "ju"), "m", "w").withColumn("b", F.col("b").cast("long"))


@query(f"""with {OBS}, s as (select surfel_id, scan_id, sum(w) as w from obs group by 1, 2), t as (select surfel_id, sum(w) as h from s group by 1)
 select a.scan_id as i, b.scan_id as j, round(sum(-cast(a.w as double) * b.w / h), 4) as h from s a join s b using (surfel_id) join t using (surfel_id) where a.scan_id <= b.scan_id group by 1, 2""")
def schur_reduced(spark, sf_dir):
    """The fill that eliminating the surfels brings to the scans' system: one row per pair of scans."""
    s = views.observations(spark, sf_dir).repartition("surfel_id").groupBy("surfel_id", "scan_id").agg(F.sum("w").alias("w"))  # one shuffle for both groupings
    return rounded(graph.fill(s, "surfel_id", "scan_id", "w"), {"h": 4})


@query("""with e as (select distinct 'n' || n_nationkey as a, 'r' || n_regionkey as b from nation union select distinct 'c' || c_custkey, 'n' || c_nationkey from customer), s as (select a, b from e union all select b, a from e),
 hop1 as (select distinct b as v from s where a = 'r0'), hop2 as (select distinct s.b as v from s join hop1 on s.a = hop1.v), c as (select 'r0' as v, 0 as cost union all select v, 1 from hop1 union all select v, 2 from hop2)
 select v as variable_id, min(cost) as cost from c group by v""")
def graph_visit(spark, sf_dir):
    n, c = views.table(spark, sf_dir, "nation"), views.table(spark, sf_dir, "customer")
    pair = lambda a, b: F.explode(F.array(a, b)).alias("variable_id")
    name = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    edges = n.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("factor_id"), pair(name("n", "n_nationkey"), name("r", "n_regionkey")))
    edges = edges.unionByName(c.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("factor_id"), pair(name("c", "c_custkey"), name("n", "c_nationkey"))))
    return graph.visit(edges, spark.sql("select 'r0' as variable_id"))


@query("""with e as (select n_nationkey as a, n_regionkey as r from nation) select 'n' || a as variable_id, min('n' || a) over (partition by r) as component from e""")
def components(spark, sf_dir):
    n = views.table(spark, sf_dir, "nation")
    edges = n.select(F.col("n_regionkey").alias("factor_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("variable_id"))
    return graph.connected(edges)


@query(f"""with {OBS}, f as (select surfel_id * 10 + scan_id % 10 as factor_id, scan_id as v, true as path from obs union select surfel_id * 10 + scan_id % 10, 1000000 + surfel_id, false from obs),
 fe as (select factor_id, max(v) as epoch from f where path group by 1), lm as (select v, min(epoch) as epoch from f join fe using (factor_id) where not path group by v)
 select 'factor' as kind, factor_id as id, epoch from fe union all select 'variable', v, epoch from lm union all select distinct 'variable', v, v from f where path""")
def epoch_order(spark, sf_dir):
    f = views.observations(spark, sf_dir).select((F.col("surfel_id") * 10 + F.col("scan_id") % 10).alias("factor_id"), "scan_id", "surfel_id")
    edges = f.select("factor_id", F.explode(F.array(F.col("scan_id"), F.lit(1_000_000) + F.col("surfel_id"))).alias("variable_id")).distinct()
    return graph.epoch_order(edges, F.col("variable_id") < 1_000_000)


# evaluation


@query("""with p as (select event_type as run, value - (event_id % 7) as ex, value * 0.5 - (event_id % 3) as ey from events)
 select run, count(*) as n, round(avg(ex), 4) as mean_x, round(stddev_pop(ex), 4) as std_x, round(sqrt(avg(ex * ex)), 4) as rmse_x, round(avg(ey), 4) as mean_y, round(stddev_pop(ey), 4) as std_y, round(sqrt(avg(ey * ey)), 4) as rmse_y from p group by run""")
def rmse_per_axis(spark, sf_dir):
    m = views.messages(spark, sf_dir).withColumnRenamed("topic", "run")
    axes = {"x": F.col("value") - F.col("event_id") % 7, "y": F.col("value") * 0.5 - F.col("event_id") % 3}
    return rounded(evaluate.axis_errors(m, axes, ["run"]), {f"{k}_{a}": 4 for k in ("mean", "std", "rmse") for a in "xy"})


@query("""with p as (select user_id as run, row_number() over (partition by user_id order by event_id) - 1 as frame, cast(round(sum(cast(round(value * 100) as bigint)) over (partition by user_id order by event_id)) as double) as distance from events),
 s as (select run, frame as first, distance + length as goal, length from p cross join (select unnest([5000.0, 10000.0]) as length) where frame % 10 = 0)
 select s.run, first, cast(length as double) as length, min(p.frame) as last from s join p on p.run = s.run and p.distance > s.goal group by 1, 2, 3""")
def segment_error(spark, sf_dir):
    m = views.messages(spark, sf_dir).withColumn("v", F.round(F.col("value") * 100).cast("long"))
    placed = prefix.ordinal(m, ["event_id"], bucket(), ["frame"], "place")
    along = F.sum("v").over(Window.partitionBy("frame").orderBy("event_id")).cast("double")
    path = placed.select(F.col("frame").alias("run"), F.col("place").cast("long").alias("frame"), along.alias("distance"))
    return evaluate.segment_ends(path, [5000.0, 10000.0])


@query(f"""with {MSGS}, a as (select event_id, t from msgs where topic = 'click'), b as (select event_id as truth_id, t as tt from msgs where topic = 'view'),
 j as (select a.event_id, truth_id, abs(t - tt) as gap, tt from a join b on abs(t - tt) <= {HOUR}) select event_id, arg_min(truth_id, (gap, tt)) as truth_id from j group by event_id""")
def match_nearest(spark, sf_dir):
    m = views.messages(spark, sf_dir)
    out = evaluate.match_nearest(m.where("topic = 'click'").select("event_id", "t"), m.where("topic = 'view'").select(F.col("event_id").alias("truth_id"), "t"), HOUR)
    return out.select("event_id", F.col("truth.truth_id").alias("truth_id"))


@query("select l_returnflag, count(*) as n, count(*) filter (l_quantity * l_quantity / 100 < 9) as n_close, round(sum(l_quantity * l_quantity / 100) filter (l_quantity * l_quantity / 100 < 9), 2) as chi_close from lineitem group by 1")
def evaluator_chi(spark, sf_dir):
    e = views.table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") * F.col("l_quantity") / 100).alias("chi"))
    close = F.col("chi") < 9
    return rounded(e.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count(F.when(close, 1)).alias("n_close"), F.sum(F.when(close, F.col("chi"))).alias("chi_close")), {"chi_close": 2})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from scanweave.plans import iterative, logs, motion, recorded, visiting  # noqa: F401  they register their queries here

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
