"""Registered queries of logs, transforms, formats and images."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scanweave.operators import messages, noise
from scanweave.plans import views
from scanweave.plans.catalog import _CELLS, _cells, query, rounded
from scanweave.plans.views import MSGS, PTS
from scanweave.sources import formats
from scanweave.streaming.operators import sort_batch


@query()
def lag_sort(spark, sf_dir):
    """What the lag sorter releases, per topic, of a log whose times are shifted against its arrival."""
    m = views.messages(spark, sf_dir)
    shifted = ((F.col("t") + ((F.col("event_id") * 7919) % 13) * views.HOUR) / 1e6).alias("t")
    return sort_batch(m.select(F.col("topic").alias("stream"), shifted, F.col("event_id").alias("arrival")), 3600.0, 8 * 3600.0)


@query(f"with {MSGS} select cast(t as double) / 1000000 - 0.01 as log_t, event_id, topic from msgs where topic = 'view' union all select cast(t as double) / 1000000, event_id, topic from msgs where topic = 'click'")
def odometry_injection(spark, sf_dir):
    m = views.messages(spark, sf_dir).select("event_id", "topic", (F.col("t").cast("double") / 1_000_000).alias("t"))
    return formats.inject_before(m.where("topic = 'view'"), m.where("topic = 'click'")).select("log_t", "event_id", "topic")


@query(f"with {MSGS} select event_id, coalesce(case when event_id % 3 = 0 then t + 5 end, t) as t from msgs where topic in ('view', 'click')")
def restamp(spark, sf_dir):
    m = views.messages(spark, sf_dir).withColumn("header_t", F.when(F.col("event_id") % 3 == 0, F.col("t") + 5))
    return formats.restamp(m, topics=["view", "click"]).select("event_id", "t")


@query(f"with {MSGS} select frame, event_id, topic from msgs")
def pack_explode(spark, sf_dir):
    """Packs of each frame's messages, taken apart again."""
    packs = views.messages(spark, sf_dir).groupBy("frame", (F.col("event_id") % 4).alias("part")).agg(F.collect_list(F.struct("event_id", "topic")).alias("messages"))
    return messages.explode_packs(packs).select("frame", "message.event_id", "message.topic")


@query(f"with {PTS} select scan_id, point_id, cast(cast(x as float) as double) as x, cast(cast(y as float) as double) as y, cast(cast(z as float) as double) as z from pts where isfinite(x)")
def cloud_roundtrip(spark, sf_dir):
    """Points packed into binary clouds and read back under their place in the cloud, here renamed to their ids."""
    p = views.points(spark, sf_dir)
    back = formats.decode_clouds(formats.encode_clouds(p.withColumn("scan_id", F.col("scan_id").cast("long"))))
    place = p.select("scan_id", F.col("point_id").alias("id"), (F.row_number().over(Window.partitionBy("scan_id").orderBy("point_id")) - 1).cast("long").alias("point_id"))
    out = back.select(F.col("scan_id").cast("int").alias("scan_id"), "point_id", "x", "y", "z").join(place, ["scan_id", "point_id"])
    return out.select("scan_id", F.col("id").alias("point_id"), "x", "y", "z")


@query(f"""with {MSGS}, e as (select topic as child, t as et, value as v from msgs where event_id % 2 = 0), q as (select topic as child, event_id, t from msgs where event_id % 2 = 1),
 a as (select q.*, et as t0 from q asof left join e on q.child = e.child and q.t >= e.et), b as (select q.event_id, et as t1 from q asof left join e on q.child = e.child and q.t <= e.et), n as (select child, count(*) as n from e group by child)
 select a.child, a.event_id, case when n < 2 then 'no_data' when t0 is null then 'before_first' when t1 is null then 'after_last' else 'ok' end as status, round(case when t0 is null or t1 is null then null when t1 > t0 then (t - t0) / (t1 - t0)::double else 0 end, 5) as u from a join b using (event_id) join n on n.child = a.child""")
def tf_lookup(spark, sf_dir):
    m = views.messages(spark, sf_dir)
    zero = [F.lit(0.0).alias(c) for c in ("ty", "tz", "qx", "qy", "qz")]
    events = m.where("event_id % 2 = 0").select(F.col("topic").alias("child"), F.col("t").cast("double").alias("t"), F.col("value").alias("tx"), *zero, F.lit(1.0).alias("qw"))
    asked = m.where("event_id % 2 = 1").select(F.col("topic").alias("child"), F.col("t").cast("double").alias("t"), "event_id")
    out = formats.tf_lookup(asked, events, bucket=float(views.HOUR))
    u = F.when(F.col("before").isNotNull() & F.col("after").isNotNull(), F.col("u"))
    return rounded(out.select("child", "event_id", "status", u.alias("u")), {"u": 5})


@query("select l_suppkey as sensor, count(*) as n, cast(sum(cast(l_extendedprice as decimal(28, 2))) as double) as total from lineitem group by 1")
def exact_sums(spark, sf_dir):
    return views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("sensor")).agg(F.count("*").alias("n"), noise.exact_sum("l_extendedprice", 2).alias("total"))


@query()
def point_noise(spark, sf_dir):
    return noise.disturb_points(views.points(spark, sf_dir), 0.01)


@query(f"""with {_CELLS}, r as (select max(v) as top from cells) select image, "row", col, cast(least(255, greatest(0, floor(v * 300.0::double / top))) as integer) as level, "row" * 0.05::double - 1.0::double as y, col * 0.05::double - 2.0::double as x from cells, r""")
def image_levels(spark, sf_dir):
    """An image scaled to bytes with saturation, and its cells in metres."""
    cells = _cells(spark, sf_dir)
    top = cells.agg(F.max("v").alias("top"))
    level = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col("v") * 300.0 / F.col("top")))).cast("int")
    return cells.join(F.broadcast(top)).select("image", "row", "col", level.alias("level"), (F.col("row") * 0.05 - 1.0).alias("y"), (F.col("col") * 0.05 - 2.0).alias("x"))
