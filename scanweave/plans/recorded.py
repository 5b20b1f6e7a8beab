"""Registered queries over recorder files and object files that are written from the tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scanweave.plans import views
from scanweave.plans.catalog import query, rounded
from scanweave.plans.views import MSGS, NRM
from scanweave.sources import formats, objects, rosbag, rosmsg
from scanweave.sources.tables import keep, shared_dir


def _odometry(spark, sf_dir):
    """The log as odometry messages in time order: topic, t in nanoseconds, message. It is the log that is sorted, as to find
    ranges everything before the sort runs twice."""
    m, e = views.messages(spark, sf_dir).repartitionByRange("t").sortWithinPartitions("t"), F.col("event_id")
    point = F.struct(F.col("value").alias("x"), (e % 13).cast("double").alias("y"), F.lit(0.0).alias("z"))
    turn = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(1.0).alias("w"))
    header = F.struct(e.alias("seq"), (F.col("t") * 1000).alias("stamp"), F.col("frame").cast("string").alias("frame_id"))
    pose = F.struct(F.struct(point.alias("position"), turn.alias("orientation")).alias("pose"), F.transform(F.sequence(F.lit(0), F.lit(35)), lambda i: (i % 7 == 0).cast("double")).alias("covariance"))
    return m.select("topic", (F.col("t") * 1000).alias("t"), F.struct(header.alias("header"), F.lit("base").alias("child_frame_id"), pose.alias("pose")).alias("message"))


@query(f"""with {MSGS} select topic, t * 1000 as t, event_id as seq, cast(frame as varchar) as frame_id, value as x, (event_id % 13)::double as y, 6.0::double as trace
 from msgs where topic in ('click', 'purchase') and t >= epoch_us(timestamp '2024-01-10 00:00:00') and t < epoch_us(timestamp '2024-01-25 00:00:00')""")
def bag_log(spark, sf_dir):
    """The log, written as bags in time order by many tasks, and read back with a filter that leaves out chunks."""
    folder = f"{shared_dir(spark)}/bags-{uuid.uuid4().hex}"
    rows = rosmsg.encode(_odometry(spark, sf_dir), "nav_msgs/Odometry")
    rosbag.write_bags(rows, folder)
    first, last = (int(d) * 86_400_000_000_000 for d in (19732, 19747))  # days since 1970
    found = rosbag.read_bags(spark, folder).where(F.col("topic").isin("click", "purchase") & (F.col("t") >= first) & (F.col("t") < last))
    m = rosmsg.decode(found, "nav_msgs/Odometry")
    point, cov = F.col("message.pose.pose.position"), F.col("message.pose.covariance")
    trace = F.aggregate(F.sequence(F.lit(0), F.lit(5)), F.lit(0.0), lambda s, i: s + F.element_at(cov, i * 7 + 1))
    return m.select("topic", "t", F.col("message.header.seq").alias("seq"), F.col("message.header.frame_id").alias("frame_id"), point["x"].alias("x"), point["y"].alias("y"), trace.alias("trace"))


@query("""select 'Order' as kind, o_orderkey as order_id, o_custkey as customer_id, c_acctbal as balance, n_name as nation, case when o_orderkey % 7 = 0 then 'null' when o_orderkey % 11 = 0 then 'dangling' else 'found' end as other
 from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey""")
def object_links(spark, sf_dir):
    """Orders, customers and nations as one stream of objects; each order's customer and that customer's nation by pointers."""
    t = lambda n: views.table(spark, sf_dir, n)
    folder = f"{shared_dir(spark)}/objects-{uuid.uuid4().hex}"
    at = lambda k, c: (F.lit(k) + F.lit(1000) * F.col(c)).cast("long")
    body = lambda *c: F.to_json(F.struct(*c)).alias("body")
    nation = t("nation").select(F.lit("Nation").alias("kind"), body(at(1, "n_nationkey").alias("#id"), F.col("n_name").alias("name")))
    customer = t("customer").select(F.lit("Customer").alias("kind"), body(at(2, "c_custkey").alias("#id"), F.col("c_acctbal").alias("balance"), objects.pointer(at(1, "c_nationkey")).alias("nation")))
    other = F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).when(F.col("o_orderkey") % 11 == 0, F.lit(999).cast("long")).otherwise(at(3, "o_orderkey"))
    order = t("orders").select(F.lit("Order").alias("kind"), body(at(3, "o_orderkey").alias("#id"), F.struct(objects.pointer(at(2, "o_custkey")).alias("of"), objects.pointer(other).alias("other")).alias("links")))
    objects.write_objects(order.unionByName(nation).unionByName(customer), folder)
    found = keep(objects.references(objects.read_objects(spark, folder, together=True)), "object-links")
    number = lambda c: F.expr(f"{c} div 1000")
    of = found.where("kind = 'Order' and at = 'links.of'").select("kind", number("id").alias("order_id"), "target", F.get_json_object("target_body", "$.balance").cast("double").alias("balance"))
    status = found.where("kind = 'Order' and at = 'links.other'").select(number("id").alias("order_id"), F.col("status").alias("other"))
    home = found.where("kind = 'Customer'").select(F.col("id").alias("target"), F.get_json_object("target_body", "$.name").alias("nation"))
    return of.join(home, "target").join(status, "order_id").select("kind", "order_id", number("target").alias("customer_id"), "balance", "nation", "other")


def _surfels(spark, sf_dir):
    """Each vector as a surfel: its place, its normal and a radius."""
    n = views.normals(spark, sf_dir)
    return n.select(F.col("obs_id").alias("surfel_id"), *[F.col(f"p{c}").alias(f"m{c}") for c in "xyz"], *[F.col(f"n{c}") for c in "xyz"], F.abs("pz").alias("radius"))


@query(f"""with {NRM} select obs_id as surfel_id, {', '.join(f'round(p{c}, 5) + 0.0 as {c}' for c in 'xyz')}, {', '.join(f'round(n{c}, 5) + 0.0 as normal_{c}' for c in 'xyz')}, round(greatest(abs(pz), 0.075::double), 5) as radius, true as coloured from nrm""")
def surfel_map_file(spark, sf_dir):
    """A surfel map, written and read back."""
    path = f"{shared_dir(spark)}/surfel-map-{uuid.uuid4().hex}"
    formats.write_surfel_map(_surfels(spark, sf_dir), path)
    m = spark.read.parquet(path).withColumn("coloured", F.col("rgb").between(0, (1 << 24) - 1)).drop("rgb")
    return rounded(m, dict.fromkeys([*"xyz", "normal_x", "normal_y", "normal_z", "radius"], 5))


@query(f"""with {NRM}, m as (select *, s as scan_id, 0.1::double * s as a from nrm, (select unnest(range(0, 5)) as s) where s = obs_id % 5 or s = (obs_id + 2) % 5)
 select scan_id, obs_id as surfel_id, scan_id * 0.5::double as t, round(cos(a) * (px - scan_id) + sin(a) * (py - 2 * scan_id), 5) + 0.0 as x, round(cos(a) * (py - 2 * scan_id) - sin(a) * (px - scan_id), 5) + 0.0 as y, round(pz, 5) + 0.0 as z from m""")
def scan_export(spark, sf_dir):
    """The surfels that each of five scans saw, in its own frame, written one folder a scan and read back."""
    s = _surfels(spark, sf_dir)
    members = s.select("surfel_id", F.explode(F.array(F.col("surfel_id") % 5, (F.col("surfel_id") + 2) % 5)).alias("scan_id"))
    k, a = F.col("id"), F.col("id") * F.lit(0.1)
    cos, sin, zero, one = F.cos(a), F.sin(a), F.lit(0.0), F.lit(1.0)
    inverse = F.array(cos, sin, zero, -cos * k - 2 * sin * k, -sin, cos, zero, sin * k - 2 * cos * k, zero, zero, one, zero, zero, zero, zero, one)
    scans = spark.range(5).select(k.alias("scan_id"), (k * F.lit(0.5)).alias("t"), inverse.alias("inverse"))
    path = f"{shared_dir(spark)}/scans-{uuid.uuid4().hex}"
    formats.export_scans(s, members, scans, path)
    out = spark.read.schema("t double, surfel_id long, x double, y double, z double, scan_id long").parquet(path)
    return rounded(out.select("scan_id", "surfel_id", "t", "x", "y", "z"), {"x": 5, "y": 5, "z": 5})
