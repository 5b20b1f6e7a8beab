"""Text and binary formats: trajectories (TUM, KITTI), pose graphs (g2o), point clouds (PCD, packed binary points)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanweave.functions import poses
from scanweave.operators.messages import bracket

TUM = ("t", "tx", "ty", "tz", "qx", "qy", "qz", "qw")


def read_tum(spark: SparkSession, path: str) -> DataFrame:
    """Poses of trajectory files: (path, t, tx, ty, tz, qx, qy, qz, qw). Lines with # and lines that are not eight numbers
    are left out; of equal times in a file the first line stays."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("_line"), F.split(F.trim("value"), r"\s+").alias("_v"))
    rows = lines.where(~F.array_join("_v", " ").contains("#")).select("path", "_line", *[F.try_element_at("_v", F.lit(i + 1)).try_cast("double").alias(c) for i, c in enumerate(TUM)])
    rows = rows.where(F.expr(" and ".join(f"{c} is not null" for c in TUM)))
    first = rows.groupBy("path", "t").agg(F.min_by(F.struct(*TUM[1:]), "_line").alias("p"))
    return first.select("path", "t", "p.*")


def _number(c: str, digits: int = 9) -> Column:
    return F.format_string(f"%.{digits}f", F.col(c))


def write_tum(poses: DataFrame, path: str) -> None:
    """One text file in time order; a trajectory is one run's poses."""
    poses.orderBy("t").coalesce(1).select(F.concat_ws(" ", *[_number(c) for c in TUM]).alias("value")).write.text(path)


def write_kitti(poses: DataFrame, path: str) -> None:
    """Twelve numbers a line, the first three rows of each pose matrix, in time order; poses has (t, pose array of 16)."""
    poses.orderBy("t").coalesce(1).select(F.array_join(F.transform(F.slice("pose", 1, 12), lambda x: F.format_string("%.9e", x)), " ").alias("value")).write.text(path)


def read_kitti(spark: SparkSession, path: str, times: str | None = None) -> DataFrame:
    """(path, frame, pose array of 16) of files with twelve numbers a line; with a file of times, one a line, also t. Frames
    are counted by lines, so a file is read by one task; lines that are not twelve numbers are left out, and count."""

    def numbered(name: str) -> DataFrame:
        files = spark.read.text(name, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\\r?\\n")).alias("frame", "line"))
        return files.select("path", F.col("frame").cast("long").alias("frame"), F.split(F.trim("line"), r"\s+").alias("w"))

    numbers = F.transform("w", lambda x: x.try_cast("double"))
    rows = numbered(path).select("path", "frame", numbers.alias("v")).where("size(v) = 12 and not exists(v, x -> x is null)")
    poses_ = rows.select("path", "frame", F.concat("v", F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])).alias("pose"))
    if times is None:
        return poses_
    stamps = numbered(times).select("frame", F.col("w")[0].try_cast("double").alias("t")).where("t is not null")
    return poses_.join(stamps, "frame").select("path", "frame", "t", "pose")


def write_messages(messages: DataFrame, path: str) -> None:
    """A message file: one JSON object a line, in log order within each part, with all columns; nulls are left out."""
    messages.write.json(path)


def read_messages(spark: SparkSession, path: str, schema: str, topics: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Messages of files that write_messages wrote, of the given topics and classes (`kind`) where they are named. Lines that are
    no objects, or lack topic and time, are left out."""
    rows = spark.read.schema(schema).json(path).where("topic is not null and t is not null")
    rows = rows.where(F.col("topic").isin(*topics)) if topics else rows
    return rows.where(F.col("kind").isin(*kinds)) if kinds else rows


def ground_truth(messages: DataFrame, topic: str) -> DataFrame:
    """The TUM columns of a log's pose messages of one topic, the first of each time; ready for write_tum."""
    rows = messages.where(F.col("topic") == topic).where(" and ".join(f"{c} is not null" for c in TUM))
    first = rows.groupBy("t").agg(F.min_by(F.struct(*TUM[1:]), "arrival").alias("p"))
    return first.select("t", "p.*")


def log_run(spark: SparkSession, path: str, name: str, parameters: dict, results: dict | None = None) -> None:
    """Adds one run to a log of runs: a JSON object with its name, time, parameters and results, as texts."""
    text = lambda d: {str(k): str(v) for k, v in (d or {}).items()}
    row = spark.createDataFrame([(name, text(parameters), text(results))], "name string, parameters map<string, string>, results map<string, string>")
    row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(path)


def inject_before(odometry: DataFrame, clouds: DataFrame, lead: float = 0.01) -> DataFrame:
    """Both message tables as one log, in which an odometry message stands `lead` seconds before its time."""
    return odometry.withColumn("log_t", F.col("t") - lead).unionByName(clouds.withColumn("log_t", F.col("t")), allowMissingColumns=True)


def restamp(messages: DataFrame, header: str = "header_t", topics: list[str] | None = None) -> DataFrame:
    """Log times replaced by the messages' own, where they have one; optionally of some topics only."""
    messages = messages.where(F.col("topic").isin(*topics)) if topics else messages
    return messages.withColumn("t", F.coalesce(header, "t"))


#: Edge tags of graph files, numbers in their measurement, and parameter ids before it.
EDGES = {"EDGE_SE2": (3, 0), "EDGE_SE2_XY": (2, 0), "EDGE_SE2_BEARING": (1, 0), "EDGE_SE3:QUAT": (7, 0), "EDGE_SE3_XYZ": (3, 0), "EDGE_SE3_TRACKXYZ": (3, 1)}


def read_g2o(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(variables, factors) of graphs in 2-D and 3-D, poses and landmarks: variable (id, type, status, estimate), factor (type,
    variables, parameters, measurement, information as the upper triangle by rows). FIX lines set the status. Edges whose
    measurement is taken through a sensor offset name it after the variables (`parameters`)."""
    words = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("w"))
    numbers = lambda start, size=None: F.transform(F.slice("w", start, size if size else F.greatest(F.size("w") - (start - 1), F.lit(0))), lambda x: x.cast("double"))
    tag = F.col("w")[0]
    fixed = words.where(tag == "FIX").select(F.explode(F.slice("w", F.lit(2), F.size("w") - 1)).alias("id")).select(F.col("id").cast("long").alias("id")).distinct().withColumn("_fixed", F.lit(True))
    variables = words.where(tag.startswith("VERTEX")).select(F.col("w")[1].cast("long").alias("id"), tag.alias("type"), numbers(3).alias("estimate"))
    variables = variables.join(fixed, "id", "left").select("id", "type", F.when(F.col("_fixed"), "fixed").otherwise("active").alias("status"), "estimate")
    edges = words.where(tag.isin(*EDGES))
    table = F.create_map(*[x for name, sizes in EDGES.items() for x in (F.lit(name), F.array(*map(F.lit, sizes)))])
    edges = edges.withColumn("_s", table[tag])
    n, skip = F.col("_s")[0], F.col("_s")[1]
    part = lambda start, count: F.transform(F.slice("w", start, count), lambda x: x.cast("double"))
    rest = F.size("w") - 3 - skip - n
    factors = edges.select(tag.alias("type"), F.array(F.col("w")[1].cast("long"), F.col("w")[2].cast("long")).alias("variables"), F.transform(F.slice("w", F.lit(4), skip), lambda x: x.cast("long")).alias("parameters"), part(4 + skip, n).alias("measurement"), part(4 + skip + n, rest).alias("information"))
    return variables, factors


def write_g2o(variables: DataFrame, factors: DataFrame, path: str) -> None:
    """Vertices, then fixed ids, then edges."""
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    v = variables.select(F.lit(0).alias("k"), F.col("id"), F.concat_ws(" ", "type", "id", text("estimate")).alias("value"))
    fix = variables.where("status = 'fixed'").select(F.lit(1).alias("k"), F.col("id"), F.concat(F.lit("FIX "), F.col("id").cast("string")).alias("value"))
    e = factors.select(F.lit(2).alias("k"), F.col("variables")[0].alias("id"), F.concat_ws(" ", "type", text("variables"), *([text("parameters")] if "parameters" in factors.columns else []), text("measurement"), text("information")).alias("value"))
    e = e.withColumn("value", F.regexp_replace("value", " +", " "))
    v.unionByName(fix).unionByName(e).orderBy("k", "id").select("value").write.text(path)


#: The field type codes of packed clouds.
FIELD_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}
CLOUD = "height int, width int, is_bigendian boolean, point_step int, row_step int, fields array<struct<name string, offset int, datatype smallint, count int>>, data binary, is_dense boolean"


def _layout(fields, step: int, big: bool) -> np.dtype:
    order = ">" if big else "<"
    return np.dtype({"names": [f["name"] for f in fields], "formats": [order + FIELD_TYPES[f["datatype"]] for f in fields], "offsets": [f["offset"] for f in fields], "itemsize": step})


def decode_clouds(clouds: DataFrame, names: tuple[str, ...] = ("x", "y", "z"), keep_invalid: bool = False) -> DataFrame:
    """One row per point: scan_id, point_id, the named fields. Points with a value that is not finite are left out, unless
    they are kept with their row and column (organised clouds)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                layout = _layout(r.fields, r.point_step, r.is_bigendian)
                rows = [np.frombuffer(r.data, layout, r.width, row * r.row_step) for row in range(r.height)]
                points = np.concatenate(rows) if rows else np.zeros(0, layout)
                out = pd.DataFrame({"scan_id": np.full(len(points), r.scan_id), "point_id": np.arange(len(points)), "row": np.arange(len(points)) // max(1, r.width), "col": np.arange(len(points)) % max(1, r.width), **{n: points[n].astype(float) if n in layout.names else np.nan for n in names}})
                yield out if keep_invalid else out[np.isfinite(out[list(names)]).all(axis=1)]

    columns = ["scan_id", *[c.split(" ")[0] for c in CLOUD.split(", ") if c.split(" ")[0] in ("height", "width", "is_bigendian", "point_step", "row_step", "data")], "fields"]
    return clouds.select(*columns).mapInPandas(run, "scan_id long, point_id long, row int, col int, " + ", ".join(f"{n} double" for n in names))


def encode_clouds(points: DataFrame, names: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """One packed cloud (scan_id and CLOUD) per scan, 32-bit little-endian floats, points in point_id order."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("point_id", kind="stable")
        data = np.ascontiguousarray(f[list(names)].to_numpy(), "<f4")
        fields = [{"name": n, "offset": 4 * i, "datatype": 7, "count": 1} for i, n in enumerate(names)]
        step = 4 * len(names)
        return pd.DataFrame([{"scan_id": f["scan_id"].iloc[0], "height": 1, "width": len(f), "is_bigendian": False, "point_step": step, "row_step": step * len(f), "fields": fields, "data": data.tobytes(), "is_dense": bool(np.isfinite(data).all())}])

    return points.select("scan_id", "point_id", *names).groupBy("scan_id").applyInPandas(run, f"scan_id long, {CLOUD}")


def write_surfel_map(surfels: DataFrame, path: str) -> None:
    """Parquet of x, y, z, normals, a colour that depends on the id alone, and the radius with its floor."""
    colour = F.pmod(F.xxhash64("surfel_id"), F.lit(1 << 24)).cast("int")
    surfels.select("surfel_id", *[F.col(f"m{c}").alias(c) for c in "xyz"], *[F.col(f"n{c}").alias(f"normal_{c}") for c in "xyz"], colour.alias("rgb"), F.greatest("radius", F.lit(0.075)).alias("radius")).write.parquet(path)


def export_scans(surfels: DataFrame, members: DataFrame, poses: DataFrame, path: str) -> None:
    """Surfels in the frame of every scan that saw them, one folder a scan; poses has (scan_id, t, inverse array of 16)."""
    rows = members.join(surfels, "surfel_id").join(poses, "scan_id")
    p, w = [F.col(f"m{c}") for c in "xyz"], F.col("inverse")
    local = [w[4 * i] * p[0] + w[4 * i + 1] * p[1] + w[4 * i + 2] * p[2] + w[4 * i + 3] for i in range(3)]
    rows.select("scan_id", "t", "surfel_id", *[c.alias(n) for c, n in zip(local, "xyz", strict=True)]).write.partitionBy("scan_id").parquet(path)


def tf_lookup(queries: DataFrame, events: DataFrame, tolerance: float = 1e-8, bucket: float = 3600.0) -> DataFrame:
    """queries (child, t, ...) with `pose`, the pose of the child in its parent at t, from transform events (child, t, tx..qw).

    Exact at an event, else between the events on both sides: linear in translation, spherical in rotation. t = 0 asks for
    the latest event. Adds `before` and `after`, the share u, and status: no_data with fewer than two events, before_first
    and after_last outside them; there pose is null. Events of one child at one time: the first by translation counts.
    """
    samples = events.groupBy("child", "t").agg(F.min(F.struct(*TUM[1:])).alias("e"))
    known = samples.groupBy("child").agg(F.count("*").alias("_n"), F.max("t").alias("_last"))
    asked = queries.join(known, "child", "left").withColumn("_asked", F.col("t"))
    asked = asked.withColumn("t", F.when(F.col("t") == 0, F.coalesce("_last", "t")).otherwise(F.col("t")))
    out = bracket(asked, samples, "t", "e", ["child"], bucket)
    flat = lambda c: F.struct(F.col(f"{c}.t").alias("et"), *[F.col(f"{c}.v.{n}").alias(n) for n in TUM[1:]])
    gap = F.col("after.t") - F.col("before.t")
    status = F.when(F.coalesce("_n", F.lit(0)) < 2, "no_data").when(F.col("before").isNull(), "before_first").when(F.col("after").isNull(), "after_last").otherwise("ok")
    u = F.when(gap > tolerance, (F.col("t") - F.col("before.t")) / gap).otherwise(0.0)
    out = out.withColumns({"u": u, "status": status})
    pose = poses.struct(poses.interpolate(*[poses.of(F.col(f"{c}.v")) for c in ("before", "after")], F.col("u")))
    out = out.withColumn("pose", F.when(F.col("status") == "ok", pose))
    sides = [F.when(F.col(c).isNotNull(), flat(c)).alias(c) for c in ("before", "after")]
    return out.select(*[F.col("_asked").alias("t") if c == "t" else c for c in queries.columns], *sides, "u", "status", "pose")


def tf_chain(queries: DataFrame, events: DataFrame, parents: dict[str, str], bucket: float = 3600.0) -> DataFrame:
    """queries (query_id, target, reference, t) with `pose`, that of target in the frame of reference at t, and status.

    parents names the parent of each frame: the sensor model, a small tree. Both frames are followed to their common
    ancestor; every link on the way is looked up at t, and the links are multiplied in order: up from the reference by inverses,
    then down to the target. Status is that of the first link that fails, or no_path.
    """

    def ancestors(x: str) -> list[str]:
        out = [x]
        while out[-1] in parents and len(out) <= len(parents):
            out.append(parents[out[-1]])
        return out

    frames = sorted({*parents, *parents.values()})
    steps = []
    for target in frames:
        for reference in frames:
            up, down = ancestors(reference), ancestors(target)
            common = next((x for x in up if x in down), None)
            if common is not None:
                links = [(x, True) for x in up[: up.index(common)]] + [(x, False) for x in reversed(down[: down.index(common)])]
                steps.append((target, reference, [(i, x, back) for i, (x, back) in enumerate(links)]))
    spark = queries.sparkSession
    paths = F.broadcast(spark.createDataFrame(steps, "target string, reference string, links array<struct<i: int, child: string, back: boolean>>"))  # frames squared
    asked = queries.join(paths, ["target", "reference"], "left")
    each = asked.select("query_id", "t", F.explode("links").alias("l")).select("query_id", "t", "l.i", "l.child", "l.back")
    found = tf_lookup(each, events, bucket=bucket)
    p = poses.of(F.col("pose"))
    moved = found.withColumn("pose", F.when(F.col("back"), poses.struct(poses.inverse(p))).otherwise(F.col("pose")))
    parts = moved.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("i", "status", "pose"))).alias("_parts"))  # as many as the tree is deep
    unit = F.struct(*[F.lit(1.0 if n == "qw" else 0.0).alias(n) for n in poses.FIELDS])
    whole = F.aggregate("_parts", unit, lambda a, x: poses.struct(poses.compose(poses.of(a), poses.of(x["pose"]))))
    bad = F.filter("_parts", lambda x: x["status"] != "ok")
    out = asked.join(parts, "query_id", "left").withColumn("_bad", bad)
    status = F.when(F.col("links").isNull(), "no_path").when(F.size("_bad") > 0, F.col("_bad")[0]["status"]).otherwise("ok")
    out = out.withColumn("status", status)
    pose = F.when(F.col("status") == "ok", F.when(F.size("links") == 0, unit).otherwise(whole))
    return out.select("query_id", "target", "reference", "t", "status", pose.alias("pose"))
