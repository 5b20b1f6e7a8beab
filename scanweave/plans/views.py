"""Canonical inputs of the operators, read from the tables in a folder; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id (arrival), topic, frame, t (microseconds), value."""
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("topic"), F.col("user_id").alias("frame"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("t"), "value")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_id, point_id, x, y, z."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("scan_id"), F.col("vec_id").alias("point_id"), *[e[i].cast("double").alias(c) for i, c in enumerate("xyz")])


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """surfel_id, scan_id, m and w in integers (cents and hundredths), so that sums do not depend on their order."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("surfel_id"), F.col("l_suppkey").alias("scan_id"), cents.alias("m"), (100 - F.round(F.col("l_discount") * 100).cast("long")).alias("w"))


def normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """surfel_id, obs_id, px..pz, and nx..nz normalised."""
    e = [F.col("embedding")[i].cast("double") for i in range(6)]
    norm = F.sqrt(e[3] * e[3] + e[4] * e[4] + e[5] * e[5])
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("surfel_id"), F.col("vec_id").alias("obs_id"), *[e[i].alias(f"p{c}") for i, c in enumerate("xyz")], *[(e[3 + i] / norm).alias(f"n{c}") for i, c in enumerate("xyz")])


MSGS = "msgs as (select event_id, event_type as topic, user_id as frame, epoch_us(ts) as t, value from events)"
PTS = "pts as (select label as scan_id, vec_id as point_id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[3] as double) as z from embeddings)"
OBS = "obs as (select l_partkey as surfel_id, l_suppkey as scan_id, cast(round(l_extendedprice * 100) as bigint) as m, 100 - cast(round(l_discount * 100) as bigint) as w from lineitem)"
NRM = """e as (select label as surfel_id, vec_id as obs_id, [cast(x as double) for x in embedding[1:6]] as v from embeddings),
 nrm as (select surfel_id, obs_id, v[1] as px, v[2] as py, v[3] as pz, v[4] / sqrt(v[4]*v[4]+v[5]*v[5]+v[6]*v[6]) as nx, v[5] / sqrt(v[4]*v[4]+v[5]*v[5]+v[6]*v[6]) as ny, v[6] / sqrt(v[4]*v[4]+v[5]*v[5]+v[6]*v[6]) as nz from e)"""


def range_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organised clouds of 8 x 8 cells, one for each vector: image, row, col, x, y, z of a spherical range image."""
    each = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("i", "v"))
    row, col = F.floor(F.col("i") / 8), (F.col("i") % 8).cast("long")
    d = each.select("image", row.alias("row"), col.alias("col"), (5 + F.col("v").cast("double")).alias("r"))
    d = d.withColumns({"t": (F.col("col") - 3.5) * 0.1, "p": (3.5 - F.col("row")) * 0.1})
    return d.select("image", "row", "col", F.expr("r * cos(p) * cos(t)").alias("x"), F.expr("r * cos(p) * sin(t)").alias("y"), F.expr("r * sin(p)").alias("z"))


RANGES = """rv as (select vec_id as image, (i - 1) // 8 as "row", (i - 1) % 8 as col, 5 + embedding[i]::double as r from (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings)),
 ra as (select *, (col - 3.5::double) * 0.1::double as t, (3.5::double - "row") * 0.1::double as p from rv),
 rng as (select image, "row", col, r * cos(p) * cos(t) as x, r * cos(p) * sin(t) as y, r * sin(p) as z from ra)"""
