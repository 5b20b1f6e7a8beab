import numpy as np
from pyspark.sql import functions as F

from scanweave.operators import noise
from scanweave.sources import config

TEXT = """
// a runner and its source
"Runner" { "#id" : 1, "source" : { "#pointer" : 2 }, "rate" : 0.5, "names" : ["a", "b // c"], "on" : true }
"Source" { "#id" : 2, "topic" : "/points", "skip" : -3, "next" : { "#pointer" : 9 } }
"""


def test_configurations_round_trip():
    runner, source = config.read(TEXT)
    assert runner.kind == "Runner" and runner.properties["source"] is source and runner.properties["names"] == ["a", "b // c"]
    assert source.properties == {"topic": "/points", "skip": -3, "next": None} and runner.properties["on"] is True
    again = config.read(config.write([runner, source]))
    assert again[0].properties["source"] is again[1] and again[0].properties["rate"] == 0.5


def test_noise_is_seeded_and_normal(spark):
    df = spark.range(20_000).select(F.col("id").alias("scan_id"), F.col("id").alias("point_id"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("z"))
    a, b = (noise.disturb_points(d, 0.5).orderBy("scan_id").toPandas() for d in (df, df.repartition(7)))
    assert (a == b).all().all()
    assert np.allclose(a[["x", "y", "z"]].mean(), [1, 2, 3], atol=0.02) and np.allclose(a[["x", "y", "z"]].std(), 0.5, atol=0.02)
    assert abs(np.corrcoef(a["x"], a["y"])[0, 1]) < 0.03


def test_factor_overwrites_and_samples(spark):
    f = spark.createDataFrame([(1, "gps", [1.0, 2.0], []), (2, "other", [1.0], [])], "factor_id long, type string, measurement array<double>, information array<double>")
    got = {r.factor_id: r for r in noise.overwrite_information(noise.disturb_measurements(f, 0.1, ["gps"]), {"gps": [4.0, 9.0]}).collect()}
    assert got[1].information == [4.0, 0.0, 9.0] and got[1].measurement != [1.0, 2.0] and got[2].measurement == [1.0] and got[2].information == []
    rows = spark.range(2000).withColumn("w", F.when(F.col("id") < 1000, 9.0).otherwise(1.0))
    drawn = noise.weighted_sample(rows, "w", 200, ["id"]).collect()
    assert len(drawn) == 200 and 160 < sum(r.id < 1000 for r in drawn) < 200
    assert spark.createDataFrame([(1e10,), (1e-10,), (-1e10,)], "v double").agg(noise.exact_sum("v")).first()[0] == 1e-10
