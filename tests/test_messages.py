import random

from pyspark.sql import functions as F

from scanweave.operators import evaluate, messages, prefix


def test_ordinals_do_not_depend_on_the_bucket(spark):
    df = spark.range(100).select(F.col("id").alias("e"), (F.col("id") % 3).alias("k"))
    for width in (1, 7, 1000):
        got = prefix.ordinal(df, ["e"], F.floor(F.col("e") / width), ["k"]).collect()
        assert all(r.ordinal == r.e // 3 for r in got)


def test_previous_and_running_max_cross_empty_buckets(spark):
    rows = [(1, 5), (2, 9), (50, 3), (51, 4)]
    df = spark.createDataFrame(rows, "e long, v long")
    bucket = F.floor(F.col("e") / 10)
    assert {r.e: r.prev_v for r in prefix.previous(df, ["e"], bucket, ["v"]).collect()} == {1: None, 2: 5, 50: 9, 51: 3}
    assert {r.e: r.latest for r in prefix.running_max_before(df, ["e"], bucket, "v").collect()} == {1: None, 2: 5, 50: 9, 51: 9}


def _ticks(offsets, n=10):
    return [("s", topic, i / 10 + off, i * len(offsets) + j) for i in range(n) for j, (topic, off) in enumerate(offsets.items())]


def test_synchroniser_accepts_small_offsets_and_refuses_large(spark):
    schema = "stream string, topic string, t double, arrival long"
    close = spark.createDataFrame(_ticks({"/a": 1e-6, "/b": -1e-6}), schema)
    assert messages.synchronise(close, ["/a", "/b"], 1e-5).count() == 10
    far = spark.createDataFrame(_ticks({"/a": 0.01, "/b": -0.01}), schema)
    assert messages.synchronise(far, ["/a", "/b"], 1e-5).count() == 0
    three = spark.createDataFrame(_ticks({"/a": 123456789.01, "/b": 123456789.02, "/c": 123456789.03}), schema)
    assert messages.synchronise(three, ["/a", "/b", "/c"], 0.05).count() == 10


def test_late_rule_keeps_equality(spark):
    df = spark.createDataFrame([(0, 100), (1, 90), (2, 89), (3, 110)], "e long, t long")
    got = messages.drop_late(df, "t", "e", 10, F.lit(0)).collect()
    assert {r.e for r in got} == {0, 1, 3}


def test_as_of_interpolation_over_buckets(spark):
    s = spark.createDataFrame([(0, 0.0), (100, 10.0), (1000, 100.0)], "t long, v double")
    q = spark.createDataFrame([(-5,), (0,), (50,), (550,), (1000,), (1001,)], "t long")
    for width in (10, 10_000):
        got = {r.t: r.v_at for r in messages.as_of_interpolate(q, s, "t", "v", bucket=width).collect()}
        assert got == {-5: None, 0: 0.0, 50: 5.0, 550: 55.0, 1000: 100.0, 1001: None}


def test_motion_subsampler_resets(spark):
    rows = [("s", i, 0.1, 0.0) for i in range(10)]
    df = spark.createDataFrame(rows, "stream string, arrival long, distance double, angle double")
    assert [r.arrival for r in messages.subsample_motion(df, 0.25, 0.25).orderBy("arrival").collect()] == [2, 5, 8]


def test_match_nearest_against_brute_force(spark):
    rng = random.Random(1)
    a, b = ([(i, rng.randrange(2000)) for i in range(60)] for _ in range(2))
    da, db = spark.createDataFrame(a, "id long, t long"), spark.createDataFrame(b, "truth_id long, t long")
    got = {r.id: r.truth.truth_id for r in evaluate.match_nearest(da, db, 30).collect()}
    want = {}
    for i, t in a:
        near = sorted((abs(t - u), u, j) for j, u in b if abs(t - u) <= 30)
        if near:
            want[i] = {j for g, u, j in near if (g, u) == near[0][:2]}
    assert got.keys() == want.keys() and all(got[i] in want[i] for i in got)


def test_match_nearest_makes_no_pairs(spark):
    """Many rows at one time, times at the gap's border, keys and nulls."""
    a = spark.range(2000).select("id", F.lit("u").alias("k"), (F.col("id") % 20).alias("t"))
    b = spark.range(2000).select(F.col("id").alias("truth_id"), F.lit("u").alias("k"), (F.col("id") % 10 * 3 + 5).alias("t"))
    b = b.unionByName(spark.createDataFrame([(0, "v", 1), (1, None, 1), (2, "u", None)], "truth_id long, k string, t long"))
    out = evaluate.match_nearest(a, b, 4, keys=["k"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    got = {r.id: r.truth.truth_id for r in out.collect()}
    want = {}
    for i in range(2000):
        near = min((abs(i % 20 - (j % 10 * 3 + 5)), j % 10 * 3 + 5, j) for j in range(10))
        if near[0] <= 4:
            want[i] = near[2]
    assert got == want
