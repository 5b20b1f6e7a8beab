import numpy as np
import pytest
from pyspark.sql import functions as F

from scanweave.operators import messages
from scanweave.sources import formats
from scanweave.streaming import operators as streaming


def test_tum_reader_rules_and_round_trip(spark, tmp_path):
    (tmp_path / "a.tum").write_text("# comment\n1.0 1 2 3 0 0 0 1\n2.5 4 5 6 0 0 0 1\n1.0 9 9 9 0 0 0 1\nbad line\n\n")
    got = {r.t: (r.tx, r.qw) for r in formats.read_tum(spark, f"{tmp_path}/a.tum").collect()}
    assert got == {1.0: (1.0, 1.0), 2.5: (4.0, 1.0)}
    formats.write_tum(formats.read_tum(spark, f"{tmp_path}/a.tum"), f"{tmp_path}/out")
    again = {r.t: (r.tx, r.qw) for r in formats.read_tum(spark, f"{tmp_path}/out").collect()}
    assert again == got


def test_g2o_round_trip(spark, tmp_path):
    info3, info2 = " ".join(map(str, range(21))), " ".join(map(str, range(6)))
    text = f"VERTEX_SE3:QUAT 0 0 0 0 0 0 0 1\nVERTEX_SE3:QUAT 1 1 0 0 0 0 0 1\nVERTEX_SE2 7 1 2 0.5\nVERTEX_SE2 8 1 2 0.5\nFIX 0\nEDGE_SE3:QUAT 0 1 1 0 0 0 0 0 1 {info3}\nEDGE_SE2 7 8 0.1 0.2 0.3 {info2}\n"
    (tmp_path / "g.g2o").write_text(text)
    v, f = formats.read_g2o(spark, f"{tmp_path}/g.g2o")
    assert {(r.id, r.status, len(r.estimate)) for r in v.collect()} == {(0, "fixed", 7), (1, "active", 7), (7, "active", 3), (8, "active", 3)}
    assert {(tuple(r.variables), len(r.measurement), len(r.information)) for r in f.collect()} == {((0, 1), 7, 21), ((7, 8), 3, 6)}
    formats.write_g2o(v, f, f"{tmp_path}/out")
    v2, f2 = formats.read_g2o(spark, f"{tmp_path}/out")
    assert sorted(map(str, v.collect())) == sorted(map(str, v2.collect())) and sorted(map(str, f.collect())) == sorted(map(str, f2.collect()))


def test_packed_clouds(spark):
    rng = np.random.default_rng(1)
    rows = [(s, i, *map(float, rng.normal(size=3).astype("f4"))) for s in range(3) for i in range(50)] + [(3, 0, float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "scan_id long, point_id long, x double, y double, z double")
    clouds = formats.encode_clouds(df)
    got = sorted((r.scan_id, r.point_id, r.x, r.y, r.z) for r in formats.decode_clouds(clouds).collect())
    assert got == rows[:-1]
    assert formats.decode_clouds(clouds, keep_invalid=True).count() == 151


def test_transform_lookup(spark):
    e = spark.createDataFrame([("a", 1.0, *[0.0] * 6, 1.0), ("a", 3.0, 2.0, *[0.0] * 5, 1.0), ("b", 1.0, *[0.0] * 6, 1.0)], "child string, t double, tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    q = spark.createDataFrame([("a", 2.0), ("a", 3.0), ("a", 0.5), ("a", 4.0), ("b", 1.0)], "child string, t double")
    got = {(r.child, r.t): (r.status, r.u if r.status == "ok" else None) for r in formats.tf_lookup(q, e).collect()}
    assert got == {("a", 2.0): ("ok", 0.5), ("a", 3.0): ("ok", 0.0), ("a", 0.5): ("before_first", None), ("a", 4.0): ("after_last", None), ("b", 1.0): ("no_data", None)}


def test_sorter_rules():
    s = streaming.Sorter(1.0, 5.0)
    out = [x for i, t in enumerate([0.0, 0.5, 2.0, 1.8, 10.0, 5.0, 4.9]) for x in s.push(t, i)]
    assert [a for _, a in out] == [0, 1, 3, 2, 5] and s.dropped == 1 and s.flush() == [(10.0, 4)]


MESSAGES = "stream string, topic string, t double, arrival long, distance double, angle double"


@pytest.fixture
def log(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(f"s{i % 3}", f"/{'ab'[int(rng.integers(2))]}", i * 0.1 + float(rng.normal(0, 0.5)), i, float(rng.uniform(0, 0.1)), 0.0) for i in range(600)]
    df = spark.createDataFrame(rows, MESSAGES)
    for k in range(4):
        df.where((F.col("arrival") >= 150 * k) & (F.col("arrival") < 150 * (k + 1))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log/k{k}")
    return df, f"{tmp_path}/log/*"


def replayed(spark, path, make, tmp_path, name):
    stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(path)
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/ck-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_streams_equal_batches(spark, log, tmp_path):
    df, path = log
    got = replayed(spark, path, lambda s: streaming.synchronise_stream(s, ["/a", "/b"], 0.3), tmp_path, "synced")
    want = messages.synchronise(df, ["/a", "/b"], 0.3)
    key = lambda d: sorted((r.stream, r.pack, r.t, tuple(r.arrivals)) for r in d.collect())
    assert key(got) == key(want) != []
    got = replayed(spark, path, lambda s: streaming.subsample_stream(s, 0.25, 0.25), tmp_path, "thinned")
    assert sorted(r.arrival for r in got.collect()) == sorted(r.arrival for r in messages.subsample_motion(df, 0.25, 0.25).collect())
    got = replayed(spark, path, lambda s: streaming.sort_stream(s, 1.0, 5.0), tmp_path, "ordered")
    whole = {s: [] for s in ("s0", "s1", "s2")}
    for r in streaming.sort_batch(df).orderBy("stream", "place").collect():
        whole[r.stream].append(r.arrival)
    sent = {(r.stream, r.arrival) for r in got.collect()}
    held = {s: [a for a in own if (s, a) not in sent] for s, own in whole.items()}
    assert len(sent) > 500 and all(own == whole[s][len(whole[s]) - len(own) :] for s, own in held.items())


def test_landmark_graphs_are_read_back(spark, tmp_path):
    text = """VERTEX_SE2 0 1 2 0.5
VERTEX_XY 1 3 4
FIX 0
EDGE_SE2_XY 0 1 2.5 1.5 10 0 20
VERTEX_SE3:QUAT 2 0 0 0 0 0 0 1
VERTEX_TRACKXYZ 3 1 2 3
PARAMS_SE3OFFSET 7 0 0 0 0 0 0 1
EDGE_SE3_TRACKXYZ 2 3 7 1 2 3 1 0 0 1 0 1
"""
    (tmp_path / "a.g2o").write_text(text)
    variables, factors = formats.read_g2o(spark, str(tmp_path / "a.g2o"))
    assert {r.id: (r.type, r.status, r.estimate) for r in variables.collect()} == {0: ("VERTEX_SE2", "fixed", [1.0, 2.0, 0.5]), 1: ("VERTEX_XY", "active", [3.0, 4.0]), 2: ("VERTEX_SE3:QUAT", "active", [0.0] * 6 + [1.0]), 3: ("VERTEX_TRACKXYZ", "active", [1.0, 2.0, 3.0])}
    got = {r.type: (r.variables, r.parameters, r.measurement, r.information) for r in factors.collect()}
    assert got == {"EDGE_SE2_XY": ([0, 1], [], [2.5, 1.5], [10.0, 0.0, 20.0]), "EDGE_SE3_TRACKXYZ": ([2, 3], [7], [1.0, 2.0, 3.0], [1.0, 0.0, 0.0, 1.0, 0.0, 1.0])}
    formats.write_g2o(variables, factors, str(tmp_path / "b"))
    again = formats.read_g2o(spark, str(tmp_path / "b"))
    assert sorted(map(str, again[1].collect())) == sorted(map(str, factors.collect())) and sorted(map(str, again[0].collect())) == sorted(map(str, variables.collect()))


def test_kitti_message_and_run_files(spark, tmp_path):
    (tmp_path / "poses.txt").write_text("1 0 0 5 0 1 0 6 0 0 1 7\nbad\n1 0 0 8 0 1 0 9 0 0 1 10\n")
    (tmp_path / "times.txt").write_text("0.5\n0.6\n0.7\n")
    got = [(r.frame, r.t, r.pose) for r in formats.read_kitti(spark, str(tmp_path / "poses.txt"), str(tmp_path / "times.txt")).orderBy("frame").collect()]
    assert got == [(0, 0.5, [1.0, 0, 0, 5, 0, 1, 0, 6, 0, 0, 1, 7, 0, 0, 0, 1]), (2, 0.7, [1.0, 0, 0, 8, 0, 1, 0, 9, 0, 0, 1, 10, 0, 0, 0, 1])]
    schema = "topic string, kind string, t double, arrival long, " + ", ".join(f"{c} double" for c in formats.TUM[1:])
    rows = [("/odom", "Odometry", 1.0, 0, *[0.0] * 6, 1.0), ("/odom", "Odometry", 1.0, 1, *[9.0] * 6, 1.0), ("/cloud", "Cloud", 2.0, 2, *[None] * 7), ("/odom", "Odometry", 3.0, 3, *[2.0] * 6, 1.0)]
    df = spark.createDataFrame(rows, schema)
    formats.write_messages(df, str(tmp_path / "log"))
    (tmp_path / "log" / "part-99999.json").write_text("not an object\n{}\n")
    assert sorted(map(str, formats.read_messages(spark, str(tmp_path / "log"), schema).collect())) == sorted(map(str, df.collect()))
    assert formats.read_messages(spark, str(tmp_path / "log"), schema, ["/cloud"], ["Cloud"]).count() == 1
    assert [(r.t, r.tx) for r in formats.ground_truth(df, "/odom").orderBy("t").collect()] == [(1.0, 0.0), (3.0, 2.0)]
    for i in range(2):
        formats.log_run(spark, str(tmp_path / "runs"), f"run{i}", {"leaf_size": 0.2, "iterations": i}, {"chi": 1.5})
    logged = spark.read.schema("name string, parameters map<string, string>, results map<string, string>, at timestamp").json(str(tmp_path / "runs")).collect()
    assert {(r.name, r.parameters["iterations"], r.results["chi"]) for r in logged} == {("run0", "0", "1.5"), ("run1", "1", "1.5")} and all(r["at"] for r in logged)
