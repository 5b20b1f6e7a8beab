"""Recorder files: codec, index, pruning, damage, and what Spark reads and writes."""

import os
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan

from scanweave.sources import rosbag, rosmsg
from scanweave.sources.rosbag import BagBuilder, BagReader


def some(kind):
    """A message of a kind with a value in every field."""
    count = iter(range(1, 10_000))

    def of(t):
        name = t.typeName()
        if name == "struct":
            return {f.name: of(f.dataType) for f in t.fields}
        if name == "array":
            return [of(t.elementType) for _ in range(2)]
        n = next(count)
        return {"string": f"name é {n}", "binary": bytes([n % 256, 255]), "boolean": True, "long": n * 1_000_000_007, "short": n % 100, "integer": n, "float": n / 4, "double": n / 8}[name]

    return of(rosmsg.spark_type(kind))


@pytest.mark.parametrize("kind", rosmsg.KINDS)
def test_messages_round_trip(kind):
    m = some(kind)
    for name, t, length, _ in rosmsg.fields(rosmsg.DEFINITIONS[kind]):
        if isinstance(length, int):
            m[name] = [float(i) for i in range(length)]
    if "header" in m:
        m["header"]["seq"] = 7
    for key in ("pose", "twist"):  # covariances have a fixed length
        if key in m and "covariance" in m[key]:
            m[key]["covariance"] = [float(i) for i in range(36)]
    for key in [k for k, v in m.items() if isinstance(v, int) and v > 1 << 31]:
        m[key] = 9
    if kind == "sensor_msgs/CameraInfo":
        m["roi"] = {"x_offset": 1, "y_offset": 2, "height": 3, "width": 4, "do_rectify": True}
    if kind == "sensor_msgs/PointCloud2":
        m["fields"] = [{"name": "x", "offset": 0, "datatype": 7, "count": 1}]
    if kind == "tf2_msgs/TFMessage":
        for t in m["transforms"]:
            t["header"]["seq"] = 1
    data = rosmsg.pack(m, kind)
    assert rosmsg.unpack(data, kind) == m
    with pytest.raises(struct.error):
        rosmsg.unpack(data + b"x", kind)
    with pytest.raises(struct.error):
        rosmsg.unpack(data[:-1], kind)


@pytest.mark.parametrize("kind", rosmsg.KINDS)
def test_columns_are_packed_as_messages_are(spark, kind):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    def empty(v):
        """The same with each second value left out."""
        return {k: empty(x) if isinstance(x, dict) else x for i, (k, x) in enumerate(v.items()) if i % 2}

    def small(v):
        if isinstance(v, dict):
            return {k: small(x) for k, x in v.items()}
        return [small(x) for x in v] if isinstance(v, list) else v % 100 if isinstance(v, int) and not isinstance(v, bool) else v

    m = small(some(kind))
    full = {**m}
    for name, _, length, _ in rosmsg.fields(rosmsg.DEFINITIONS[kind]):
        if isinstance(length, int):
            full[name] = [i - 0.5 for i in range(length)]
    for rows in ([m, None, empty(m), {}, full], [full] * 3, [None], []):
        column = pa.array(rows, to_arrow_type(rosmsg.spark_type(kind)))
        assert rosmsg.pack_all(column, kind) == [None if r is None else rosmsg.pack(r, kind) for r in rows]
    column = pa.array([None, *[full] * 4], column.type)[2:]  # a slice
    assert rosmsg.pack_all(column, kind) == [rosmsg.pack(full, kind)] * 3


def test_numbers_out_of_range_are_refused_in_columns():
    import pyarrow as pa

    rows = pa.array([{"header": {"seq": -1, "stamp": 0, "frame_id": "a"}}])
    with pytest.raises(struct.error):
        rosmsg.pack_all(rows, "geometry_msgs/PointStamped")


def test_the_log_is_encoded_once(spark, monkeypatch):
    """Ranges are found from the log, before it is encoded."""
    from scanweave.plans import recorded

    encoded = spark.sparkContext.accumulator(0)
    whole = rosmsg.pack_all
    monkeypatch.setattr(rosmsg, "pack_all", lambda column, kind: (encoded.add(len(column)), whole(column, kind))[1])
    recorded.bag_log(spark, "/root/testdata/sf0.001").collect()
    assert encoded.value == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_digests_are_the_public_ones():
    assert rosmsg.digest("std_msgs/Header") == "2176decaecbce78abc3b96ef049fabed"
    assert rosmsg.digest("sensor_msgs/Imu") == "6a62c6daae103f4ff57a132d6f95cec2"
    assert rosmsg.digest("nav_msgs/Odometry") == "cd5e73d190d741a2f92e81eda573aca7"
    assert rosmsg.digest("sensor_msgs/PointCloud2") == "1158d486dd51d683ce2f1be655c3c181"
    assert rosmsg.digest("tf2_msgs/TFMessage") == "94810edda583a504dfda3829e70d7eec"


def messages(spark, n=400):
    rows = [(["/a", "/b", "/c"][(i // 50) % 3], 1_600_000_000_000_000_000 + i * 1_000_000, {"header": {"seq": i, "stamp": i, "frame_id": f"f{i % 7}"}, "point": {"x": i / 2, "y": -1.0, "z": 0.0}}) for i in range(n)]
    schema = "topic string, t long, message struct<header: struct<seq: long, stamp: long, frame_id: string>, point: struct<x: double, y: double, z: double>>"
    return spark.createDataFrame(rows, schema).coalesce(1)


@pytest.mark.parametrize("compression", ["none", "bz2", "lz4"])
def test_bags_are_written_and_read(spark, tmp_path, compression):
    m = messages(spark)
    rosbag.write_bags(rosmsg.encode(m, "geometry_msgs/PointStamped"), f"file://{tmp_path}/bags", compression=compression, chunk_bytes=2000, bag_bytes=5000)
    names = os.listdir(f"{tmp_path}/bags")
    assert len(names) > 1 and all(n.endswith(".bag") and n[0] != "." for n in names)
    got = rosmsg.decode(rosbag.read_bags(spark, f"file://{tmp_path}/bags", split_bytes=500), "geometry_msgs/PointStamped")
    assert got.rdd.getNumPartitions() > 3
    key = lambda r: r.message.header.seq
    want = sorted(m.collect(), key=key)
    assert [(r.topic, r.t, r.message.asDict(True)) for r in sorted(got.collect(), key=key)] == [(r.topic, r.t, r.message.asDict(True)) for r in want]
    found = {r.topic: r.messages for r in rosbag.topics(spark, f"{tmp_path}/bags").groupBy("topic").agg(F.sum("messages").alias("messages")).collect()}
    assert found == {"/a": 150, "/b": 150, "/c": 100}


def one_bag(path, chunks=8, each=5):
    bag = BagBuilder("lz4")
    for c in range(chunks):
        for i in range(each):
            n = c * each + i
            bag.add("/odd" if c % 2 else "/even", "geometry_msgs/PointStamped", n, None, rosmsg.pack({"header": {"seq": n}}, "geometry_msgs/PointStamped"))
        bag.flush()
    path.write_bytes(bag.bytes())
    return rosbag.contents(str(path))


def chunks_of(reader):
    return [at for p in reader.partitions() for at in p.chunks]


def test_filters_skip_chunks(spark, tmp_path):
    found = one_bag(tmp_path / "x.bag")
    at = [c.at for c in found.chunks]
    reader = BagReader({"path": str(tmp_path / "x.bag"), "split_bytes": 1})
    kept = IsNotNull(("path",))
    assert list(reader.pushFilters([EqualTo(("topic",), "/odd"), kept])) == [kept] and chunks_of(reader) == at[1::2]
    reader = BagReader({"path": str(tmp_path / "x.bag"), "split_bytes": 1})
    list(reader.pushFilters([GreaterThanOrEqual(("t",), 12), LessThan(("t",), 25)]))
    assert chunks_of(reader) == at[2:5]
    reader = BagReader({"path": str(tmp_path / "x.bag"), "split_bytes": 1})
    list(reader.pushFilters([In(("topic",), ("/odd", "/none")), LessThan(("t",), 5)]))
    assert chunks_of(reader) == []
    # through Spark the filter does not come back, and the rows are those that it asks for
    df = rosbag.read_bags(spark, f"{tmp_path}/*.bag").where("topic = '/odd' and t >= 17 and t < 27")
    assert sorted(r.t for r in df.collect()) == [17, 18, 19, 25, 26] and {r.chunk for r in df.collect()} == {at[3], at[5]}
    assert "/odd" not in df._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]
    assert rosbag.read_bags(spark, f"{tmp_path}/*.bag").where("type = 'nothing'").count() == 0


def test_cut_off_bags_report_and_keep_what_is_there(spark, tmp_path):
    found = one_bag(tmp_path / "whole.bag")
    data = (tmp_path / "whole.bag").read_bytes()
    last = found.chunks[-1].at
    for name, cut in (("middle", last + 60), ("between", last), ("header", last + 2)):
        (tmp_path / f"{name}.bag").write_bytes(data[:cut])
        rows = rosbag.read_bags(spark, f"{tmp_path}/{name}.bag").collect()
        good = [r for r in rows if r.damage is None]
        bad = [r for r in rows if r.damage is not None]
        assert sorted(r.t for r in good) == list(range(35)) and len(bad) == 1 and bad[0].chunk == last and f"byte {last}" in bad[0].damage
    # a damaged chunk in a bag with an index costs that chunk only
    broken = bytearray(data)
    broken[found.chunks[2].at + 80 : found.chunks[2].at + 90] = b"\0" * 10
    (tmp_path / "broken.bag").write_bytes(broken)
    rows = rosbag.read_bags(spark, f"{tmp_path}/broken.bag").collect()
    assert [r.chunk for r in rows if r.damage] == [found.chunks[2].at] and sum(r.damage is None for r in rows) >= 35
    (tmp_path / "no.bag").write_bytes(b"something else")
    with pytest.raises(Exception, match="no bag of format"):
        rosbag.read_bags(spark, f"{tmp_path}/no.bag").collect()


def test_kinds_of_other_definitions_decode(spark, tmp_path):
    text = f"Header header  # a comment\nstring WHAT=a # b\nthing/Part[] parts\nuint64 big\nduration[2] waits\n{'=' * 80}\nMSG: thing/Part\nint16[3] v\n{'=' * 80}\nMSG: std_msgs/Header\n{rosmsg.DEFINITIONS['std_msgs/Header']}"
    own = rosmsg.known(text, "thing/Whole")
    m = {"header": {"seq": 1, "stamp": 2, "frame_id": "x"}, "parts": [{"v": [1, -2, 3]}], "big": 5, "waits": [-3, 4_000_000_000]}
    bag = BagBuilder("bz2")
    bag.add("/w", "thing/Whole", 3, text, rosmsg.pack(m, "thing/Whole", own))
    bag.add("/w", "thing/Whole", 4, text, b"short")
    (tmp_path / "w.bag").write_bytes(bag.bytes())
    got = rosmsg.decode(rosbag.read_bags(spark, f"{tmp_path}/w.bag"), "thing/Whole", text).orderBy("t").collect()
    assert got[0].message.asDict(True) == m and got[1].message is None


def test_a_failed_write_leaves_no_bag(spark, tmp_path):
    bad = spark.createDataFrame([("/a", "geometry_msgs/PointStamped", 1, None)], "topic string, type string, t long, payload binary")
    with pytest.raises(Exception, match="needs topic"):
        rosbag.write_bags(bad, f"file://{tmp_path}/none")
    assert [n for n in os.listdir(f"{tmp_path}/none") if not n.startswith(".")] == [] if os.path.exists(f"{tmp_path}/none") else True
