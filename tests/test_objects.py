"""Object files: borders across splits, pointers, blobs, graphs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from scanweave.sources import objects


def text(rng, n):
    """Objects over several lines, with brackets in texts and comments, and pointers forwards and backwards."""
    out, want = [], {}
    for i in range(n):
        target = rng.randrange(-1, n + 3)
        body = {"#id": i, "name": "a } { // not a comment", "deep": {"list": [1, -2.5, {"x": i}], "parent": {"#pointer": target}}, "flag": True}
        want[i] = body
        own = json.dumps(body, indent=rng.choice([None, 1, 3]))
        if rng.random() < 0.3:
            own = own.replace('"flag"', '// a comment with } and "quotes\n "flag"')
        out.append(f'"Kind{i % 3}"{rng.choice([" ", " : "])}{own}{rng.choice([chr(10), chr(10) * 2, " "])}')
    return "".join(out), want


@pytest.mark.parametrize("split", [200, 1 << 20])
def test_objects_are_cut_at_their_borders(spark, tmp_path, split):
    content, want = text(random.Random(split), 300)
    (tmp_path / "a.objects").write_text(content)
    (tmp_path / "b.objects").write_text('// only a comment\n"Alone" { "#id" : 7,\n "v" : [ 1, 2, ], }\n')
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        if split < 1000:
            assert spark.read.text(f"{tmp_path}/a.objects").rdd.getNumPartitions() > 50
        got = objects.read_objects(spark, str(tmp_path))
        rows = got.collect()
        a = [r for r in rows if r.stream.endswith("a.objects")]
        assert all(r.error is None for r in rows if r.kind) and {r.id: json.loads(r.body) for r in a} == want and len(a) == 300
        assert [r.id for r in sorted(a, key=lambda r: (r.object, r.part))] == list(range(300))
        b = [r for r in rows if r.stream.endswith("b.objects") and r.kind]
        assert [(r.kind, r.id, json.loads(r.body)["v"]) for r in b] == [("Alone", 7, [1, 2])]
        found = {r.id: r for r in objects.references(got.where("kind is not null and stream like '%a.objects'")).collect()}
        for i, body in want.items():
            t, r = body["deep"]["parent"]["#pointer"], found[i]
            assert r.at == "deep.parent" and r.target == t and r.status == ("null" if t < 0 else "found" if t < 300 else "dangling")
            assert r.status != "found" or (json.loads(r.target_body) == want[t] and r.target_kind == f"Kind{t % 3}")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_what_cannot_be_read_is_said(spark, tmp_path):
    (tmp_path / "cut.objects").write_text('"A" { "#id" : 1 }\n"B" { "#id" : 2, "x" : [ 1, 2\n')
    rows = sorted(objects.read_objects(spark, f"{tmp_path}/cut.objects").collect(), key=lambda r: r.object)
    assert [(r.kind, r.id, r.error is None) for r in rows] == [("A", 1, True), ("B", None, False)]
    (tmp_path / "odd.objects").write_text('nothing\n"A" { "#id" : 1 } "B" : { "#id" : 2, "v" : 5 }\n"A" { "#id" : 2 }\n')
    rows = sorted(objects.read_objects(spark, f"{tmp_path}/odd.objects").collect(), key=lambda r: (r.object, r.part))
    assert [(r.kind, r.id, r.part) for r in rows if r.error is None] == [("A", 1, 0), ("B", 2, 1), ("A", 2, 0)] and rows[0].error
    last = objects.latest(objects.read_objects(spark, f"{tmp_path}/odd.objects")).orderBy("id").collect()
    assert [(r.id, r.kind) for r in last] == [(1, "A"), (2, "A")]
    (tmp_path / "empty.objects").write_text("")
    assert objects.read_objects(spark, f"{tmp_path}/empty.objects").collect() == []


def test_blobs_come_from_their_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/one.dat").write_bytes(b"\x00\xffone")
    (tmp_path / "d/many.dat").write_bytes(b"aaaabbbbcc")
    rows = [("I", json.dumps({"#id": i, "image": {"path_name": name, "index": k}})) for i, (name, k) in enumerate([("d/one.dat", -1), ("d/many.dat", 1), ("d/many.dat", 2), ("d/none.dat", -1)])]
    objects.write_objects(spark.createDataFrame(rows, "kind string, body string"), f"{tmp_path}/o")
    got = objects.read_objects(spark, f"{tmp_path}/o", together=True)
    found = {r.id: r.content and bytes(r.content) for r in objects.blobs(got, str(tmp_path), size=4).collect()}
    assert found == {0: b"\x00\xffone", 1: b"bbbb", 2: None, 3: None}


def test_graphs_round_trip(spark, tmp_path):
    variables = spark.range(50).select("id", F.lit("PlanarVariable").alias("type"), F.when(F.col("id") == 0, "fixed").when(F.col("id") == 9, "non-active").otherwise("active").alias("status"), F.array(F.col("id") / 3, F.lit(-1e-17), F.lit(2.0)).alias("estimate"))
    factors = spark.range(49).select("id", F.lit("PlanarFactor").alias("type"), (F.col("id") != 5).alias("enabled"), (F.col("id") % 2).cast("int").alias("level"), F.array("id", F.col("id") + 1).alias("variables"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.5)).alias("measurement"), F.array(*[F.lit(float(i)) for i in range(6)]).alias("information"))
    objects.write_objects(objects.graph_objects(variables, factors).repartition(4), f"{tmp_path}/g")
    v, f = objects.graph(objects.read_objects(spark, f"{tmp_path}/g", together=True))
    same = lambda a, b: sorted(map(str, a.drop("stream").collect())) == sorted(map(str, b.collect()))
    assert same(v, variables) and same(f, factors)


def test_the_usual_layout_is_a_graph(spark, tmp_path):
    (tmp_path / "g.objects").write_text('"PoseVariable" { \n  "#id" : 1, \n  "graph_id" : 1000, \n  "status" : 2, \n  "estimate" : [ 1, 0, -5.9e-07 ]\n }\n\n"PosePoseFactor" { \n  "#id" : 102, \n  "graph_id" : 0, \n  "enabled" : 1, \n  "variables" : [ 1000, 1001 ], \n  "measurement" : [ 1, 2 ], \n  "information" : [ 100 ]\n }\n')
    v, f = objects.graph(objects.read_objects(spark, f"{tmp_path}/g.objects"))
    assert [(r.id, r.status, r.estimate) for r in v.collect()] == [(1000, "fixed", [1.0, 0.0, -5.9e-07])]
    assert [(r.id, r.enabled, r.level, r.variables, r.measurement) for r in f.collect()] == [(0, True, 0, [1000, 1001], [1.0, 2.0])]
