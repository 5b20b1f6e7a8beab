"""Streams that end by timers: equal to their batch forms, late rows said, state let go."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanweave.operators import graph
from scanweave.streaming import operators as streaming
from scanweave.streaming import timers

POSE = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")


def run(spark, df, parts, make, tmp_path, name, enough):
    """What a stream over df in files of equal arrival gives, until `enough` says so."""
    n = df.agg(F.max("arrival")).first()[0] + 1
    for k in range(parts):
        df.where((F.col("arrival") >= n * k // parts) & (F.col("arrival") < n * (k + 1) // parts)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/k{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/ck-{name}").trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 100
        while time.time() < end and q.exception() is None and not enough(spark.table(name)):
            time.sleep(0.5)
        assert q.exception() is None, str(q.exception())
        return spark.table(name).collect()
    finally:
        q.stop()


def test_a_sorted_stream_ends_as_its_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"s{i % 3}", i * 0.1 + float(rng.normal(0, 0.4)) - (30.0 if i % 50 == 49 else 0.0), i) for i in range(300)]
    df = spark.createDataFrame(rows, "stream string, t double, arrival long")
    want = {s: [] for s in ("s0", "s1", "s2")}
    for r in streaming.sort_batch(df).orderBy("stream", "place").collect():
        want[r.stream].append(r.arrival)
    late = {i for i in range(300)} - {a for v in want.values() for a in v}
    got = run(spark, df, 3, lambda s: timers.sort_stream(s, idle=3000), tmp_path, "timed", lambda t: t.count() >= 300)
    assert len(got) == 300 and {r.arrival for r in got if r.late} == late and late
    for s in want:
        assert sorted(r.arrival for r in got if r.stream == s and not r.late) == sorted(want[s])
        times = [r.t for r in got if r.stream == s and not r.late]
        assert len(times) == len(want[s])


def asked(rng):
    """A log of events and questions of two links, and what a listener answers, one row after the other."""
    rows, want = [], {}
    kept = {"a": [], "b": []}
    waiting = {"a": [], "b": []}

    def answer(c, last=False):
        times, rest = [e[0] for e in kept[c]], []
        for q, t in waiting[c]:
            if times and t < times[0]:
                want[q] = ("before_first", None)
            elif times and t <= times[-1]:
                k = int(np.searchsorted(times, t))
                want[q] = ("ok", kept[c][k][1] if times[k] == t else float(np.interp(t, times, [e[1] for e in kept[c]])))
            elif last:
                want[q] = ("after_last" if times else "no_data", None)
            else:
                rest.append((q, t))
        waiting[c] = rest

    for i in range(240):
        c, t = "ab"[i % 2], i * 0.1 + float(rng.normal(0, 0.3))
        if i % 3:
            x = float(rng.normal())
            rows.append((c, i, t, None, x, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0))
            answer(c)
            kept[c] = sorted([*kept[c], (t, x)])
            kept[c] = [e for e in kept[c] if e[0] >= kept[c][-1][0] - 2.0]
        else:
            t += float(rng.uniform(-4, 1))
            rows.append((c, i, t, i, *[None] * 7))
            waiting[c].append((i, t))
    rows.append(("c", 240, 1.0, 240, *[None] * 7))
    for c in "ab":
        answer(c)
        answer(c, True)
    want[240] = ("no_data", None)
    return rows, want


def test_a_transform_listener_forgets_and_ends(spark, tmp_path):
    rows, want = asked(np.random.default_rng(2))
    df = spark.createDataFrame(rows, "child string, arrival long, t double, query_id long, " + ", ".join(f"{c} double" for c in POSE))
    got = run(spark, df, 3, lambda s: timers.transform_stream(s, window=2.0, idle=3000), tmp_path, "listener", lambda t: t.count() >= len(want))
    found = {r.query_id: (r.status, r.tx) for r in got}
    assert len(got) == len(want) == 81 and {q: s for q, (s, _) in found.items()} == {q: s for q, (s, _) in want.items()}
    assert {s for s, _ in want.values()} == {"ok", "before_first", "after_last", "no_data"}
    assert all(x is None or found[q][1] == pytest.approx(x, abs=1e-9) for q, (_, x) in want.items())


def test_turns_are_interpolated_along_the_shorter_way():
    half = np.pi / 4
    a, b = (0.0, 0, 0, 0, 0, 0, 0, 1.0), (2.0, 4, 0, 0, 0, 0, -np.sin(half), -np.cos(half))
    got = timers.between(a, b, 1.0)
    assert np.allclose(got, [2, 0, 0, 0, 0, np.sin(half / 2), np.cos(half / 2)])
    assert timers.between(a, a, 0.0) == a[1:]


def test_factors_leave_with_their_last_variable(spark, tmp_path):
    rng = np.random.default_rng(4)
    factors = {i: [int(v) for v in rng.integers(0, 60, int(rng.integers(1, 4)))] for i in range(150)}
    there = [v for v in range(60) if v % 13]  # some never come
    log = [("variable", v, []) for v in there] + [("factor", i, v) for i, v in factors.items()]
    order = rng.permutation(len(log))
    rows = [(*log[k], i) for i, k in enumerate(order)]
    df = spark.createDataFrame(rows, "kind string, id long, variables array<long>, arrival long")
    want = {i: len(set(v)) for i, v in factors.items() if set(v) <= set(there)}
    got = run(spark, df, 4, timers.release_stream, tmp_path, "released", lambda t: t.count() >= len(want))
    assert {r.factor_id: r.n_variables for r in got} == want and len(got) == len(want) < 150
    batch = graph.releases(df.where("kind = 'factor'").selectExpr("id as factor_id", "arrival"), df.where("kind = 'factor'").selectExpr("id as factor_id", "explode(variables) as variable_id"), df.where("kind = 'variable'").selectExpr("id as variable_id", "arrival"))
    came = {(k, i): a for k, i, _, a in rows}
    assert {r.factor_id: (r.n_variables, r.released) for r in batch.collect()} == {i: (n, max(came["factor", i], *(came["variable", v] for v in factors[i]))) for i, n in want.items()}
