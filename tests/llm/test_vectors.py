"""Whitening, hard negatives and sharding against plain versions."""

import math
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from scanweave.llm import negatives, sharding, whitening
from scanweave.llm.queries import op12_hard_negatives

VECTORS = "vec_id long, embedding array<double>, label int, x string, n int"


def table(spark, vectors, labels=None):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], None if labels is None else labels[i], "x", 1) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, VECTORS).repartition(3)


def expected_whitening(vectors, k):
    """The exact scatter over distinct integer vectors, by rows."""
    xs = [tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(xs))
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    m = [[n * sum(x[i] * x[j] for x in fit) - s[i] * s[j] for j in range(d)] for i in range(d)]
    v = np.array([[y / (n * n) for y in row] for row in m])
    deviation = [sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)) for x in xs]
    return n, deviation, np.linalg.eigvalsh(v)[::-1][:k], np.trace(v), np.array([[(n * a - b) / n for a, b in zip(x, s, strict=True)] for x in xs])


def test_whitening_equals_the_exact_scatter(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(300, 20)) * np.linspace(0.1, 3, 20) @ rng.normal(size=(20, 20))).tolist()
    vectors += vectors[:40] + [vectors[0]] * 30
    bad = [None, [], [1.0] * 19 + [None], [1.0] * 19 + [math.inf], [1.0] * 19 + [math.nan], [1.0] * 3, [1e300] * 20]
    got = whitening.whiten(table(spark, vectors + bad)).collect()
    n, deviation, e, trace, centred = expected_whitening(vectors, 16)
    assert len(got) == 16 * len(vectors) and {r.n for r in got} == {n}
    w = np.zeros((len(vectors), 16))
    for r in got:
        assert r.deviation == deviation[r.vec_id]
        assert math.isclose(r.explained, e[r.component - 1] / trace, rel_tol=1e-9)
        w[r.vec_id, r.component - 1] = r.whitened
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    # projections onto orthonormal directions: w * sqrt(e) = centred Q with Q'Q = 1
    q = np.linalg.lstsq(centred, w * np.sqrt(e), rcond=None)[0]
    assert np.abs(q.T @ q - np.eye(16)).max() < 1e-8 and np.abs(centred @ q - w * np.sqrt(e)).max() < 1e-7


def test_whitening_of_very_unequal_and_large_dimensions(spark):
    rng = np.random.default_rng(2)
    for scales in ([1e7, 1e3, 1, 1, 0.5], [1e12, 1e12, 1e6, 5.0, 5.0]):
        mix = np.eye(5)
        mix[1:, 0] = 1e-3
        vectors = (rng.normal(size=(200, 5)) @ np.diag(scales) @ mix).tolist()
        got = whitening.whiten(table(spark, vectors)).collect()
        n, deviation, _, _, _ = expected_whitening(vectors, 5)
        assert len(got) == 5 * 200 and got[0].identity_error < 1e-4
        assert all(r.deviation == (deviation[r.vec_id] if deviation[r.vec_id] < 1 << 63 else None) for r in got)


def test_whitening_without_variance(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [[1.0, 2.0], [1.0, 2.0]])).collect() == []
    assert whitening.whiten(table(spark, [None, [None]])).collect() == []
    got = whitening.whiten(table(spark, [[1.0, 5.0, 1.0], [2.0, 5.0, 1.0], [9.0, 5.0, 1.0]])).collect()
    assert {r.component for r in got} == {1} and len(got) == 3 and got[0].identity_error < 1e-12


def test_exact_products_of_any_size():
    rng = np.random.default_rng(3)
    for bits in (5, 19, 20, 33, 52):
        y = rng.integers(-(1 << bits), (1 << bits) + 1, (9000 if bits < 30 else 50, 4))
        assert (whitening.exact_products(y) == y.T.astype(object) @ y.astype(object)).all()


def expected_negatives(vectors, labels, anchors, k=5, m=3):
    x = {i: [math.floor(256 * c) for c in v] for i, v in vectors.items()}
    out = set()
    for a in anchors:
        score = {i: sum(p * q for p, q in zip(x[a], x[i], strict=True)) for i in x if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if labels[i] == labels[a]][:k]:
            found = [i for i in order if labels[i] != labels[a] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:m]
            out |= {(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(found)}
    return out


@pytest.mark.parametrize("kind", ["random", "equal", "large", "odd"])
def test_negatives_equal_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 150)
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", 4)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(700, 7 if kind == "odd" else 8))
    if kind == "equal":  # many ties, and a third of one vector
        v = np.round(v)
        v[rng.random(700) < 0.33] = v[0]
    if kind == "large":
        v *= 1e5
    labels = rng.integers(0, 4, 700).tolist()
    got = [tuple(r) for r in negatives.hard_negatives(table(spark, v.tolist(), labels), sample_rows=400).collect()]
    want = expected_negatives(dict(enumerate(v.tolist())), labels, range(0, 700, 50))
    assert set(got) == want and len(got) == len(want) and len(want) > 50


def test_negatives_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(120, 4)).tolist()
    labels = rng.integers(0, 2, 120).tolist()
    rows = [(i, a, labels[i]) for i, a in enumerate(v)] + [(7, [9.0] * 4, 5), (None, v[0], 1), (200, None, 1), (250, [1.0, None, 1.0, 1.0], 1), (300, [math.inf] * 4, 0), (350, v[1], None), (400, [1e17] * 4, 1), (450, [1.0], 1), (0, v[0], labels[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as codes", "2 as rank")
    got = {tuple(r) for r in negatives.hard_negatives(df).collect()}
    assert got == expected_negatives(dict(enumerate(v)), labels, [0, 50, 100])
    assert negatives.hard_negatives(df.where("false")).collect() == []
    assert negatives.hard_negatives(df.where("vec_id = 3")).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(0, [0.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, [0.0, 0.0], 2)], "vec_id long, embedding array<double>, label int")).collect() == [(0, 1, 1, 2, 0, 0)]


def test_negatives_equal_their_sql(spark):
    db = duckdb.connect()
    db.sql("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    want = db.sql(negatives.negatives_sql()).fetchall()
    got = op12_hard_negatives(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 20


DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, size int"


def shard(spark, rows, tmp_path, shards=40, **more):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], DOCS).repartition(3)
    tree = sharding.write_shards(df, f"file://{tmp_path}/s", shards, **more)
    return tree, sharding.read_shards(df, f"file://{tmp_path}/s").collect()


def documents(n, rng):
    text = lambda k: "é" + "x" * k
    rows = [(i, text(int(rng.exponential(300))), ["de", "en", "fr", None][i % 4], f"http://h{int(rng.integers(9))}/", 10) for i in range(n)]
    return [(i, t, lang, s, len(t)) for i, t, lang, s, _ in rows]


def check(rows, got, shards, slack=1):
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.size) for r in got) == sorted((r[0] is None, r[0] or 0, r[1] or "", size(r[1])) for r in rows)
    slots, total = defaultdict(list), [0] * shards
    for r in got:
        slots[r.shard].append(r.slot)
        total[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = sum(total) / shards
    most = max((size(r[1]) for r in rows), default=0)
    assert all(abs(t - share) <= slack * most + 0.01 * share for t in total), (share, most, total)
    return total


def test_shards_are_balanced_and_cut_by_medians(spark, tmp_path):
    rows = documents(3000, np.random.default_rng(6))
    tree, got = shard(spark, rows, tmp_path)
    check(rows, got, 40)
    assert {tree.dims[x.dim] for x in tree.nodes if x.left >= 0} >= {"doc_id", "lang", "source"}
    # each inner node was cut along the widest dimension: no shard is wider than the table
    assert sum(x.shards == 1 for x in tree.nodes) == 40 and sorted(x.first for x in tree.nodes if x.left < 0) == list(range(40))


def test_shards_of_copies_and_repeated_rows(spark, tmp_path):
    rng = np.random.default_rng(7)
    copies = [(i, "same text " * 30, "en", "s", 300) for i in range(1200)]  # alike but for doc_id
    repeated = [(5000, "again " * 40, "en", "s", 240)] * 600  # alike in everything
    rows = documents(600, rng) + copies + repeated + [(None, None, None, None, None)] * 3 + [(9000, "", None, "s", -1)]
    for k, dims in enumerate([("doc_id", "lang", "source", "n_chars"), ("lang",), ()]):
        _, got = shard(spark, rows, tmp_path / str(k), 7, dims=dims)
        check(rows, got, 7, slack=2 if k else 1)


def test_small_and_uneven_tables(spark, tmp_path):
    assert shard(spark, [], tmp_path / "0")[1] == []
    rows = [(1, "only", "en", "s", 4)]
    _, got = shard(spark, rows, tmp_path / "1")
    assert [(r.size, r.slot) for r in got] == [(20, 0)] and 0 <= got[0].shard < 40
    rows = [(i, "y" * 10, "en", "s", 10) for i in range(50)] + [(77, "z" * 100_000, "en", "s", 100_000)]  # one row larger than all others
    _, got = shard(spark, rows, tmp_path / "2", 3)
    total = check(rows, got, 3, slack=1)
    assert sum(total) == 50 * 26 + 100_016
    with pytest.raises(ValueError):
        shard(spark, rows, tmp_path / "3", 0)


def test_crc_of_the_query(spark, tmp_path):
    from scanweave.llm.queries import op13_sharding

    got = op13_sharding(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(texts) and all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.law == "bytes" and r.grown_shard is None for r in got)
