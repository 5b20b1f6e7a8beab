"""WARC archives, nearest neighbours, licences and languages."""

import base64
import hashlib
import io
import os
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scanweave.llm import ann, language, warc
from scanweave.llm.license import SENTENCES, license_scan, license_sql

PAGES = "page_id long, url string, html string"


def pages(seed):
    rng = random.Random(seed)
    rows = [(1, "http://a/", "same"), (2, None, "same"), (9, "é b\r\nX: 1", "same"), (3, "u", None), (4, "u", ""), (None, "n", "same"), (None, "n", "alone"), (7, "u", "r\r\n\r\nWARC/1.1\r\n" * 50), (8, "t", "tie"), (8, "t", "tie"), (6, "t", "tie")]
    return rows + [(100 + i, f"http://h{i % 7}/{i}", "x" * rng.randrange(3000) + "é" * rng.randrange(3)) for i in range(200)]


def expected(rows, least=0):
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[(html or "").encode()].append(i)
    out = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        top = max((x for x in groups[data] if x is not None), default=None)
        revisit = len(data) >= least and top is not None and i != top
        out[i, "revisit" if revisit else "response", len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), top if revisit else None] += 1
    return out


@pytest.mark.parametrize("least", [0, 4])
def test_archives_are_read_back(spark, tmp_path, least):
    rows = pages(1)
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as kind", "2 as sha1").repartition(3)
    names = warc.write(df, f"file://{tmp_path}/w", min_bytes=least, roll_bytes=20_000)
    got = Counter((r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.read(spark, f"file://{tmp_path}/w").collect())
    assert got == expected(rows, least) and len(names) > 1
    assert sorted(os.listdir(f"{tmp_path}/w")) == sorted([*names, "manifest.json", *[f".{n}.crc" for n in names if os.path.exists(f"{tmp_path}/w/.{n}.crc")]])


def test_same_pages_same_bytes_and_order(spark, tmp_path):
    df = spark.createDataFrame(pages(2), PAGES).coalesce(1)
    contents = []
    for k in range(2):
        names = warc.write(df, f"{tmp_path}/w{k}", roll_bytes=20_000)
        contents.append([(n, open(f"{tmp_path}/w{k}/{n}", "rb").read()) for n in names])
    assert contents[0] == contents[1]
    ids = [int(h["x-page-id"]) for _, data in contents[0] for h, _ in warc.records(io.BytesIO(data)) if "x-page-id" in h]
    assert ids == sorted(ids)


def test_damage_is_seen_and_empty_tables_work(spark, tmp_path):
    warc.write(spark.createDataFrame([], PAGES), f"{tmp_path}/empty")
    assert warc.read(spark, f"{tmp_path}/empty").count() == 0
    data = warc._member(warc.record(1, "u", b"payload", None, False, "d"), 5)
    with pytest.raises(Exception):
        list(warc.records(io.BytesIO(data[:-9])))
    big = "z" * 5_000_000
    warc.write(spark.createDataFrame([(1, "u", big)], PAGES), f"{tmp_path}/big")
    r = warc.read(spark, f"{tmp_path}/big").collect()[0]
    assert r.payload_bytes == 5_000_000 and bytes(r.payload).decode() == big


VECTORS = "vec_id long, embedding array<float>"


def nearest(x, ids, q, k=5):
    s = ann.cosine(x, np.broadcast_to(x[ids == q], x.shape))
    s[ids == q] = -9
    return np.lexsort((ids, -s))[: min(k, len(ids) - 1)], s


def test_exact_search_with_ties_and_unfit_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[50:150] = x[49]
    x[200] = x[201] * 2
    bad = [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [float("nan")] + [1.0] * 7), (1004, [float("inf")] + [1.0] * 7), (1005, [1.0]), (1006, [None] + [1.0] * 7), (None, [1.0] * 8)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + bad + rows[:3], VECTORS).selectExpr("*", "1 as part", "2 as score")
    got = defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 50 = 0"), exact=True).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ids, d = np.arange(400), x.astype(np.float64)
    assert set(got) == set(range(0, 400, 50))
    for q, own in got.items():
        top, s = nearest(d, ids, q)
        assert [v for _, v, _ in own] == ids[top].tolist() and [r for r, _, _ in own] == [1, 2, 3, 4, 5]
        assert [z for _, _, z in own] == s[top].tolist()


def test_recall_and_balance(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    hits = total = 0
    got = defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 50 = 0")).collect():
        got[r.query_id].append(r.vec_id)
    for q, own in got.items():
        top, _ = nearest(x, np.arange(6000), q)
        hits, total = hits + len(set(top) & set(own)), total + 5
    assert total == 600 and hits / total >= 0.9
    units = ann._units(x)
    neighbours = np.argsort(-(units @ units.T), axis=1)[:, 1:9]
    labels = ann.partition_graph(units, neighbours, 16, 5, rng)
    assert np.bincount(labels, minlength=16).max() <= np.ceil(6000 / 16 * 1.1)


def test_small_blocks_and_runs_give_the_same(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(700, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    router = ann.fit(df)
    found = []
    for size in (4096, 7):
        monkeypatch.setattr(ann, "BLOCK_ROWS", size)
        monkeypatch.setattr(ann, "QUERY_ROWS", size)
        found.append(sorted(map(tuple, ann.search(df, df.where("vec_id % 5 = 0"), router=router).collect())))
    assert found[0] == found[1] and ann.partitions(500) == 8 < ann.partitions(10_000) < ann.partitions(10**6) < ann.partitions(10**12) == ann.MOST_PARTS


def test_first_vector_of_another_length(spark):
    rows = [(-1, [1.0] * 3), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, 1.0])]
    df = spark.createDataFrame(rows, VECTORS)
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.search(df, df.where("vec_id % 50 = 0")).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]


def test_few_or_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, 1.0])], VECTORS)
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.search(few, few.where("vec_id % 50 = 0")).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    none = spark.createDataFrame([], VECTORS)
    assert ann.search(none, none).count() == 0


def test_licences(spark, docs):
    full = "MIT License\n\nCopyright (c) 2020 X\n\n" + SENTENCES[6].replace("software and", "software\nand") + ":\n\n" + SENTENCES[7].replace("in all", "in all\n") + "."
    texts = [None, "", "no licence here", "Prose.\nReleased under the MIT License.\nMore prose", "a line\nLicensed under CC BY-NC 4.0", full, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0. " + SENTENCES[0] + ".", SENTENCES[7] + ". " + SENTENCES[6] + ".", "x " * 500_000 + ".\n" + SENTENCES[0] + "!"]
    two = "\n".join([SENTENCES[22] + ":", SENTENCES[23] + ".", SENTENCES[24] + "."])
    texts += [two, two + "\n" + SENTENCES[29] + ".", two + "\n" + SENTENCES[29] + ".\n" + two + "\n" + SENTENCES[29] + ".", "// SPDX-License-Identifier: LGPL-2.1-or-later\nint x;", "MIT\nISC", "# " + SENTENCES[15] + "; " + SENTENCES[34] + "."]
    df = docs(texts).selectExpr("*", "'y' as licenses", "1 as known")
    got = {r.doc_id: r.licenses for r in license_scan(df).collect()}
    assert got == {0: "", 1: "", 2: "", 3: "MIT", 4: "CC-BY-NC-4.0", 5: "MIT", 6: "Apache-2.0,MIT", 7: "", 8: "MIT", 9: "BSD-2-Clause", 10: "BSD-3-Clause", 11: "BSD-3-Clause", 12: "LGPL-2.1-or-later", 13: "", 14: "AGPL-3.0-or-later"}
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    assert Counter(con.sql(license_sql()).fetchall()) == Counter(map(tuple, license_scan(df).collect()))
    assert license_scan(docs([])).count() == 0


WORDS = {"xa": "alo mira tolo sano ruda pelo", "yb": "straxt krompf wuhlz gnerk schtup brolf", "zc": "иван дом снег река поле лес"}


def said(rng, lang, n):
    return " ".join(rng.choices(WORDS[lang].split(), k=n)) + "."


def test_languages(docs, spark):
    rng = random.Random(3)
    langs = [rng.choice([*WORDS]) for _ in range(300)]
    texts = [said(rng, lang, rng.randint(1, 40)) for lang in langs]
    texts[:4], langs[:4] = [None, "", "123 -- !!", texts[4].upper() * 20_000], ["xa", "xa", "xa", langs[4]]
    df = docs(texts, langs).selectExpr("*", "1 as language_found", "'x' as lang_pred", "2 as score")
    got = {r.doc_id: r for r in language.identify(df).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and all(got[i].score == 0 for i in range(3))
    assert all(got[i].lang_pred == langs[i] and 0 < got[i].score <= 1 for i in range(3, 300))
    import zlib

    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(300))
    kept = language.identified_only(df)
    assert {r.doc_id for r in kept.collect()} == set(range(3, 300)) and "language_found" not in kept.columns


def test_predictions_use_the_text_alone(docs):
    rng = random.Random(4)
    langs = [rng.choice([*WORDS]) for _ in range(120)]
    texts = [said(rng, lang, 10) for lang in langs]
    profiles = language.fit(docs(texts, langs))
    a = [r.language_found for r in language.predicted(docs(texts, langs), profiles).orderBy("doc_id").collect()]
    b = [r.language_found for r in language.predicted(docs(texts[::-1], [None] * 120), profiles).orderBy("doc_id").collect()]
    assert [x.lang for x in a] == [x.lang for x in b[::-1]]
    assert np.allclose([x.score for x in a], [x.score for x in b[::-1]], atol=1e-6)
    assert language.identify(docs([])).count() == 0
    assert {r.lang_pred for r in language.identify(docs(["abc", None], [None, None])).collect()} == {"und"}


def test_bundles_equal_their_definition():
    import pyarrow as pa

    from scanweave.llm import _text

    text, dims = "Abé ba! ab", 128
    part = next(_text.chunks(pa.array([text, "zz"], pa.large_string())))
    got, has = language.vectors(part, dims)
    want, grams = np.zeros(dims), Counter()
    for word in ("abé", "ba", "ab"):
        framed = [0, *map(ord, word), 0]
        grams.update(zip(framed, framed[1:], framed[2:], strict=False))
    for gram, n in grams.items():
        v = [language._letter_vectors(np.array([x]), dims)[0].astype(float) for x in gram]
        want += np.sqrt(n) * np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
    assert has.tolist() == [True, True] and np.allclose(got[0], want, atol=1e-4)


def _archive(spark, df, folder, **more):
    names = warc.write(df, folder, **more)
    return [(n, hashlib.sha256(open(f"{folder}/{n}", "rb").read()).hexdigest()) for n in names]


def test_archives_do_not_depend_on_sessions_or_partitions(spark, tmp_path):
    rows = ["cast(pow(id, 1.7) as long) - 900 as page_id", "concat('http://h/', id) as url", "repeat(cast(id % 977 as string), cast(pmod(xxhash64(id), 90) as int)) as html"]
    seen = []
    for k, (parts, shuffle) in enumerate([(3, 8), (17, 211)]):
        other = spark.newSession()
        other.conf.set("spark.sql.shuffle.partitions", shuffle)
        df = other.range(20_000).selectExpr(*rows).repartition(parts)
        seen.append(_archive(other, df, f"{tmp_path}/s{k}", shard_bytes=1 << 20, roll_bytes=100_000))
    assert seen[0] == seen[1] and len(seen[0]) > 10
    with pytest.raises(FileExistsError):
        warc.write(df, f"{tmp_path}/s0")


def test_a_hot_id_is_cut_into_shards(spark, tmp_path):
    rows = [(None if i % 3 else 5, f"u{i}", f"body {i % 40} " * 20) for i in range(900)] + [(-(1 << 63), "least", "x"), ((1 << 63) - 1, "largest", "x")]
    df = spark.createDataFrame(rows, PAGES)
    names = _archive(spark, df, f"{tmp_path}/hot", shard_bytes=50_000)
    assert names == _archive(spark, df.repartition(7), f"{tmp_path}/hot2", shard_bytes=50_000) and len(names) > 8
    got = Counter((r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.read(spark, f"{tmp_path}/hot").collect())
    assert got == expected(rows)


def test_shard_bounds_hold_about_their_bytes(spark):
    rng = np.random.default_rng(4)
    ids = np.unique(np.concatenate([rng.integers(-(1 << 62), 1 << 62, 3000), np.arange(5000), 1_000_000 + 7 * np.arange(2000)]))
    sizes = rng.integers(1, 2000, len(ids))
    sizes[ids == 77] = 300_000
    bounds, parts = warc.shard_bounds(spark.createDataFrame(zip(ids.tolist(), sizes.tolist(), strict=True), "page_id long, bytes long"), 50_000)
    sums = np.bincount(np.searchsorted(bounds, ids, "right") - 1, sizes, len(bounds))
    assert bounds == sorted(bounds) and set(parts) == {77} and parts[77] == 6
    assert sorted(sums)[-2] <= 50_000 and len(bounds) < 3 * sizes.sum() / 50_000 + 5


def test_languages_are_learned_from_all_labelled_rows(spark, monkeypatch):
    """4,800 short texts, of which 3,000 or so were learned from before; and medians are exact over bins."""
    df = spark.range(4800).select(F.col("id").alias("doc_id"), F.concat(F.lit("wind over stone "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    seen = []
    for name in ("_learned", "_bars"):
        monkeypatch.setattr(language, name, lambda rows, *a, f=getattr(language, name): (seen.append(rows.count()), f(rows, *a))[1])
    assert language.identified_only(df).count() == 4800
    assert seen == [df.where(~language.held_out()).count()] * 2 and seen[0] > 3400
    scores = [(lang, c, (i * i % 97) / 97 if c else 0.5 + i / 1e7) for lang in ("a", "b") for c in (0, 1) for i in range(40 + c)] + [("c", 0, 1.0)]
    got = language._medians(spark.createDataFrame(scores, "lang string, class int, score double"))
    assert got.keys() == {x[:2] for x in scores}
    for k, m in got.items():
        own = sorted(x[2] for x in scores if x[:2] == k)
        assert abs(m - (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2) < 1e-15
