import hashlib
import random
from collections import defaultdict

import numpy as np

from scanweave.llm import line_dedup as ld
from scanweave.llm.line_dedup import CuckooFilter, LineIndex


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(texts):
    holders = defaultdict(set)
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = {}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(holders[key(x)]) > 1 and min(holders[key(x)]) < i)]
        out[i] = len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()
    return out


def corpus(seed):
    rng = random.Random(seed)
    lines = ["", " ", "short", "a line that many hold", " A Line that MANY hold \r", "ñandú ñandú ñ", "123456789", "1234567890", " padded by nbsp", *[f"line number {i} of a pool" for i in range(40)]]
    out = [None, "", "\n", "\n\n", "a line that many hold\na line that many hold", "x\n"]
    return out + ["\n".join(rng.choices(lines, k=rng.randint(1, 12))) for _ in range(60)]


def rows(df):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()}


def test_against_brute_force(docs):
    texts = corpus(1)
    assert rows(ld.line_dedup(docs(texts))) == brute(dict(enumerate(texts)))


def test_heavy_shards_are_dealt_out(docs, monkeypatch):
    monkeypatch.setattr(ld, "POSTINGS_PER_TASK", 5)
    monkeypatch.setattr(ld, "KEYS_PER_SHARD", 3)
    texts = corpus(2)
    assert rows(ld.line_dedup(docs(texts))) == brute(dict(enumerate(texts)))
    monkeypatch.setattr(ld, "BROADCAST_SHARDS", 0)
    assert rows(ld.line_dedup(docs(texts))) == brute(dict(enumerate(texts)))


def test_insertions_and_deletions_are_reversible(docs):
    df = docs(corpus(3))
    drops = lambda index: sorted(map(tuple, index.drops().collect()))
    odd, even = df.where("doc_id % 2 = 1"), df.where("doc_id % 2 = 0")
    whole, half = LineIndex.build(df), LineIndex.build(even)
    assert drops(half.insert(odd)) == drops(whole)
    assert drops(whole.delete(odd.select("doc_id"))) == drops(half)
    assert drops(half.insert(odd).delete(odd.select("doc_id")).insert(odd)) == drops(whole)


def test_nulls_repeats_clashes_and_empty(spark, docs):
    said = "a line that two hold"
    df = spark.createDataFrame([(None, said, 1), (5, said, 2), (5, said, 3), (9, said + "\nown", 4), (10, None, 5)], "doc_id long, text string, line_drops int").selectExpr("*", "1 as key_a", "2 as shard")
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped) for r in ld.line_dedup(df).collect()), key=str)
    assert got == sorted([(None, 1, 0), (5, 1, 0), (5, 1, 0), (9, 2, 1), (10, 1, 0)], key=str)
    kept = {(r.doc_id, r.text) for r in ld.deduplicated(df).collect()}
    assert kept == {(None, said), (5, said), (9, "own"), (10, None)}
    assert ld.line_dedup(docs([])).count() == 0


def test_a_very_long_text(docs):
    long = "\n".join(f"line {i % 150_000} of a long text" for i in range(200_000))
    got = rows(ld.line_dedup(docs(["line 7 of a long text", long])))
    assert got[1][:2] == (200_000, 2)


def test_cuckoo_filter():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2)
    f = CuckooFilter(len(keys)).build(keys)
    assert f.contains(keys).all()
    other = rng.integers(0, 1 << 63, 50_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert f.contains(other).mean() < 0.002
    f.delete(keys[:15_000])
    assert f.contains(keys[15_000:]).all() and f.contains(keys[:15_000]).mean() < 0.002
    f.insert(keys[:10_000])
    assert f.contains(keys[:10_000]).all()
    assert CuckooFilter(0).build(keys[:0]).contains(keys).sum() == 0


def test_inserting_again_replaces(docs):
    df = docs(corpus(5))
    table = lambda x: sorted(map(tuple, x.references.select("key_a", "key_b", "n_docs", "first_doc", "last_doc").collect()))
    index = LineIndex.build(df)
    again = index.insert(df.where("doc_id < 20"))
    assert table(again) == table(index)
    assert sorted(map(tuple, again.drops().collect())) == sorted(map(tuple, index.drops().collect()))
    one = LineIndex.build(docs(["a line that one holds"]))
    twice = one.insert(docs(["a line that one holds"]))
    assert [r.n_docs for r in twice.references.collect()] == [1] and twice.drops().count() == 0
    changed = one.insert(docs(["a line of another wording"]))
    assert table(changed) == table(LineIndex.build(docs(["a line of another wording"])))
