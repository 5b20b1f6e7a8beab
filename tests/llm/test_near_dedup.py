import random
import re
from itertools import combinations

import numpy as np
import pytest

from scanweave.llm import _text, near_dedup as nd
from scanweave.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def shingles(text, k=5):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(texts, percent=85):
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in texts}


def corpus(seed):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(500)] + ["É", "naïve", " x", "A b"]
    out = [None, "", " \t\n", "one", "ONE", "one two three four", "one two three  four", "one two three four five"]
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(5, 200))
        for _ in range(rng.randint(1, 8)):
            own = base[:]
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(rng.choice([" ", "\n", "\t "]).join(own))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(docs, seed):
    texts = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_dedup(docs(texts)).collect()}
    assert got == brute(dict(enumerate(texts)))


def test_small_blocks_and_shuffled_ids(docs, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 2)
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 50)
    monkeypatch.setattr(nd, "BROADCAST_IDS", 1)
    texts = corpus(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_dedup(docs(texts)).collect()}
    assert got == brute(dict(enumerate(texts)))


def test_nulls_repeats_clashing_columns_and_empty(spark, docs):
    rows = [(None, "a b c d e f", 1), (3, "a b c d e f", 2), (3, "a b c d e f", 3), (7, "a b c d e f", 4), (9, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int").selectExpr("*", "'x' as bands", "1 as bucket", "2 as kept")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in nd.near_dedup(df).collect()), key=str)
    assert got == sorted([(None, None, True), (3, 3, True), (3, 3, True), (7, 3, False), (9, 9, True)], key=str)
    assert nd.near_dedup(docs([])).count() == 0


def test_a_very_long_text(docs):
    long = " ".join(f"w{i % 70001}" for i in range(300_000))
    got = {r.doc_id: r.component_id for r in nd.near_dedup(docs([long, "x " + long, "y"])).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for n, overlap in ((3, 2), (40, 30), (400, 320), (3000, 2700)):
        found = []
        for _ in range(30):
            pool = rng.integers(1, 1 << 63, 2 * n - overlap, dtype=np.uint64)
            values, rows = np.concatenate([pool[:n], pool[n - overlap :]]), np.repeat([0, 1], [n, n])
            sig = nd.signatures(values, rows, 2, 125)
            found.append((sig[0] == sig[1]).mean())
        assert abs(np.mean(found) - overlap / (2 * n - overlap)) < 0.05


def test_signatures_do_not_depend_on_neighbours():
    rng = np.random.default_rng(1)
    values = rng.integers(1, 1 << 63, 60, dtype=np.uint64)
    rows = np.repeat([0, 1, 2], [2, 50, 8])
    whole = nd.signatures(values, rows, 3, 125)
    for r in range(3):
        assert (nd.signatures(values[rows == r], np.zeros((rows == r).sum(), int), 1, 125)[0] == whole[r]).all()


def test_equal_bytes_hash_equally_anywhere():
    import pyarrow as pa

    texts = ["x" * i + " needle " + "y" * (50 - i) for i in range(50)] + ["NEEDLE", "é needle"]
    for size in (10, 1 << 20):
        hashes = set()
        for part in _text.chunks(pa.array(texts, pa.large_string()), size):
            s, e, _ = part.words()
            h = part.hash_spans(s, e, lower=True)
            hashes |= {int(h[i]) for i in range(len(s)) if part.data[s[i] : e[i]].tobytes().lower() == b"needle"}
        assert len(hashes) == 1


@pytest.mark.parametrize("per_task", [1000, 30, 7])
def test_components(spark, per_task):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame([e for e in edges if e[0] != e[1]], "a long, b long"), per_task).collect()}
    assert all(got[x] == find(x) for x in got)
    assert set(got) >= {x for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize("own", [14, 50])
def test_texts_of_a_template_do_not_meet_all_others(docs, monkeypatch, own):
    """200 shared words and some of each text's own at a place of its own: below the threshold, but for those at the end."""
    seen = []
    real = nd._in_blocks

    def counted(rows, *more):
        rows = nd.keep(rows, "test-rows")
        seen.append(rows.count())
        return real(rows, *more)

    monkeypatch.setattr(nd, "_in_blocks", counted)
    template, rows = [f"t{i}" for i in range(200)], []
    for n in (150, 300):
        rng = random.Random(n)
        texts = []
        for i in range(n):
            at = 200 if i in (5, 90, 140) else rng.randrange(4, 196)
            texts.append(" ".join(template[:at] + [f"o{i}x{k}" for k in range(own)] + template[at:]))
        seen.clear()
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_dedup(docs(texts)).collect()}
        assert got == brute(dict(enumerate(texts)))
        assert own == 50 or got[140][1] == 5
        rows.append(sum(seen))
    # a bucket's row is a member and all that meet it there; without the bound there were some nine for each text
    assert max(rows) <= 3 * 30, rows
