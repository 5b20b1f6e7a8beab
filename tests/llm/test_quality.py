import random
import re
from collections import Counter

import numpy as np
import pytest

from scanweave.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    triples = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def corpus(seed):
    rng = random.Random(seed)
    pool = ["a", "b", "cé", "##", "𝄞x", "<b>", "A", "a|b", "nbsp here"]
    out = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x\nx\n x\nx \n\nx", "a b a b a b a"]
    return out + ["".join(rng.choice(pool) + rng.choice([" ", " ", "\n", "\r\n", "\t"]) for _ in range(rng.randint(1, 120))) for _ in range(60)]


def test_counts_against_brute_force(docs):
    texts = corpus(1)
    for r in q.quality(docs(texts)).collect():
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def prose(rng, n=120):
    words = ["the", "house", "of", "stone", "river", "and", "winter", "came", "with", "light", "a", "valley", "small", "birds", "over", "green"]
    out = [rng.choice(words) + str(rng.randrange(10) or "") for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(out))


def test_junk_goes_and_clean_texts_stay(docs):
    rng = random.Random(2)
    clean = [prose(rng) for _ in range(150)]
    junk = [" ".join(w + rng.choice(["###", "***", "$$$"]) for w in prose(rng).split()) for _ in range(15)]
    junk += [" ".join(w.upper() + "!!" for w in prose(rng).split()) for _ in range(15)]
    junk += [" | ".join(prose(rng).replace(".", "").split()) for _ in range(15)]
    got = {r.doc_id: r.kept for r in q.quality(docs(clean + junk)).collect()}
    assert all(got[i] for i in range(150)) and not any(got[i] for i in range(150, len(got)))


@pytest.mark.parametrize("share", [0.0, 0.02, 0.5])
def test_rules_accuracies_are_recovered(share):
    rng = np.random.default_rng(3)
    n, truth = 40_000, np.array([[0.6, 0.1, 0.3], [0.02, 0.1, 0.88]])
    good = rng.random(n) >= share
    votes = np.where(good[:, None, None], truth[1], truth[0])
    votes = (rng.random((n, 6, 1)) > np.cumsum(votes, axis=-1)).sum(axis=-1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = q.expectation_maximisation(patterns, counts.astype(float))
    assert abs(model.prior - (1 - share)) < 0.02
    if share:
        assert np.abs(np.array(model.rates) - truth[:, None, :]).max() < 0.05


def test_abstentions_reject_nothing():
    """Rules that are silent together on some clean documents do not make a class of them."""
    votes = np.array([[2, 2, 2, 2], [1, 1, 1, 2], [1, 1, 1, 1], [0, 0, 2, 2], [0, 1, 2, 0]])
    model = q.expectation_maximisation(votes, np.array([6000.0, 2500.0, 800.0, 300.0, 200.0]))
    rates = np.array(model.rates)
    odds = np.log(model.prior / (1 - model.prior)) + np.array([sum(np.log(rates[1, r, v] / rates[0, r, v]) for r, v in enumerate(x)) for x in votes])
    assert (odds[:3] > 0).all() and (odds[3:] < 0).all()


def test_no_data_repeats_clashes_and_long_texts(spark, docs):
    assert q.quality(docs([])).count() == 0 and q.kept_only(docs([])).count() == 0
    rng = random.Random(4)
    text = prose(rng, 300_000)
    df = docs([text, text, None]).selectExpr("*", "'x' as n_words", "1 as quality_stats", "2 as kept")
    got = {r.doc_id: r for r in q.quality(df).collect()}
    assert got[0].n_words == 300_000 and got[0][1:] == got[1][1:] and not got[2].kept
    kept = q.kept_only(docs([prose(rng), None, "", prose(rng)]).selectExpr("*", "'x' as n_words"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3] and kept.columns[-1] == "n_words"
