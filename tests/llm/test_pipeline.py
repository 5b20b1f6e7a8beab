"""Each stage of the corpus pipeline against brute force on what the stage before left."""

import random
from collections import defaultdict

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from scanweave.llm import queries

from .test_line_dedup import brute as brute_lines
from .test_near_dedup import brute as brute_near
from .test_quality import brute as brute_counts

WORDS = {"en": "the house of stone and river with winter light over green valley small birds came".split(), "de": "der stein und das haus mit fluss winter licht über grünem tal kleine vögel kamen".split()}


def corpus():
    rng = random.Random(1)
    texts, langs = [], []

    def add(text, lang="en"):
        texts.append(text)
        langs.append(lang)

    def prose(lang, n=90):
        out = [rng.choice(WORDS[lang]) + rng.choice(["", "", "s", str(rng.randrange(50))]) for _ in range(n)]
        return "\n".join(" ".join(out[i : i + 15]) + "." for i in range(0, n, 15))

    for i in range(60):
        lang = "de" if i % 3 == 0 else "en"
        own = prose(lang)
        add(own, lang)
        if i % 4 == 0:  # one long line each, so that only near-dedup can see that they are alike
            words = prose(lang).split()
            add(" ".join(words), lang)
            words[5] = "changed"
            add(" ".join(words), lang)
        if i % 5 == 0:
            add("shared line that many documents hold in common.\n" + prose(lang), lang)
        if i % 7 == 0:
            add(own, lang)
    for own in (None, "", "123 456 --", "too short", " ".join(w + "###" for w in prose("en").split()), " ".join(w.upper() + "!!" for w in prose("en").split())):
        add(own)
    return texts, langs


def test_stages(spark, docs, tmp_path):
    texts, langs = corpus()
    start = docs(texts, langs)
    start.write.parquet(f"{tmp_path}/documents.parquet")
    outs, own = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, own, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        own = spark.read.parquet(f"{tmp_path}/{name}")
        outs.append(own)
    assert all(x.dtypes == start.dtypes for x in outs[:-1])
    text_of = lambda df: {r.doc_id: r.text for r in df.collect()}
    language, quality, lines, near = (text_of(x) for x in outs[:-1])

    assert set(language) == {i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    failed = {i for i, t in language.items() if (c := brute_counts(t))[0] < 50 or 100 * c[4] > 50 * c[0]}
    junk = {i for i, t in language.items() if "###" in t or "!!" in t}
    assert set(quality) == set(language) - failed - junk and all(quality[i] == texts[i] for i in quality)

    import hashlib

    want = brute_lines(quality)
    assert lines.keys() == quality.keys() and all(hashlib.sha256(lines[i].encode()).hexdigest() == want[i][2] for i in lines)
    assert all(r.n_chars == len(r.text) for r in outs[2].collect())
    classes = brute_near(lines)
    assert set(near) == {i for i in lines if classes[i][1] == i or classes[i][0] == 0} < set(lines)

    tok, ids = Tokenizer.from_file(P.path("word_bpe_49k.json")), defaultdict(int)
    for r in outs[-1].collect():
        ids[r.doc_id] += r.length
    assert ids == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in near.items()}
    whole = {(r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i for i, _, _ in whole} == set(near)


def test_language_drops_what_was_not_learned(spark, docs):
    """Without a label, so that they are not learned from: words in other scripts, of chance letters, and in Finnish and Polish."""
    rng = random.Random(4)
    texts, langs = corpus()
    texts, langs = texts[:-6], langs[:-6]
    n = len(texts)
    scripts = ["абвгдежзиклмнопрстуфхя", "αβγδεζηθικλμνξοπρστυφχψω", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "的一是不了人我在有他这中大来上国个到说们", "bcfjkqxzyvjpw"]
    finnish = "tämä yksinkertainen teksti ei kuulu opittuihin kieliin ja lapset juoksevat metsässä syövät marjoja kesällä joka päivä"
    polish = "dzieci biegają po lesie i jedzą jagody ten prosty tekst nie należy do wyuczonych języków każdego dnia latem"
    for i in range(100):
        words = ["".join(rng.choices(s, k=rng.randint(2, 9))) for s in [scripts[i % 5]] for _ in range(60)]
        texts.append(" ".join(words))
    texts += [finnish, polish]
    left = {r.doc_id for r in corpus_pipeline.language(spark, docs(texts, langs + [None] * 102), "").collect()}
    assert left == set(range(n))


def test_near_duplicates_from_four_fifths(spark, docs):
    """Of 100 words each; a changed word costs five of 96 shingles, so two and four changes leave 0.81 and 0.66."""
    texts = []
    for pair in range(20):
        words = [f"p{pair}w{i}" for i in range(100)]
        for changes in (0, 2, 4):
            own = words[:]
            for c in range(changes):
                own[20 + 12 * c] = f"c{changes}x{c}"
            texts.append(" ".join(own))
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs(texts), "").collect()}
    assert left == {i for i in range(60) if i % 3 != 1}
    assert left == {i for i, (_, component) in brute_near(dict(enumerate(texts)), 80).items() if i == component}


def test_repeated_rows_stay_once(spark):
    a, b, c = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    rows = [(3, a), (3, a), (3, a), (7, a), (7, a), (8, b), (5, None), (5, None), (None, a), (None, a)]
    rows = spark.createDataFrame([(i, t, "en", "s", 13) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, rows, "").collect()), key=str)
    assert left == sorted([(3, a), (8, b), (5, None), (None, a), (None, a)], key=str)
    differ = spark.createDataFrame([(9, b), (9, c), (9, c)], "doc_id long, text string")
    assert sorted(r.text for r in corpus_pipeline.near_duplicates(spark, differ, "").collect()) == [b, c]


def test_empty_table(spark, docs, tmp_path):
    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    names = [n.split("_")[0] for n in queries.queries()]
    assert names == [f"op{i}" for i in range(1, 14)] and set(queries.oracle_sql()) <= set(queries.queries())


def test_run_folders_are_dropped(spark):
    import os

    from scanweave.llm import _scratch

    base = _scratch.shared_dir(spark).removeprefix("file://")
    with _scratch.run_folder(spark) as folder:
        kept = _scratch.keep(spark.range(5).toDF("x"), "inside")
        assert folder in kept.inputFiles()[0]
    assert kept.count() == 5 and spark.conf.get(_scratch.RUN, None) is None
    _scratch.drop(spark, folder)
    assert not os.path.exists(f"{base}/{folder.rsplit('/', 1)[-1]}")
