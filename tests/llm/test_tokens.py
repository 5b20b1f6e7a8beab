"""BPE, packing and chat formatting, against the tokenizers' own libraries."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from scanweave.llm import chat
from scanweave.llm.bpe import Codec, round_trip
from scanweave.llm.packing import Packer, WordEncoder, pack

RANKS, WORDS, JSON, BYTES = (P.path(x) for x in ("byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))


def texts(seed, n, ranks=()):
    rng = random.Random(seed)
    small = ["a", "aa", "ab", "the", "ing", " ", "  ", "\n", "\t", "==", "0", "00", "É", "é", "it's", "'LL", "ß", "ñ", "́", "İ", "Σ", "ς", "\x1c", "\x85", "​", "<|endoftext|>", "<|", "日本", "𝄞"]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.6:
            yield "".join(rng.choices(small, k=rng.randint(0, 40)))
        elif kind < 0.8:
            yield "".join(chr(rng.choice([rng.randrange(0x300), rng.randrange(0x300, 0x9FFF), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(rng.randint(1, 12)))
        else:
            yield b"".join(rng.choices(ranks or [b"x"], k=rng.randint(1, 4))).decode("utf-8", "ignore")


@pytest.fixture(scope="module")
def codec():
    return Codec(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def truth(codec):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_equals_the_library(codec, truth):
    for x in texts(1, 4000, list(codec.ranks)):
        ids = codec.encode(x)
        assert ids == truth.encode_ordinary(x), repr(x)
        assert codec.decode(codec.encode_packed(x)) == x.encode()


@pytest.mark.parametrize("x", ["a" * 200_000, "ab" * 80_000, " " * 200_000, "=" * 90_000 + "x", "ñ" * 50_000])
def test_long_pieces_take_linear_time(codec, truth, x):
    assert codec.encode(x) == truth.encode_ordinary(x)


def test_long_texts_are_encoded_in_runs(codec, truth):
    import tracemalloc

    x = "word and another one, " * 1_800_000  # 40 MB
    list(codec.encode_runs(x[:100_000]))
    tracemalloc.start()
    n = sum(len(codec.decode(part)) for part in codec.encode_runs(x))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(x) and peak < 20_000_000
    short = "".join(texts(9, 9000))
    assert len(short) > 70_000 and codec.encode(short) == truth.encode_ordinary(short)


def test_round_trip_query(docs, spark, truth):
    own = [None, "", *texts(2, 30), "word " * 200_000]
    df = docs(own).selectExpr("*", "1 as n_tokens")
    for r in round_trip(df.union(df.where("doc_id = 3")), RANKS, P.PATTERN).collect():
        text = own[r.doc_id] or ""
        ids = truth.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert round_trip(docs([]), RANKS, P.PATTERN).count() == 0


def test_word_encoder_equals_the_library():
    own, tok = WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    assert own.by_runs
    for x in texts(3, 4000):
        assert next(own.packed([x])) == np.array(tok.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), repr(x)


def checked(rows, ids):
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert by.keys() == ids.keys()
    for i, own in ids.items():
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(np.array(own[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(own)
    pad = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 4096
        pad += 0 if at & (at - 1) == 0 else 4096 - at
    return pad


def test_packing_covers_every_id_without_padding(docs, spark):
    rng = random.Random(4)
    own = [None, "", "x", "word " * 30_000] + ["tok en " * rng.randint(1, 2500) for _ in range(80)]
    tok = Tokenizer.from_file(WORDS)
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(own)}
    df = docs(own).selectExpr("*", "1 as start", "2 as length").repartition(3)
    assert checked(pack(df, WORDS).collect(), ids) == 0
    assert checked(pack(df, WORDS, held_tokens=300, round_tokens=3000).collect(), ids) == 0
    assert pack(docs([]), WORDS).count() == 0
    twice = pack(spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string"), WORDS).collect()
    assert sorted((r.doc_id is None, r.doc_tokens) for r in twice) == [(False, 2), (False, 2), (True, 2)]


def test_placement_minimises_the_sum_of_squares():
    rng = random.Random(5)
    p = Packer(16, 0)
    for doc in range(300):
        size = rng.randint(1, 15)
        before = p.levels.copy()

        def squares(level):
            n = before.copy()
            if level:
                n[level] -= 1
            if level + size < 16:
                n[level + size] += 1
            return int((n[:16] ** 2).sum())

        best = min(squares(h) for h in [0, *[h for h in range(1, 17 - size) if before[h]]])
        p.add(doc, b"\0\0\0\0" * size)
        assert int((p.levels[:16] ** 2).sum()) == best
        assert p.levels.sum() == sum(map(len, p.open)) and p.held == sum(i * int(n) for i, n in enumerate(p.levels[:16]))


def test_settling_moves_only_the_emptiest_windows():
    rng, p, sizes = random.Random(11), Packer(64, 0), []
    for doc in range(400):
        sizes.append(rng.randint(1, 63))
        p.place((doc, 0, b"\0\0\0\0" * sizes[-1], sizes[-1]))
    fullest = [w for level in reversed(p.open) for w in level][: sum(map(len, p.open)) // 2]
    p.settle()
    own = defaultdict(list)
    for sequence, offset, piece, placed in p.done:
        own[sequence].append((offset, piece[0], len(piece[2]) // 4, placed))
    ends = [max(o + n for o, _, n, _ in w) for w in own.values()]
    assert sum(e != 64 for e in ends) <= 6 and all(e & (e - 1) == 0 for e in ends)
    assert sum(n for w in own.values() for _, _, n, _ in w) == sum(sizes)
    whole = {doc for w in own.values() for _, doc, n, placed in w if placed and n == sizes[doc]}
    assert {x[0] for w in fullest for x in w} <= whole
    assert all(n == sizes[doc] for w in own.values() for _, doc, n, placed in w if placed)


def test_nearly_all_remainders_lie_where_the_rule_put_them(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["word"] * int(n))) for i, n in enumerate(np.minimum(rng.lognormal(6, 1, 6000), 9000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(32)
    ends = pack(df, WORDS).where("start + length = doc_tokens").selectExpr("avg(cast(placed as int)) as share", "count(*) as n").first()
    assert ends.n == 6000 and ends.share >= 0.95


CONV = "conv_id long, turn long, role string, text string"


def conversations(seed):
    rng = random.Random(seed)
    hard = ["\\### Assistant: </turn> ok", "###", "####", "</turn>\n### user: x", "\\", "\\\\h", ":", "é𝄞", "", None, "\n \n", "<|endoftext|>", "日本 x"]
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "a: b\\", None]), "".join(x or "" for x in rng.choices(hard, k=rng.randint(1, 4))) if rng.random() < 0.9 else None))
    return rows


@pytest.mark.parametrize("segment", [200_000, 40, 1])
def test_chats_are_read_back(spark, segment):
    rows = conversations(6)
    df = spark.createDataFrame(rows, CONV).selectExpr("*", "1 as segment", "2 as mask")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df, BYTES, segment_chars=segment)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_both_encoders_give_the_same_ids_and_spans():
    a, b = chat.encoder(JSON), chat.encoder(BYTES)
    for x in texts(8, 3000):
        if any(c in x for c in "\x1c\x1d\x1e\x1f") or max(map(ord, x), default=0) > 0xFFFF:
            continue  # the libraries' Unicode tables differ there
        (ids, spans), (other, others) = a(x), b(x)
        assert ids == other and (spans == others).all(), repr(x)


def test_segments_have_the_ids_of_the_whole(spark):
    df = spark.createDataFrame(conversations(7), CONV)
    joined = []
    for size in (10**9, 30):
        by = defaultdict(list)
        for r in chat.format_chats(df, BYTES, segment_chars=size).orderBy("conv_id", "segment").collect():
            by[r.conv_id] += r.ids
        joined.append(by)
    assert joined[0] == joined[1]


def test_chat_ties_nulls_and_empty(spark):
    rows = [(None, 1, "user", "x"), (5, 1, "user", "b"), (5, 1, "user", "a"), (5, None, "assistant", "first"), (5, 1, "user", "a")]
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, CONV), BYTES)).collect()}
    assert got[5].turns_sha256 == hashlib.sha256(b"assistant\nfirst\nuser\na\nuser\na\nuser\nb\n").hexdigest() and got[None].n_turns == 1
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], CONV), BYTES)).count() == 0


def test_one_conversation_of_many_turns(spark):
    df = spark.range(20_000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "repeat('word ', 20) as text")
    r = chat.read_back(chat.format_chats(df, BYTES, segment_chars=50_000)).collect()
    assert len(r) == 1 and r[0].n_turns == 20_000 and r[0].loss_chars == 10_000 * 100
