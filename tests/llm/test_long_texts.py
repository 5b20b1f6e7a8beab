"""Long texts in packing: the same ids in parts, in bounded memory."""

import random
import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scanweave.llm import packing
from scanweave.llm.packing import WordEncoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
MEASURE = """
import resource, sys
from scanweave.llm.packing import Packer, WordEncoder
import public_tokenizers
own = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
kind, mb = sys.argv[1], int(sys.argv[2])
words = {"plain": "Some words, and 123 numbers aren't many. ", "beyond": "Слова и числа 12. 数字和文字，很多。 "}[kind]
list(own.packed([words * 10_000]))
text = words * (mb * 1_000_000 // len(words.encode()))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
packer = Packer(4096, 0)
for ids in own.packed([text]):
    packer.add(1, ids)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024, len(packer.done))
"""


def texts():
    rng = random.Random(3)
    parts = ["word", "Straße", "İ", "Ǆ", "don't", "123", " ", "  \n", "\t", "　", "数字", "文。", "，很", "한국어", "ΑΣ", "é", " ́", "<|startoftext|>", "!!", "\x1f", "、", "ー", "？", "ก็", "😀"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(400))) for _ in range(60)] + ["文。文，字" * 200, "x" * 900, "。" * 300 + "字"]


@pytest.mark.parametrize("part", [1, 7, 60])
def test_parts_have_the_ids_of_the_whole(monkeypatch, part):
    own, tok = WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    monkeypatch.setattr(packing, "PART", part)
    assert own.cuts and max(len(list(own.pieces(x))) for x in texts()) > 3
    for x in texts():
        assert "".join(own.pieces(x)) == x
        assert next(own.packed([x])) == np.array(tok.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), repr(x)


@pytest.mark.parametrize("kind", ["plain", "beyond"])
def test_memory_of_a_long_text(kind):
    found = subprocess.run([sys.executable, "-c", MEASURE, kind, "40"], capture_output=True, text=True, timeout=300)
    more, windows = map(float, found.stdout.split())
    assert windows > 1000 and more < 150, (more, found.stderr[-500:])
