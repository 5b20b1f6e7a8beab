"""Sum-of-squares online packing of tokenised documents into fixed windows (operator 7).

A document's full windows stand alone; what is left of it goes, uncut, to the fill level that minimises the sum over
levels of the squared number of partially filled windows, which an array counts by level.

Two rounds place by that rule. In the first, each task packs its own rows and keeps the windows that are full; the pieces
in the windows still open at its end (or in the emptiest ones, when open windows hold more than HELD_TOKENS) are not cut but
go on. In the second, the pieces of many tasks together, about ROUND_TOKENS in each task, are placed by the same rule. Only
what is then open has to be settled: the fullest windows stay as they are and are filled up with cut pieces of the emptiest
ones, and the last rest is cut into powers of two, which need no padding. The column placed says which pieces the rule put
where they are.

One task's memory is bounded by the two constants. The shuffle carries the ids of pieces that the first round left open.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tiktoken import _tiktoken as tiktoken
from tokenizers import Tokenizer

from scanweave.llm import _text
from scanweave.llm._scratch import keep, small_batches

#: Tokens that a first-round task holds in open windows, and tokens that a second-round task gets (4 bytes each).
HELD_TOKENS = ROUND_TOKENS = 16_000_000
#: Second-round sequences are numbered from here, above all of the first round.
SECOND = 1 << 62
#: Runs that a worker remembers; then the older half is forgotten.
REMEMBERED = 250_000
#: Characters that are encoded at once, about.
PART = 100_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, placed boolean"


#: How byte-level vocabularies spell bytes: those that print as themselves, the others from U+0100 on.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTES = {chr(b): b for b in _PRINTED} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*_PRINTED}))}
#: Stands for the end of a word in the merges; UTF-8 has no such byte.
_WORD_END, _END_MARK = b"\xff", "</w>"


#: ASCII marks that are neither letters nor digits, without the apostrophe, which can belong to a match of its own.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _merger(model: dict):
    """The model's merges by rank, or None if its ids are not in the order of its merges. The merger is tiktoken's, which
    makes no object for each token."""
    vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    base = len(vocab) - len(merges)
    if model.get("end_of_word_suffix") != _END_MARK or any(vocab["".join(m)] != base + i for i, m in enumerate(merges)):
        return None
    plain = {t.removesuffix(_END_MARK): _END_MARK if t.endswith(_END_MARK) else "" for t, i in vocab.items() if i < base}
    if len(plain) != 256 or any(len(t) != 1 for t in plain):
        return None
    ranks = {bytes(_BYTES[c] for c in t.removesuffix(_END_MARK)) + (_WORD_END if t.endswith(_END_MARK) else b""): i for t, i in vocab.items()}
    return tiktoken.CoreBPE(ranks, {}, r"(?s).+")


class WordEncoder:
    """Encodes texts with a tokenizer file. Where the file splits texts by a pattern that crosses no white space, after
    lower-casing, the ids of a run without white space do not depend on its surroundings, and recent runs are remembered.
    Other files, and texts with characters on which Unicode versions differ, go through the tokenizer as they are."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        steps = [x["type"] for x in (held.get("normalizer") or {}).get("normalizers", [])]
        splits = (held.get("pre_tokenizer") or {}).get("pretokenizers", [])
        pattern = splits[0]["pattern"].get("Regex", "") if splits and splits[0]["type"] == "Split" else ""
        parts = [x["type"] for x in splits] == ["Split", "ByteLevel"] and splits[0]["behavior"] == "Removed" and splits[0]["invert"]
        self.by_runs = steps == ["NFC", "Replace", "Lowercase"] and parts and " " not in pattern and r"\s" not in pattern.replace(r"[^\s", "")
        self.merger = _merger(held["model"]) if self.by_runs else None
        self.by_runs = self.merger is not None
        self.special = [x["content"] for x in held.get("added_tokens", [])]
        # long texts are cut here: behind ASCII white space, or where East Asian punctuation meets a letter; no match of the
        # pattern crosses either, and neither normalisation nor an added token without white space does
        self.border = regex.compile("(?<=[\\t-\\r ])|(?<=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])(?=[\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7a3])")
        self.cuts = self.by_runs and not any(self.border.search(x) for x in self.special)
        # up to U+024F, NFC changes nothing and lower-casing is plain; Python alone takes U+001C to U+001F for white space
        self.beyond = regex.compile("[^\\x00-\\x1b\\x20-\\u024f]")
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, runs: set[str]) -> None:
        if len(self.recent) >= REMEMBERED // 2:
            self.older, self.recent = self.recent, {}
        recent, older, odd, piece = self.recent, self.older, [], self.merger.encode_single_piece
        for x in runs:
            if (known := older.get(x)) is not None:
                recent[x] = known
                continue
            word = x.rstrip(_MARKS)
            if not word.isalpha():
                odd.append(x)
            elif word == x:
                recent[x] = _packed(piece(x.encode("utf-8") + _WORD_END))
            else:  # letters are one match of the pattern, and the marks behind them another
                marks = x[len(word) :]
                if marks not in recent:
                    recent[marks] = _packed(self.tokenizer.encode(marks, add_special_tokens=False).ids)
                recent[x] = _packed(piece(word.encode("utf-8") + _WORD_END)) + recent[marks]
        for x, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            recent[x] = _packed(e.ids)

    def pieces(self, text: str) -> Iterator[str]:
        """Parts of a text whose ids, one after the other, are the text's. A part is about PART characters, or as long as its
        file leaves no border to cut at."""
        at = 0
        while self.cuts and len(text) - at > 2 * PART and (m := self.border.search(text, at + PART)) and m.start() < len(text):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def packed(self, texts: list[str]) -> Iterator[bytearray]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        for text in texts:
            out = bytearray()
            for part in self.pieces(text):
                self._encode(part, out)
            yield out

    def _encode(self, text: str, out: bytearray) -> None:
        if not self.by_runs or self.beyond.search(text) or any(x in text for x in self.special):
            out += _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
            return
        runs = text.lower().split()
        found = list(map(self.recent.get, runs))
        if None in found:
            self._learn({x for x, ids in zip(runs, found, strict=True) if ids is None})
            found = [self.recent[x] if ids is None else ids for x, ids in zip(runs, found, strict=True)]
        out += b"".join(found)


def _packed(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
    return WordEncoder(path)


class Packer:
    """One task's windows. A piece is (doc, start, packed ids, document's tokens); done takes (sequence, offset, piece,
    whether the rule put it there), left takes pieces that another round shall place."""

    def __init__(self, window: int, first_sequence: int, held_tokens: int = HELD_TOKENS):
        self.window, self.next, self.held_tokens = window, first_sequence, held_tokens
        self.levels = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.held = 0
        self.done: list[tuple] = []
        self.left: list[tuple] = []

    def close(self, pieces: list, moved: int = 0) -> None:
        """Makes a sequence of pieces; the last `moved` of them are not where the rule put them."""
        offset = 0
        for i, p in enumerate(pieces):
            self.done.append((self.next, offset, p, i < len(pieces) - moved))
            offset += len(p[2]) // 4
        self.next += 1

    def add(self, doc, packed: bytearray) -> None:
        """Full windows are views of the ids, which stay as long as these wait; what remains is a copy."""
        total, step, view = len(packed) // 4, 4 * self.window, memoryview(packed)
        whole = total // self.window * step
        for at in range(0, whole, step):
            self.close([(doc, at // 4, view[at : at + step], total)])
        if whole < len(packed):
            self.place((doc, whole // 4, bytes(view[whole:]), total))
            if self.held > self.held_tokens:
                self.leave(self.held_tokens // 2)

    def place(self, piece: tuple) -> None:
        size, n = len(piece[2]) // 4, self.levels
        best, gain = 0, 2 * n[size] + 1
        at = np.flatnonzero(n[1 : self.window - size + 1]) + 1
        if len(at):
            gains = 1 - 2 * n[at] + np.where(at + size < self.window, 2 * n[at + size] + 1, 0)
            i = len(gains) - 1 - int(np.argmin(gains[::-1]))  # among equals the fullest window
            if gains[i] <= gain:
                best = int(at[i])
        pieces = self.open[best].pop() if best else []
        if best:
            n[best] -= 1
        pieces.append(piece)
        self.held += size
        if best + size == self.window:
            self.close(pieces)
            self.held -= self.window
        else:
            n[best + size] += 1
            self.open[best + size].append(pieces)

    def leave(self, most: int = 0) -> None:
        """Gives the pieces of the emptiest open windows to another round, until open windows hold no more than `most` tokens."""
        for level in range(1, self.window):
            while self.open[level] and self.held > most:
                self.left += self.open[level].pop()
                self.levels[level] -= 1
                self.held -= level

    def settle(self) -> None:
        """Fills the fullest open windows with cut pieces of the emptiest; cuts the last rest into powers of two."""
        windows = [(level, w) for level in range(1, self.window) for w in self.open[level]]  # emptiest first
        self.open, self.held = [[] for _ in range(self.window)], 0
        self.levels[:] = 0
        loose: list[tuple] = []  # in reverse

        def cut(size: int) -> tuple[list, int]:
            """Up to size tokens of loose pieces and of the windows that come next."""
            nonlocal first
            own = []
            while size:
                if not loose:
                    if first == len(windows):
                        break
                    loose.extend(reversed(windows[first][1]))
                    first += 1
                doc, start, packed, total = loose.pop()
                n = min(size, len(packed) // 4)
                own.append((doc, start, packed[: 4 * n], total))
                if 4 * n < len(packed):
                    loose.append((doc, start + n, packed[4 * n :], total))
                size -= n
            return own, size

        first = 0
        while first < len(windows):
            level, own = windows.pop()
            more, missing = cut(self.window - level)
            if missing:  # nothing else is open
                loose.extend(reversed(own + more))
                break
            self.close(own + more, len(more))
        rest = sum(len(p[2]) // 4 for p in loose)
        while rest:
            size = 1 << min(rest.bit_length() - 1, self.window.bit_length() - 1)
            size = self.window if rest >= self.window else size
            own, _ = cut(size)
            self.close(own, len(own))
            rest -= size


def _rows(done: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(done), 20_000):
        own = done[i : i + 20_000]
        columns = [[x[2][0] for x in own], [x[2][1] for x in own], [len(x[2][2]) // 4 for x in own], [zlib.crc32(x[2][2]) for x in own], [x[2][3] for x in own], [x[0] for x in own], [x[1] for x in own]]
        arrays = [pa.array(c, pa.int64()) for c in columns] + [pa.array([x[3] for x in own], pa.bool_())]
        yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCHEMA.split(", ")])


def _with_ids(batch: pa.RecordBatch, ids: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "ids"])


def pack(docs: DataFrame, path: str, window: int = 4096, end_id: int = 2, held_tokens: int = HELD_TOKENS, round_tokens: int = ROUND_TOKENS) -> DataFrame:
    """The pieces that docs (doc_id, text) are packed into; see SCHEMA.

    A document is its ids and end_id, so that null or empty text gives one piece of end_id. Repeated rows are packed each.
    A long text is one string in a worker, is encoded in parts of about PART characters, and its ids (4 bytes each) stay until its
    full windows have left; a run of PART characters and more without white space or punctuation is encoded whole. A null doc_id stays null. Sequence
    ids are unique; equal levels are broken towards fuller windows, so a task that is run again gives the same pieces. Empty
    table: no rows. Other columns are not read, whatever their names.
    """
    end = np.array([end_id], "<u4").tobytes()

    def finished(packer: Packer) -> Iterator[pa.RecordBatch]:
        for batch in _rows(packer.done):
            yield _with_ids(batch, pa.nulls(batch.num_rows, pa.binary()))
        packer.done = []
        for i in range(0, len(packer.left), 2000):
            own = packer.left[i : i + 2000]
            numbers = range(packer.next, packer.next + len(own))
            packer.next += len(own)
            yield from (_with_ids(b, pa.array([p[2] for p in own], pa.binary())) for b in _rows([(s, 0, p, False) for s, p in zip(numbers, own, strict=True)]))
        packer.left = []

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer = encoder(path), Packer(window, TaskContext.get().partitionId() << 32, held_tokens)
        for batch in batches:
            ids, text = batch.column(0).to_pylist(), _text.column(batch, "text")
            for part in _text.chunks(text):
                texts = text.slice(part.first, part.n).to_pylist()
                for doc, packed in zip(ids[part.first :], own.packed(texts)):  # noqa: B905
                    packed += end
                    packer.add(doc, packed)
                    if len(packer.done) >= 20_000:
                        yield from finished(packer)
                yield from finished(packer)
        packer.leave()
        yield from finished(packer)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, SECOND + (TaskContext.get().partitionId() << 32))
        for batch in batches:
            for piece in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                packer.place(piece)
            yield from _rows(packer.done)
            packer.done = []
        packer.settle()
        yield from _rows(packer.done)

    packed = keep(small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(first, SCHEMA + ", ids binary"), "packed")
    left = packed.where("ids is not null")
    tasks = max(1, ceil((left.agg(F.sum("length")).first()[0] or 0) / round_tokens))
    # each piece has a sequence of its own here, so that neither a document nor a source is a hot key
    left = left.select("doc_id", "start", "ids", "doc_tokens", F.xxhash64("sequence_id").alias("at"), "sequence_id").repartition(tasks, "at").sortWithinPartitions("at", "sequence_id")
    return packed.where("ids is null").drop("ids").unionByName(left.select("doc_id", "start", "ids", "doc_tokens").mapInArrow(second, SCHEMA))
