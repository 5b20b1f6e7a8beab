"""Byte-level BPE encoding and decoding in linear time (operator 3).

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over strings finds all vocabulary entries in
one scan. From the left, the longest match is tried first; it stands if merging could have left it next to the token
before, otherwise shorter matches are tried, then the token before is taken back. Whether two tokens can be adjacent is
decided by undoing merges at their common border, and remembered. Each place is given up at most once, so the work is
linear, and the result is that of applying merges by rank.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.llm import _text
from scanweave.llm._scratch import small_batches

#: Pieces whose ids a worker remembers; then the older half is forgotten.
REMEMBERED = 400_000
#: Characters from which a text is encoded run by run, pieces in a run, and ids that are decoded at once.
RUN = 1 << 16


class Codec:
    """Encodes and decodes by a rank file: base64 bytes and rank in each line."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # Python's \s also takes the separators U+001C to U+001F, which have no White_Space property
        self.pattern = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for b, i in self.ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        for b, i in self.ranks.items():
            self.shorter[i] = next((self.ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ranks), -1)
        self.merge_of: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.adjacent: dict[tuple[int, int], bool] = {}
        for b, i in sorted(self.ranks.items(), key=lambda x: x[1]):
            self._learn(b, i)
        self.adjacent.clear()
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, b: bytes, i: int) -> None:
        """The merge that makes token i: its only split into lower tokens that merging leaves side by side."""
        left = self.shorter[i]
        while left >= 0:
            right = self.ranks.get(b[len(self.bytes_of[left]) :], -1)
            if 0 <= right < i and left < i and self._compatible(left, right):
                self.merge_of[left, right] = i
                self.parts[i] = left, right
                return
            left = self.shorter[left]
        self.parts[i] = i, i

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank can end with the two tokens side by side: undo the later of the two tokens' merges at
        the border, again and again; a merge across the border that would have come first forbids the pair."""
        limit = len(self.ranks) + 1
        while True:
            if self.merge_of.get((left, right), limit) < limit:
                return False
            undo_left = left > right
            for _ in range(2):
                if undo_left:
                    limit, inner = left, self.parts[left][1]
                    if inner != left:
                        left = inner
                        break
                else:
                    limit, inner = right + 1, self.parts[right][0]
                    if inner != right:
                        right = inner
                        break
                undo_left = not undo_left
            else:
                return True

    def piece(self, data: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        n = len(data)
        longest, sizes = ([-1] * n, [0] * n) if n < RUN else (array("i", [-1]) * n, array("i", [0]) * n)
        for end, (size, i) in self.automaton.iter(data.decode("latin-1")):
            start = end - size + 1
            if size > sizes[start]:
                sizes[start], longest[start] = size, i
        open_ends = bytearray(b"\x01") * (n + 1)
        ids: list[int] = []
        at, token = 0, longest[0]
        adjacent, lengths, shorter = self.adjacent, self.bytes_of, self.shorter
        while at < n:
            end = at + len(lengths[token])
            fits = open_ends[end]
            if fits and ids:
                pair = ids[-1], token
                fits = adjacent.get(pair)
                if fits is None:
                    if len(adjacent) > 1_000_000:
                        adjacent.clear()
                    fits = adjacent[pair] = self._compatible(*pair)
            if fits:
                ids.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_ends[at] = 0
                token = ids.pop()
                at -= len(lengths[token])
        return ids

    def _packed(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = np.array(self.piece(piece.encode("utf-8")), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self.recent) >= REMEMBERED // 2:
                self.older, self.recent = self.recent, {}
            self.recent[piece] = found
        return found

    def _joined(self, pieces: Iterable[str]) -> bytes:
        get, make = self.recent.get, self._packed
        out = []
        for piece in pieces:
            found = get(piece)
            if found is None:
                found = make(piece)
                get = self.recent.get
            out.append(found)
        return b"".join(out)

    def encode_runs(self, text: str) -> Iterator[bytes]:
        """The ids of a text as little-endian unsigned 32-bit integers, run by run where it is long."""
        if len(text) < RUN:
            yield self._joined(self.pattern.findall(text))
            return
        pieces = (m.group() for m in self.pattern.finditer(text))
        while (piece := next(pieces, None)) is not None:
            yield self._joined((piece, *islice(pieces, RUN // 4)))

    def encode_packed(self, text: str) -> bytes:
        return b"".join(self.encode_runs(text))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, packed: bytes) -> bytes:
        """The bytes of ids given as little-endian unsigned 32-bit integers."""
        ids = np.frombuffer(packed, "<u4")
        return b"".join(b"".join(map(self.bytes_of.__getitem__, ids[i : i + RUN].tolist())) for i in range(0, len(ids), RUN))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec in each worker process."""
    return Codec(path, pattern)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row of docs (doc_id, text).

    Null text is taken as empty: no ids. Repeated rows get equal results; other columns are not read, whatever their names.
    Empty table: no rows. path must be readable on every worker. Memory is that of a batch of texts and of a run of ids: a
    long text is encoded, hashed and decoded run by run. Only a single match of the pattern is held whole (about 20 bytes
    for each of its bytes).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = _text.column(batch, "text")
            counts, ids, decoded = [], [], []
            for x in texts:
                n, coded, plain = 0, hashlib.sha256(), hashlib.sha256()
                for packed in own.encode_runs(x.as_py()):
                    n += len(packed) // 4
                    coded.update(packed)
                    plain.update(own.decode(packed))
                counts.append(n)
                ids.append(coded.hexdigest())
                decoded.append(plain.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
