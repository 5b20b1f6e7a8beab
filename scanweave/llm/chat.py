"""Chat formatting with offset-aligned loss masks (operator 4).

A turn is rendered as `### role: text</turn>` and a line feed, with the control strings inside role and text escaped. A
conversation is rendered whole, encoded once with offsets, and the sorted spans of the assistant's texts are intersected
with the token spans by binary search, so the mask follows characters, whatever a token straddles.

Very long conversations are written as several segments, cut after a turn. There `\\n` is followed by `###`, where the
tokenizer's pattern always splits, so the segments' ids joined are those of the whole. Nothing larger than a segment
is held in memory, however many turns one conversation has.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scanweave.llm._scratch import small_batches

OPEN, CLOSE, ESCAPE = "### ", "</turn>", "\\"
_ESCAPES = {ESCAPE: ESCAPE + ESCAPE, "###": ESCAPE + "h", CLOSE: ESCAPE + "t", ":": ESCAPE + "c"}
_BACK = {v[1]: k for k, v in _ESCAPES.items()}
_IN_TEXT = re.compile(r"\\|###|</turn>")
_IN_ROLE = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(.)")
SEGMENTS = "conv_id long, segment int, text string, ids array<int>, loss_starts array<int>, loss_ends array<int>, mask array<boolean>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaped(x: str, pattern: re.Pattern = _IN_TEXT) -> str:
    return pattern.sub(lambda m: _ESCAPES[m[0]], x)


def unescaped(x: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], x)


def turns(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) of a formatted text."""
    for part in formatted.split(CLOSE + "\n")[:-1]:
        role, _, text = part[len(OPEN) :].partition(": ")
        yield unescaped(role), unescaped(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], tuple[list[int], np.ndarray]]:
    """text -> (ids, code point spans of the tokens). path is a byte-level tokenizer as JSON, or its ranks (.tiktoken) with
    the pattern that public_tokenizers gives. The name of a special token inside a text is text."""
    if not path.endswith(".tiktoken"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        found = Tokenizer.from_file(path)
        found.encode_special_tokens = True

        def by_library(text: str) -> tuple[list[int], np.ndarray]:
            e = found.encode(text, add_special_tokens=False)
            return e.ids, np.array(e.offsets, np.int64).reshape(-1, 2)

        return by_library
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)

    def by_ranks(text: str) -> tuple[list[int], np.ndarray]:
        """Byte-level tokens joined are the text's bytes, so spans follow from their sizes. A token that holds a part of a
        character spans the whole of it."""
        ids = encode(text)
        size = sizes[ids] if ids else np.zeros(0, np.int64)
        ends = np.cumsum(size)
        if text.isascii():
            return ids, np.stack([ends - size, ends], axis=1)
        at = np.cumsum((np.frombuffer(text.encode("utf-8"), np.uint8) & 0xC0) != 0x80) - 1
        return ids, np.stack([at[ends - size], at[ends - 1] + 1], axis=1)

    return by_ranks


def overlaps(tokens: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token span, the part inside one of the sorted, disjoint spans: (starts, ends), equal where there is none."""
    if not len(spans) or not len(tokens):
        return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(spans[:, 1], tokens[:, 0], "right"), len(spans) - 1)
    low, high = np.maximum(tokens[:, 0], spans[at, 0]), np.minimum(tokens[:, 1], spans[at, 1])
    inside = low < high
    return np.where(inside, low, 0), np.where(inside, high, 0)


def format_chats(rows: DataFrame, path: str, loss_role: str = "assistant", segment_chars: int = 200_000) -> DataFrame:
    """SEGMENTS of rows (conv_id, turn, role, text), in order within a conversation.

    loss_starts and loss_ends are code points within the segment's text; mask tells which tokens bear loss. Turns are
    ordered by turn, then role, then text; null turns come first. Null role or text: empty. A null conv_id is a
    conversation of its own. Repeated rows are repeated turns. Other columns are not read. Empty table: no rows.
    """

    def encoded(conv, segment: int, parts: list[str], spans: list[tuple[int, int]]) -> tuple:
        text = "".join(parts)
        ids, offsets = encoder(path)(text)
        low, high = overlaps(offsets, np.array(spans, np.int64).reshape(-1, 2))
        return conv, segment, text, ids, low.tolist(), high.tolist(), (low < high).tolist()

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["conv_id", "segment", "text", "ids", "loss_starts", "loss_ends", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, segment, parts, spans, length, out, size = object(), 0, [], [], 0, [], 0
        for batch in batches:
            for key, role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if parts and (key != conv or length >= segment_chars):
                    out.append(encoded(conv, segment, parts, spans))
                    segment, size = segment + 1, size + length
                    parts, spans, length = [], [], 0
                    if size > 1_000_000:
                        yield batch_of(out)
                        out, size = [], 0
                if key != conv:
                    conv, segment = key, 0
                head, body = f"{OPEN}{escaped(role or '', _IN_ROLE)}: ", escaped(text or "")
                if role == loss_role and body:
                    spans.append((length + len(head), length + len(head) + len(body)))
                parts.append(f"{head}{body}{CLOSE}\n")
                length += len(parts[-1])
        if parts:
            out.append(encoded(conv, segment, parts, spans))
        if out:
            yield batch_of(out)

    rows = small_batches(rows).select(F.col("conv_id").cast("long"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(run, SEGMENTS)


def read_back(segments: DataFrame) -> DataFrame:
    """DIGESTS per conversation, from the formatted texts and masks alone."""

    def row(conv, state: list) -> tuple:
        return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, out = object(), None, []
        for batch in batches:
            for key, text, low, high in zip(*(batch.column(i) for i in range(4)), strict=True):
                key, text = key.as_py(), text.as_py()
                if state is None or key != conv:
                    if state:
                        out.append(row(conv, state))
                    conv, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                end = 0
                marked = []
                for a, b in zip(low.values.to_pylist(), high.values.to_pylist(), strict=True):
                    a = max(a, end)  # tokens of one character have the same span
                    if a < b:
                        marked.append(text[a:b])
                        end = b
                loss = unescaped("".join(marked))
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(text)
            if out:
                yield batch_of(out)
                out = []
        if state:
            yield batch_of([row(conv, state)])

    segments = small_batches(segments).repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return segments.select("conv_id", "text", "loss_starts", "loss_ends").mapInArrow(run, DIGESTS)
