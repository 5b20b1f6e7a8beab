"""Vectorised word, line and shingle hashing over Arrow string columns.

A whole Arrow batch is one byte buffer plus offsets, so words and lines are found and hashed with a fixed number of
numpy passes, without a Python object per word. All hashes are 64 bits and depend on the bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK = 1 << 18
_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BYTE_2 = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE_LOWER_2 = _BYTE_2.copy()
_BYTE_LOWER_2[65:91] = _BYTE_2[97:123]
_MIX = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * U64(2) + U64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = (np.ones(1, U64), np.ones(1, U64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, grown as needed."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        with np.errstate(over="ignore"):
            both = []
            for base in (_PRIME, _INVERSE):
                x = np.full(size, base, U64)
                x[0] = 1
                both.append(np.cumprod(x, dtype=U64))
        if n > 8 * CHUNK:
            return both[0], both[1]
        _powers = (both[0], both[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column without nulls, as large_string."""
    x = batch.column(batch.schema.get_field_index(name))
    return x.cast(pa.large_string()).fill_null("")


class Texts:
    """Some rows of a string column: bytes and row offsets from 0."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
        """64-bit hashes of the byte spans; equal bytes give equal hashes wherever they stand."""
        if not len(starts):
            return np.zeros(0, U64)
        n = len(self.data)
        up, down = powers(n + 1)
        with np.errstate(over="ignore"):
            sums = np.empty(n + 1, U64)
            sums[0] = 0
            table = (_BYTE_LOWER_2 if seed else _BYTE_LOWER) if lower else _BYTE_2 if seed else _BYTE
            np.cumsum(table[self.data] * up[:n], out=sums[1:])
            return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of each run of bytes outside [\\x20\\x09-\\x0D]."""
        solid = ~SPACE[self.data]
        start, end = solid.copy(), solid.copy()
        start[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        inner = self.offsets[:-1][np.diff(self.offsets) > 0]
        start[inner] = solid[inner]
        last = self.offsets[1:][np.diff(self.offsets) > 0] - 1
        end[last] = solid[last]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of each line; an empty row has one empty line."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.offsets[1:], breaks]), kind="stable")
        per_row = np.searchsorted(breaks, self.offsets)
        return starts, ends, np.repeat(np.arange(self.n), np.diff(per_row) + 1)


def chunks(x: pa.Array, size: int = CHUNK) -> Iterator[Texts]:
    """Cuts a column from column() into runs of rows of about `size` bytes; a longer text is a run of its own."""
    if not len(x):
        return
    buffers = x.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[x.offset : x.offset + len(x) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(x):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        stop = min(stop, len(x), row + 20_000)
        own = offsets[row : stop + 1]
        yield Texts(data[own[0] : own[-1]], own - own[0], row)
        row = stop


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all k-word windows; a row of 1 to k-1 words gives one window of all of them."""
    counts = np.bincount(rows, minlength=n_rows)
    with np.errstate(over="ignore"):
        n = len(words) - k + 1
        if n > 0:
            same = rows[:n] == rows[k - 1 :]
            windows = np.zeros(n, U64)
            for i in range(k):
                windows += words[i : i + n] * _MIX[i % 16] + U64(i)
            out, out_rows = windows[same], rows[:n][same]
        else:
            out, out_rows = np.zeros(0, U64), np.zeros(0, rows.dtype)
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            first = np.concatenate([[0], np.cumsum(counts)])
            extra = np.array([np.sum(words[first[r] : first[r + 1]] * _MIX[: counts[r]] + U64(977 * counts[r]), dtype=U64) for r in short], U64)
            out, out_rows = np.concatenate([out, extra]), np.concatenate([out_rows, short])
            order = np.argsort(out_rows, kind="stable")
            out, out_rows = out[order], out_rows[order]
    return mix(out), out_rows


def distinct_by_row(values: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row; rows must ascend."""
    edges = np.searchsorted(rows, np.arange(n_rows + 1))
    values = values.copy()
    for i in range(n_rows):
        values[edges[i] : edges[i + 1]].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[new], rows[new]
