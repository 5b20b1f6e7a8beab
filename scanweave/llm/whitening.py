"""Embedding whitening by exact integer scatter (operator 11).

Every vector becomes integers x. The fit list holds each distinct x once. A task subtracts a shift, the x of any one row, and
adds up the sums and cross-products of what remains without rounding: values are cut into limbs of 20 bits, so that a product
of limbs added over 2^13 rows is exact in double arithmetic, and the sums of limbs are put together as Python integers of any
size. Tasks' sums meet in two steps. From n, S and X'X the matrix n X'X - S S' follows exactly (the shift drops out); only
then it becomes floating point, is decomposed by eigh and gives components, eigenvalues and the explained share.

The driver gets a matrix of dims x dims numbers from at most MERGERS tasks, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.llm._scratch import keep, small_batches
from scanweave.llm._vectors import integers, matrix

#: Tasks that put other tasks' sums together, and with that the rows that the driver gets.
MERGERS = 16
LIMB, ROWS = 20, 1 << 13
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def exact_products(y: np.ndarray) -> np.ndarray:
    """y'y of a matrix of longs, exactly, as Python integers."""
    dims = y.shape[1]
    total = np.zeros((dims, dims), object)
    for at in range(0, len(y), ROWS):
        limbs, rest = [], y[at : at + ROWS]
        while len(limbs) == 0 or rest.any():
            low = rest & ((1 << LIMB) - 1)
            low = np.where(low >= 1 << (LIMB - 1), low - (1 << LIMB), low)  # signed, so that small negative values are one limb
            limbs.append(low.astype(np.float64))
            rest = (rest - low) >> LIMB
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


def _sums(dims: int, shift: np.ndarray):
    """One row a task: n, the sums and the upper cross-products of x - shift, as decimal text of any length."""
    upper = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            y = matrix(batch.column(0)) - shift
            n += len(y)
            s += y.astype(object).sum(axis=0) if np.abs(y).max(initial=0) > (1 << 40) else y.sum(axis=0).astype(object)
            p += exact_products(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([[str(v) for v in [n, *s, *p[upper]]]])], names=["sums"])

    return run


def _merge_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for row in batch.column(0).to_pylist():
            total = [int(v) for v in row] if total is None else [a + int(v) for a, v in zip(total, row, strict=True)]
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([[str(v) for v in total]])], names=["sums"])


def scatter(fit: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S and n X'X - S S' (Python integers) of fit (x array<long>, equally long)."""
    first = fit.first()
    if first is None:
        return 0, [], np.zeros((0, 0), object)
    shift = np.array(first["x"], np.int64)
    dims = len(shift)
    parts = fit.select("x").mapInArrow(_sums(dims, shift), "sums array<string>").repartition(MERGERS).mapInArrow(_merge_sums, "sums array<string>")
    total = None
    for row in parts.toLocalIterator():
        total = [int(v) for v in row["sums"]] if total is None else [a + int(v) for a, v in zip(total, row["sums"], strict=True)]
    n, s = total[0], np.array(total[1 : dims + 1], object)
    p = np.zeros((dims, dims), object)
    p[np.triu_indices(dims)] = total[dims + 1 :]
    p = np.triu(p, 1).T + p
    return n, [int(a + n * b) for a, b in zip(s, shift.tolist(), strict=True)], n * p - np.outer(s, s)


@dataclass(frozen=True)
class Whitening:
    """What whitens integer vectors: n and S of the fit list, unit eigenvectors as columns by falling eigenvalue, eigenvalues
    and their shares of the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n*x - S as exact integers (of any size where longs don't hold them), and x - S/n."""
        most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        kind = np.int64 if self.n * most + max(map(abs, self.sums), default=0) < 1 << 62 else object
        d = x.astype(kind) * self.n - np.array(self.sums, kind)
        return d, d.astype(np.float64) / self.n

    def apply(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.vectors / np.sqrt(self.values)


#: Eigenvalues spread more than this are polished after eigh, whose error is relative to the largest one.
SPREAD = 1e6


def _polished(m: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of the integer matrix m to high relative accuracy, from eigh's vectors q: q' m q is formed
    exactly and its small off-diagonal rest is rotated away, pair by pair."""
    whole = np.rint(q * 2.0**60).astype(np.int64).astype(object)
    b = whole.T.dot(m).dot(whole)
    b = np.array([[float(v >> 120) if abs(v) >> 180 else v / (1 << 120) for v in row] for row in b])
    for _ in range(8):
        scale = np.sqrt(np.maximum(np.abs(np.diag(b)), 1e-300))
        off = np.abs(np.triu(b / scale[:, None] / scale[None, :], 1))
        pairs = np.argwhere(off > 1e-15)
        if not len(pairs):
            break
        for i, j in pairs:
            if b[i, j]:
                t = (b[j, j] - b[i, i]) / (2 * b[i, j])
                t = (1.0 if t >= 0 else -1.0) / (abs(t) + np.hypot(1.0, t))
                c = 1 / np.hypot(1.0, t)
                turn = np.array([[c, t * c], [-t * c, c]])
                b[:, [i, j]] = b[:, [i, j]] @ turn
                b[[i, j]] = turn.T @ b[[i, j]]
                q[:, [i, j]] = q[:, [i, j]] @ turn
    order = np.argsort(-np.diag(b), kind="stable")
    return np.diag(b)[order], q[:, order]


def decompose(n: int, sums: list[int], m: np.ndarray, components: int = 16) -> Whitening:
    """From the exact scatter m = n X'X - S S': the covariance is m / n^2. Components without variance beyond rounding are
    left out, since nothing can be scaled to unit variance along them."""
    trace = int(np.trace(m)) if len(m) else 0
    if not trace:
        return Whitening(n, sums, np.zeros((len(m), 0)), np.zeros(0), np.zeros(0))
    bits = max(0, max(abs(int(v)) for v in m.ravel()).bit_length() - 900)  # else beyond what doubles hold
    e, q = np.linalg.eigh((m >> bits).astype(np.float64))
    e, q, least = e[::-1], q[:, ::-1], len(m) * np.finfo(float).eps
    if e[min(components, len(e)) - 1] * SPREAD < e[0]:
        (e, q), least = _polished(m >> bits, q.copy()), 1e-26
    e, q = e[:components], q[:, :components]
    real = e > e[0] * least
    e, q = e[real], q[:, real]
    return Whitening(n, sums, q, e / n / n * 2.0**bits, e / float(trace >> bits))


def _moments(held):
    """One row a task of at least one row: n, mean and centred cross-products of whitened vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _moment_row(_merged(_of(held.value.apply(held.value.centred(matrix(b.column(0)))[1])) for b in batches if b.num_rows))

    return run


def _of(w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = w.mean(axis=0)
    return len(w), mean, (w - mean).T @ (w - mean)


def _merged(parts) -> tuple[int, np.ndarray, np.ndarray] | None:
    total = None
    for n, mean, c in parts:
        if total is not None:
            a, base, held = total
            gap = mean - base
            n, mean, c = a + n, base + gap * (n / (a + n)), held + c + np.outer(gap, gap) * (a * n / (a + n))
        total = n, mean, c
    return total


def _moment_row(total) -> Iterator[pa.RecordBatch]:
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([total[0]]), pa.array([total[1].tolist()]), pa.array([total[2].ravel().tolist()])], names=["n", "mean", "c"])


def _unpacked(rows) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for r in rows:
        yield r["n"], np.array(r["mean"]), np.array(r["c"]).reshape(len(r["mean"]), -1)


def _merge_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _moment_row(_merged(_unpacked(r for b in batches for r in b.to_pylist())))


def identity_error(fit: DataFrame, whitening: Whitening) -> float:
    """Largest absolute entry of the covariance of whitened fit vectors minus the identity, from the whitened values themselves."""
    if not len(whitening.values):
        return 0.0
    held, schema = fit.sparkSession.sparkContext.broadcast(whitening), "n long, mean array<double>, c array<double>"
    parts = fit.select("x").mapInArrow(_moments(held), schema).repartition(MERGERS).mapInArrow(_merge_moments, schema)
    n, _, c = _merged(_unpacked(parts.toLocalIterator()))
    return float(np.abs(c / n - np.eye(len(c))).max())


def whiten(vectors: DataFrame, components: int = 16, factor: int = 64, shift: int = 1_000_000) -> DataFrame:
    """One row for each row of vectors (vec_id, embedding) and component; see _OUT.

    x = floor(factor * c) + shift. Null vectors, vectors with null or non-finite components, with one of 2^53 / factor or
    more, or of another length than the most frequent one take no part. Repeated rows: each is returned, its x is in the fit
    list once. Null vec_id: returned with null. Components along which the fit list has no variance (a constant dimension, a
    single vector) are left out, so with one distinct vector there are no rows. Equal eigenvalues: in the order of eigh, the same for all
    rows. deviation is null where it exceeds a long. Empty table: no rows. Other columns are not read, whatever their names.
    """
    rows = keep(integers(small_batches(vectors), factor, shift).select(F.col("vec_id").cast("long"), "x"), "white-rows")
    fit = keep(rows.select("x").distinct(), "white-fit")
    whitening = decompose(*scatter(fit), components)
    error = identity_error(fit, whitening)
    held = vectors.sparkSession.sparkContext.broadcast(whitening)  # dims x components numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        white = held.value
        k = len(white.values)
        for batch in batches:
            if not k or not batch.num_rows:
                continue
            exact, centred = white.centred(matrix(batch.column(1)))
            if exact.dtype == object or np.abs(exact).max() > isqrt((1 << 62) // exact.shape[1]):
                squares = [v if v < 1 << 63 else None for v in (exact.astype(object) ** 2).sum(axis=1)]
            else:
                squares = (exact**2).sum(axis=1)
            n = len(exact)
            at = pa.array(np.repeat(np.arange(n), k))
            flat = lambda v: pa.array(np.full(n * k, v))
            columns = [batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), flat(white.n), pa.array(squares, pa.int64()).take(at), pa.array(white.apply(centred).ravel()), pa.array(np.tile(white.explained, n)), flat(error)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _OUT.split(", ")])

    return rows.mapInArrow(run, _OUT)
