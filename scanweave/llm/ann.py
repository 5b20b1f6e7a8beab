"""Approximate nearest neighbours by learned partitions (operator 6).

From a bounded sample: a neighbour graph is cut into balanced partitions, and a small classifier (one softmax layer over
the unit vector) learns which partition a vector belongs to. Every row is indexed under its most probable partition; a
query is routed to several of the most probable ones, and their rows are ranked by exact cosine in double precision.

How many partitions a query visits is set from the sample: the least number with which held-out queries find `recall` of
their true neighbours. Where vectors have no structure, that is a large part of the partitions.

Partitions grow with the square root of the rows, up to MOST_PARTS; the sample has 50 rows for each. A task ranks at most
about BLOCK_ROWS rows of a partition against about QUERY_ROWS of the queries routed to it, so that neither a full partition
nor a crowd of like queries is a hot key. With fewer than 100 fit vectors there is one partition, and the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanweave.llm._scratch import keep

#: Rows and queries of a partition that meet in one task, and the queries of one matrix product there.
BLOCK_ROWS, QUERY_ROWS, QUERY_RUN = 4096, 4096, 512
#: Partitions at most, which also bounds the sample (50 rows each) and what the driver holds of scores (about 100 MB).
MOST_PARTS = 512


def _matrix(x: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as doubles and the rows that take part: not null, of `dims` numbers (or as the first), finite, not zero."""
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    x = x.cast(pa.large_list(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)
    dims = dims or (int(sizes[sizes > 0][0]) if (sizes > 0).any() else 0)
    good = np.flatnonzero((sizes == dims) & (dims > 0))
    if not len(good):
        return np.zeros((0, dims)), good
    flat = x.take(pa.array(good)).flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)  # null components become nan
    ok = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
    return values[ok], good[ok]


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise cosines in double precision, always added up in the same order, so equal vectors give equal scores."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


@dataclass(frozen=True)
class Router:
    """weights (dims + 1, partitions) of the classifier, and how many partitions a query visits."""

    weights: np.ndarray
    probes: int

    def ranked(self, units: np.ndarray, n: int) -> np.ndarray:
        """The n most probable partitions of each row, most probable first; equal scores by number."""
        logits = units @ self.weights[:-1] + self.weights[-1]
        return np.argsort(-logits, axis=1, kind="stable")[:, :n]


def partition_graph(units: np.ndarray, neighbours: np.ndarray, parts: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Balanced labels that cut few edges: balanced spherical k-means to begin with, then rounds in which each vector asks
    for the label most of its neighbours have, granted while that partition has room."""
    n = len(units)
    room = ceil(n / parts * 1.1)
    centres = units[rng.choice(n, parts, replace=False)]
    labels = np.zeros(n, np.int64)

    def dealt(scores: np.ndarray) -> np.ndarray:
        """Each row's best label that has room; the surest rows choose first."""
        labels, free = np.full(n, -1), np.full(parts, room)
        open_rows, scores = np.arange(n), scores.copy()
        while len(open_rows):
            best = scores[open_rows].argmax(axis=1)
            order = np.lexsort((-scores[open_rows, best], best))
            rank = np.arange(len(order)) - np.searchsorted(best[order], best[order])
            got = order[rank < free[best[order]]]
            labels[open_rows[got]] = best[got]
            free -= np.bincount(best[got], minlength=parts)
            open_rows = np.delete(open_rows, got)
            scores[:, free <= 0] = -np.inf
        return labels

    for _ in range(10):
        labels = dealt(units @ centres.T)
        sums = np.zeros_like(centres)
        np.add.at(sums, labels, units)
        centres = _units(np.where(np.abs(sums).sum(axis=1, keepdims=True) > 0, sums, centres))
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (np.repeat(np.arange(n), neighbours.shape[1]), labels[neighbours].ravel()), 1.0)
        new = dealt(votes + 0.5 * (units @ centres.T))
        if (new == labels).all():
            break
        labels = new
    return labels


def _train(units: np.ndarray, labels: np.ndarray, parts: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Softmax regression by mini-batch gradient steps with momentum."""
    x = np.hstack([units, np.ones((len(units), 1))])
    w, speed = np.zeros((x.shape[1], parts)), 0.0
    for step in range(rounds):
        at = rng.integers(0, len(x), min(512, len(x)))
        logits = x[at] @ w * 1.0
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(at)), labels[at]] -= 1
        speed = 0.9 * speed - (8.0 / (1 + step / 200)) * (x[at].T @ p) / len(at)
        w = w + speed
    return w


def partitions(rows: int) -> int:
    """How many partitions an index of so many rows is given."""
    return min(MOST_PARTS, max(8, ceil(rows**0.5 / 3)))


def fit(vectors: DataFrame, sample_rows: int = 12_000, parts: int | None = None, recall: float = 0.96, k: int = 5, seed: int = 7) -> Router:
    """The router of vectors (vec_id, embedding) from about sample_rows rows, or 50 for each partition where that is more,
    chosen by a hash of vec_id. The sample, at most 50 * MOST_PARTS rows by default, reaches the driver."""
    sizes = vectors.groupBy(F.size("embedding").alias("n")).count()
    most = F.max(F.when(F.col("n") > 0, F.struct("count", "n")))["n"]  # the most frequent length, the larger one among equals
    total, dims = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), most).first()
    parts = parts or partitions(total)
    share = min(1.0, max(sample_rows, 50 * parts) / max(1, total))
    chosen = F.xxhash64("vec_id", F.lit(seed)) <= F.lit(min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63)))  # of all 64 bits
    rows = vectors.select("vec_id", "embedding").where(chosen).toArrow().sort_by("vec_id")
    values, _ = _matrix(rows["embedding"].combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.float64())), dims)
    dims = values.shape[1]
    parts = max(1, min(parts, len(values) // 50))
    if parts == 1:
        return Router(np.zeros((dims + 1, 1)), 1)
    units, rng = _units(values), np.random.default_rng(seed)
    neighbours = np.zeros((len(units), min(10, len(units) - 1)), np.int64)
    for i in range(0, len(units), 512):
        s = units[i : i + 512] @ units.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        neighbours[i : i + 512] = np.argpartition(-s, neighbours.shape[1] - 1, axis=1)[:, : neighbours.shape[1]]
    labels = partition_graph(units, neighbours, parts, 8, rng)
    hold = rng.permutation(len(units))[: min(1000, len(units) // 5)]
    train = np.setdiff1d(np.arange(len(units)), hold)
    weights = _train(units[train], labels[train], parts, 1500, rng)
    router = Router(weights, parts)
    homes = router.ranked(units, 1)[:, 0]
    order = router.ranked(units[hold], parts)
    s = units[hold] @ units.T
    s[np.arange(len(hold)), hold] = -2
    k = min(k, len(units) - 1)
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    place = (order[:, None, :] == homes[near][:, :, None]).argmax(axis=2)
    probes = next(p for p in range(1, parts + 1) if (place < p).mean() >= recall or p == parts)
    return Router(weights, probes)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, router: Router | None = None, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found among all vectors but its own vec_id, by cosine.

    vectors and queries have (vec_id, embedding). Null, zero or non-finite vectors, null ids and vectors of another length
    than the most frequent one (or the router's) take no part. Ties go to the smaller vec_id; repeated rows of an id count
    once. exact visits every partition. Other columns are not read, whatever their names. Empty tables: no rows.
    """
    router = router or fit(vectors)
    n_parts = router.weights.shape[1]
    dims = router.weights.shape[0] - 1
    held = vectors.sparkSession.sparkContext.broadcast(router)  # (dims + 1) x partitions numbers
    probes = n_parts if exact else router.probes

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, rows = _matrix(batch.column(1), dims)
            if len(rows):
                at = pa.array(rows)
                part = held.value.ranked(_units(values), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at).cast(pa.list_(pa.float64())), pa.array(part.astype(np.int32))], names=["vec_id", "embedding", "part"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, rows = _matrix(batch.column(1), dims)
            if len(rows):
                at = pa.array(rows)
                parts = held.value.ranked(_units(values), probes).astype(np.int32)
                offsets = pa.array(np.arange(0, parts.size + 1, parts.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at).cast(pa.list_(pa.float64())), pa.ListArray.from_arrays(offsets, pa.array(parts.ravel()))], names=["vec_id", "embedding", "parts"])

    def rank(key: tuple[pa.Scalar, ...], asked: pa.Table, block: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and block.num_rows:
            x, _ = _matrix(block["embedding"], dims)
            ids, unit_x = block["vec_id"].to_numpy(), _units(x)
            all_q, q_ids = _matrix(asked["embedding"], dims)[0], asked["vec_id"].to_numpy()
            unit_q = _units(all_q)
            for i in range(0, len(q_ids), QUERY_RUN):
                s = unit_q[i : i + QUERY_RUN] @ unit_x.T
                s[q_ids[i : i + QUERY_RUN, None] == ids[None, :]] = -2
                n = min(k, s.shape[1])
                least = -np.partition(-s, n - 1, axis=1)[:, n - 1] - 1e-9
                rows, at = np.nonzero((s >= least[:, None]) & (s > -1.5))
                exact_s = cosine(all_q[i + rows], x[at])
                order = np.lexsort((ids[at], -exact_s, rows))
                rows, at, exact_s = rows[order], at[order], exact_s[order]
                new = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
                found.append((q_ids[i + rows[new]], ids[at[new]], exact_s[new]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    indexed = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long"), "embedding").mapInArrow(home, "vec_id long, embedding array<double>, part int")
    indexed = keep(indexed.dropDuplicates(["vec_id"]), "ann-index")
    asked = queries.where("vec_id is not null").select(F.col("vec_id").cast("long"), "embedding").dropDuplicates(["vec_id"]).mapInArrow(route, "vec_id long, embedding array<double>, parts array<int>")
    asked = keep(asked, "ann-asked")
    cut = lambda df, n, name: df.groupBy("part").agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    blocks = cut(indexed, BLOCK_ROWS, "blocks").join(cut(asked.select(F.explode("parts").alias("part")), QUERY_ROWS, "runs"), "part")
    blocks = F.broadcast(keep(blocks, "ann-blocks"))  # one row a partition
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = indexed.join(blocks, "part").select("vec_id", "embedding", "part", block("blocks").alias("block"), every("runs").alias("run"))
    asked = asked.select("vec_id", "embedding", F.explode("parts").alias("part")).join(blocks, "part")
    asked = asked.select("vec_id", "embedding", "part", every("blocks").alias("block"), block("runs").alias("run"))
    key = ["part", "block", "run"]
    near = asked.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(rank, "query_id long, vec_id long, score double")
    # a limit on row_number also limits each task's rows before the shuffle
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
