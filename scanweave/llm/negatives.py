"""Hard-negative mining by product quantisation with stored residual norms (operator 12).

Vectors become integers. Each pair of dimensions has a codebook of at most 256 centroids, fit on a bounded sample; a row keeps
its codes and the norm of what the centroids leave of it. An anchor's table of products with all centroids gives a score s of
a row by lookups, and by Cauchy and Schwarz the true inner product is within |anchor| * residual of s. So rows that can't be
among an anchor's positives, or can't be in a window or among its first, are put aside rigorously, and exact integer products
are taken of the others only. Nothing is approximate in the result.

Anchors meet all rows in blocks: BLOCK_ROWS rows and ANCHOR_ROWS anchors in one task, once for positives and once for the
windows that these define. Only a few rows for each anchor and block leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanweave.llm._scratch import keep
from scanweave.llm._vectors import integers, matrix

#: Rows and anchors that meet in one task, anchors of one lookup there, and pairs of one exact product.
BLOCK_ROWS, ANCHOR_ROWS, ANCHOR_RUN, EXACT_PAIRS = 2048, 2048, 128, 50_000
#: Dimensions of one codebook, and its centroids at most.
SUB, CENTROIDS = 2, 256
#: What 32-bit lookups may be off, as a share of |anchor| * |decoded row|: 1,000 sums of 2^-24 and more.
SLACK = 1e-4


def train(x: np.ndarray, rounds: int = 8, seed: int = 7) -> list[np.ndarray]:
    """A codebook for each SUB dimensions of the sample x, by k-means; with few distinct values it holds these themselves."""
    rng, books = np.random.default_rng(seed), []
    for at in range(0, x.shape[1], SUB):
        own, counts = np.unique(x[:, at : at + SUB].astype(np.float64), axis=0, return_counts=True)
        centres = own
        if len(own) > CENTROIDS:
            centres = own[rng.choice(len(own), CENTROIDS, replace=False, p=counts / counts.sum())]
            for _ in range(rounds):
                near = _nearest(own, centres)
                weight = np.bincount(near, counts, len(centres))
                sums = np.stack([np.bincount(near, counts * own[:, d], len(centres)) for d in range(own.shape[1])], axis=1)
                centres = np.where(weight[:, None] > 0, sums / np.maximum(weight, 1)[:, None], centres)
        books.append(centres)
    return books


def _nearest(own: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.zeros(len(own), np.int64)
    for i in range(0, len(own), 4096):
        gaps = own[i : i + 4096, None, :] - centres[None, :, :]
        out[i : i + 4096] = (gaps * gaps).sum(axis=2).argmin(axis=1)
    return out


def encode(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, books) as bytes, and each row's residual norm with the slack of its lookups, rounded up."""
    codes, left, decoded = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x)), np.zeros(len(x))
    for i, book in enumerate(books):
        own = x[:, i * SUB : i * SUB + book.shape[1]].astype(np.float64)
        codes[:, i] = _nearest(own, book)
        held = book[codes[:, i]]
        left += ((own - held) ** 2).sum(axis=1)
        decoded += (held**2).sum(axis=1)
    return codes, (np.sqrt(left) + SLACK * np.sqrt(decoded)) * (1 + 1e-6) + 1e-9


def lookups(anchors: np.ndarray, books: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
    """(anchors, rows) of scores by table."""
    out = np.zeros((len(anchors), len(codes)), np.float32)
    for i, book in enumerate(books):
        table = (anchors[:, i * SUB : i * SUB + book.shape[1]].astype(np.float64) @ book.T).astype(np.float32)
        out += np.take(table, codes[:, i], axis=1)
    return out


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, or minus infinity where there are fewer values."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf, np.float32)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def _exact(a: np.ndarray, x: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.int64)
    for i in range(0, len(rows), EXACT_PAIRS):
        out[i : i + EXACT_PAIRS] = np.einsum("ij,ij->i", a[rows[i : i + EXACT_PAIRS]], x[at[i : i + EXACT_PAIRS]])
    return out


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each row, by falling score and then by id."""
    order = np.lexsort((ids, -scores, rows))
    own = rows[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def _bounds(a: np.ndarray, held, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Below and above what each exact score can be; norms are rounded up."""
    s = lookups(a, held.value, codes)
    norm = np.sqrt((a.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-6)
    reach = (norm[:, None] * left[None, :] * (1 + 1e-6) + 1e-3).astype(np.float32)
    return s - reach, s + reach


def _block(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(block["codes"].to_pylist()), np.uint8).reshape(block.num_rows, -1)
    return matrix(block["x"]), codes, block["residual"].to_numpy(), block["vec_id"].to_numpy(), block["label"].to_numpy()


def _positives(held, k: int):
    def run(key: tuple[pa.Scalar, ...], asked: pa.Table, block: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and block.num_rows:
            x, codes, left, ids, labels = _block(block)
            a, a_ids, a_labels = matrix(asked["x"]), asked["vec_id"].to_numpy(), asked["label"].to_numpy()
            for i in range(0, len(a), ANCHOR_RUN):
                own = slice(i, i + ANCHOR_RUN)
                low, high = _bounds(a[own], held, codes, left)
                same = (a_labels[own, None] == labels[None, :]) & (a_ids[own, None] != ids[None, :])
                least = _kth(np.where(same, low, -np.inf), k)
                rows, at = np.nonzero(same & (high >= least[:, None]))
                scores = _exact(a[own], x, rows, at)
                first = _best(rows, ids[at], scores, k)
                found.append((a_ids[own][rows[first]], ids[at[first]], scores[first]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c) for c in columns], names=["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(held, k: int, least_percent: int, most_percent: int):
    def share(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
        """percent / 100 of scores, rounded up or down, without leaving the longs."""
        whole, rest = np.divmod(score, 100)
        return whole * percent + (-(-rest * percent // 100) if up else rest * percent // 100)

    def run(key: tuple[pa.Scalar, ...], asked: pa.Table, block: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and block.num_rows:
            x, codes, left, ids, labels = _block(block)
            a, a_ids, a_labels = matrix(asked["x"]), asked["vec_id"].to_numpy(), asked["label"].to_numpy()
            wanted = asked["scores"].to_pylist()
            most = max(map(len, wanted))
            scores = np.array([w + w[:1] * (most - len(w)) for w in wanted], np.int64)  # repeats find the same rows twice, and go below
            for i in range(0, len(a), ANCHOR_RUN):
                own = slice(i, i + ANCHOR_RUN)
                low, high = _bounds(a[own], held, codes, left)
                other = a_labels[own, None] != labels[None, :]
                lo, hi = share(scores[own], least_percent, True), share(scores[own], most_percent, False)
                near = np.zeros(low.shape, bool)
                for w in range(most):
                    # a float bound a little outside the window, for the rounding of large integers
                    f_lo, f_hi = ((v[:, w, None] * (1 - d * np.sign(v[:, w, None]) * 1e-6)).astype(np.float32) for v, d in ((lo, 1), (hi, -1)))
                    sure_lo, sure_hi = ((v[:, w, None] * (1 + d * np.sign(v[:, w, None]) * 1e-6)).astype(np.float32) for v, d in ((lo, 1), (hi, -1)))
                    least = np.maximum(_kth(np.where(other & (low >= sure_lo) & (high <= sure_hi), low, -np.inf), k)[:, None], f_lo)
                    near |= other & (low <= f_hi) & (high >= least)
                rows, at = np.nonzero(near)
                exact = _exact(a[own], x, rows, at)
                for w in range(most):
                    inside = np.flatnonzero((exact >= lo[rows, w]) & (exact <= hi[rows, w]))
                    first = inside[_best(rows[inside], ids[at[inside]], exact[inside], k)]
                    found.append((a_ids[own][rows[first]], scores[own][rows[first], w], ids[at[first]], exact[first]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(c) for c in columns], names=["anchor_id", "positive_score", "negative_id", "negative_score"])

    return run


def hard_negatives(vectors: DataFrame, anchors: str = "vec_id % 50 = 0", positives: int = 5, negatives: int = 3, least_percent: int = 50, most_percent: int = 95, factor: int = 256, sample_rows: int = 4096) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors (vec_id, embedding, label).

    Anchors are the rows for which the SQL condition on vec_id and label holds. An anchor's positives are the first
    `positives` other rows of its label; for each, the first `negatives` rows of other labels whose score is between the two
    percentages of the positive's score are returned, ranked from 1. Scores are inner products of floor(factor * c).

    sample_rows bounds the rows, chosen by a hash of vec_id, that codebooks are fit on; they reach the driver. Codebooks
    only set how many exact products are taken, never the result. Null vec_id, label or vector, null or non-finite
    components, other lengths than the most frequent one, and vectors of 2^62 or more in their squared norm of integers (whose scores may
    exceed a long) take no part. Rows that repeat a vec_id count once, with the smallest label and then the smallest vector.
    Ties: the smaller vec_id. Zero vectors score 0. No positive: no rows. Empty table: no rows. Other columns are not read,
    whatever their names.
    """
    spark = vectors.sparkSession
    rows = integers(vectors.where("vec_id is not null and label is not null"), factor).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "x")
    rows = rows.where(F.expr(f"aggregate(x, 0D, (s, v) -> s + cast(v as double) * v) < {float(1 << 62)!r}D"))
    twice = keep(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"), "negatives-twice")
    if twice.limit(1).count():
        again = rows.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("v")).select("vec_id", "v.label", "v.x")
        rows = rows.join(twice, "vec_id", "left_anti").unionByName(again)
    rows = keep(rows, "negatives-rows")
    total = rows.count()
    share = min((1 << 63) - 1, int(min(1.0, sample_rows / max(1, total)) * 2.0**64) - (1 << 63))
    sample = rows.where(F.xxhash64("vec_id", F.lit(7)) <= share).select("vec_id", "x").toArrow().sort_by("vec_id")
    held = spark.sparkContext.broadcast(train(matrix(sample["x"])) if sample.num_rows else [])  # dims x 256 numbers

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, left = encode(matrix(batch.column(2)), held.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left)], names=["vec_id", "label", "x", "codes", "residual"])

    if sample.num_rows == 0:  # nothing to fit on: as if each row's residual were the row
        held = spark.sparkContext.broadcast([np.zeros((1, SUB))] * (len(first["x"]) // SUB) + [np.zeros((1, 1))] * (len(first["x"]) % SUB) if (first := rows.first()) else [])
    kind = "vec_id long, label long, x array<long>, codes binary, residual double"
    index = keep(rows.mapInArrow(coded, kind), "negatives-index")
    asked = keep(index.where(anchors).select("vec_id", "label", "x"), "negatives-anchors")
    blocks, runs = max(1, -(-total // BLOCK_ROWS)), max(1, -(-asked.count() // ANCHOR_ROWS))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = index.select("*", block(blocks).alias("block"), every(runs).alias("run"))

    def meet(own: DataFrame, f, schema: str) -> DataFrame:
        own = own.select("*", every(blocks).alias("block"), block(runs).alias("run"))
        return own.groupBy("block", "run").cogroup(dealt.groupBy("block", "run")).applyInArrow(f, schema)

    near = meet(asked, _positives(held, positives), "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = keep(near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives).drop("rank"), "negatives-positives")
    windows = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("positive_score").alias("scores"))  # `positives` at most
    far = meet(asked.join(windows, "vec_id"), _negatives(held, negatives, least_percent, most_percent), "anchor_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    far = far.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return near.join(far, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def negatives_sql(anchors: str = "vec_id % 50 = 0") -> str:
    """The same in SQL, by comparing every anchor with every row (integers below 2^53)."""
    return f"""
with raw as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [cast(c as double) for c in embedding] as e
  from embeddings where label is not null and embedding is not null),
fit as (select vec_id, label, [floor(256 * c) for c in e] as x from raw where len([c for c in e if c is null or not isfinite(c)]) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, cast(list_dot_product(a.x, b.x) as bigint) as score
  from fit a join fit b on a.vec_id <> b.vec_id where a.{anchors}),
positives as (select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, other_id) as integer) as rank,
  other_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3"""
