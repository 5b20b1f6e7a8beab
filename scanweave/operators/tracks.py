"""Running products of poses: odometry steps into tracks, tracks into pose graphs.

A product of poses can't be taken in a window, and a run may be of any length. Rows are range-partitioned by (keys, order), so
a long run is cut where partitions end; a task takes the products within its own rows, then the few products of whole pieces are
multiplied up, and each piece is moved by what came before it. A run costs one shuffle, and no task sees more than a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from scanweave.functions import poses
from scanweave.operators.prefix import previous
from scanweave.sources.tables import keep


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b of poses as rows (tx, ty, tz, qx, qy, qz, qw)."""
    p, q, s, r = a[:, 3:6], a[:, 6:], b[:, 3:6], b[:, 6:]
    turn = np.cross(p, b[:, :3])
    moved = a[:, :3] + b[:, :3] + 2 * (q * turn + np.cross(p, turn))
    return np.hstack([moved, q * s + r * p + np.cross(p, s), q * r - (p * s).sum(axis=1, keepdims=True)])


def running(steps: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The product of each row with all rows before it back to the last that begins a run, by doubling."""
    out, start = steps.copy(), np.maximum.accumulate(np.where(begins, np.arange(len(steps)), 0))
    at, far = np.arange(len(steps)), 1
    while len(rows := np.flatnonzero(at - far >= start)):
        out[rows] = compose(out[rows - far], out[rows])
        far *= 2
    out[:, 3:] /= np.linalg.norm(out[:, 3:], axis=1, keepdims=True)
    return out


def _array(column: pa.Array) -> np.ndarray:
    return np.stack([column.field(i).to_numpy(zero_copy_only=False) for i in range(7)], axis=1).astype(np.float64)


def _struct(p: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(p[:, i]) for i in range(7)], names=list(poses.FIELDS))


def running_poses(steps: DataFrame, order: list[str], keys: list[str] = (), step: str = "step", name: str = "pose") -> DataFrame:
    """steps with the product of all steps of the row's keys up to its own, in order, as a struct column `name`.

    `step` is a pose struct; a null step stands still. Rows of equal order are taken in any order. Null keys are keys of their
    own. The table of pieces has at most two rows for each partition that a run crosses, so it may be broadcast.
    """
    keys = list(keys)
    names = [c for c in steps.columns if c != step]
    still = poses.struct(tuple(F.lit(v) for v in (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)))
    rows = steps.select(*names, F.coalesce(F.col(step), still).alias(step))
    rows = rows.repartitionByRange(*[F.col(k) for k in keys], *[F.col(c) for c in order]).sortWithinPartitions(*keys, *order)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, carry, n = TaskContext.get().partitionId(), object(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            at = [batch.schema.names.index(k) for k in keys]
            own = list(zip(*(batch.column(i).to_pylist() for i in at), strict=True)) if keys else [()] * batch.num_rows
            begins = np.array([True] + [a != b for a, b in zip(own, own[1:], strict=False)])
            p = running(_array(batch.column(len(names))), begins)
            if own[0] == before:
                first = len(begins) if len(more := np.flatnonzero(begins[1:])) == 0 else more[0] + 1
                p[:first] = compose(np.broadcast_to(carry, (first, 7)), p[:first])
            before, carry = own[-1], p[-1]
            count = np.arange(n, n + len(p))
            n += len(p)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], batch.column(len(names)), _struct(p), pa.array(np.full(len(p), part, np.int32)), pa.array(count)], names=[*names, step, "_local", "_part", "_n"])

    schema = StructType([*rows.schema.fields]).add("_local", rows.schema[step].dataType).add("_part", IntegerType()).add("_n", LongType())
    placed = keep(rows.mapInArrow(local, schema), "track-local")
    pieces = placed.groupBy(*keys, "_part").agg(F.max_by("_local", "_n").alias("_whole"))
    crossed = pieces.withColumn("_pieces", F.count("*").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))).where("_pieces > 1").drop("_pieces")
    schema = StructType([*pieces.select(*keys, "_part").schema.fields]).add("_before", rows.schema[step].dataType)

    def up(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_part")
        p = np.array([[w[f] for f in poses.FIELDS] for w in group["_whole"]])
        p = running(p, np.arange(len(p)) == 0)
        before = [None, *[dict(zip(poses.FIELDS, row, strict=True)) for row in p[:-1].tolist()]]
        return group[[*keys, "_part"]].assign(_before=before)

    starts = crossed.groupBy(*keys).applyInPandas(up, schema)
    starts = keep(starts, "track-starts").select(F.col("_part").alias("_of"), "_before", *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)])
    on = F.col("_part") == F.col("_of")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    both = placed.join(F.broadcast(starts), on, "left")
    moved = F.when(F.col("_before").isNull(), F.col("_local")).otherwise(poses.struct(poses.compose(poses.of(F.col("_before")), poses.of(F.col("_local")))))
    return both.select(*names, step, moved.alias(name))


def pose_graph(track: DataFrame, order: list[str], bucket: Column, ident: str, keys: list[str] = (), pose: str = "pose") -> tuple[DataFrame, DataFrame]:
    """(variables, factors) of a track: a pose variable (id, estimate, fixed: first of its keys) for each row, and a factor
    (kind, variables, step) from each row to the next with the pose of the next in the frame of the row."""
    keys = list(keys)
    rows = previous(track.select(*keys, *order, F.col(ident).alias("_id"), F.col(pose).alias("_pose")), order, bucket, ["_id", "_pose"], keys, "_past")
    rows = rows.select("*", F.col("_past_id").alias("_from"), F.col("_past_pose").alias("_from_pose"))
    variables = rows.select(F.col("_id").alias("id"), F.col("_pose").alias("estimate"), F.col("_from").isNull().alias("fixed"))
    step = poses.struct(poses.between(poses.of(F.col("_from_pose")), poses.of(F.col("_pose"))))
    factors = rows.where("_from is not null").select(F.lit("pose_pose").alias("kind"), F.array("_from", "_id").alias("variables"), step.alias("step"))
    return variables, factors
