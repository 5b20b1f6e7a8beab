"""Loop closures checked against each other in the local maps that they join.

Closures that join the same two parts of a map are a cluster. Each closure of it says by which motion the second part would have to
be moved; under each such motion all closures of the cluster are checked, and each collects votes: how often it was checked
and how often it fitted. The number of checks is the square of a cluster's closures by definition; a task takes BLOCK of them
against BLOCK, and only counts leave it. Closures inside one part are checked once, where they are. Then each cluster's motion
is solved for from its accepted closures, all clusters at once: tasks add up small normal equations, Spark sums them by cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.functions import poses
from scanweave.operators.spread import _back, _times
from scanweave.operators.tracks import _array, _struct, compose
from scanweave.sources.tables import keep

#: Closures of a cluster that meet as many in one task.
BLOCK = 256
_ROUNDS = 4


def inverse(p: np.ndarray) -> np.ndarray:
    """Inverse poses, as rows."""
    q = p[:, 3:] * [-1, -1, -1, 1]
    zero, one = np.zeros((len(p), 3)), np.tile([0.0, 0.0, 0.0, 1.0], (len(p), 1))
    return np.hstack([-compose(np.hstack([zero, q]), np.hstack([p[:, :3], one]))[:, :3], q])


def residual(p: np.ndarray) -> np.ndarray:
    """Translation and twice the quaternion's vector of poses that should stand still."""
    return np.hstack([p[:, :3], 2 * p[:, 3:6] * np.where(p[:, 6:] < 0, -1, 1)])


def _matrix(column) -> np.ndarray:
    return np.array([[p[f] for f in poses.FIELDS] for p in column]).reshape(-1, 7)


def clustered(variables: DataFrame, closures: DataFrame, parts: DataFrame) -> DataFrame:
    """closures (closure_id, a, b, step) with their parts p <= q and poses seen from there: `left` (the way from b's place back
    to a closure that fits), `right` (the pose in q) and `motion` of q that the closure asks for. Ends without part or pose are left out."""
    side = lambda s: variables.select(F.col("id").alias(s), F.col("pose").alias(f"{s}_pose")).join(parts.select(F.col("variable_id").alias(s), F.col("part").alias(f"{s}_part")), s)
    rows = closures.join(side("a"), "a").join(side("b"), "b")
    turned = F.col("a_part") > F.col("b_part")
    pick = lambda x, y: F.when(turned, F.col(x)).otherwise(F.col(y))
    rows = rows.select("closure_id", pick("b_part", "a_part").alias("p"), pick("a_part", "b_part").alias("q"), pick("b_pose", "a_pose").alias("from"), pick("a_pose", "b_pose").alias("right"), F.when(turned, _back(F.col("step"))).otherwise(F.col("step")).alias("z"))
    rows = rows.withColumn("goal", _times(F.col("from"), F.col("z")))
    return rows.select("closure_id", "p", "q", "right", _back(F.col("goal")).alias("left"), _times(F.col("goal"), _back(F.col("right"))).alias("motion"))


def votes(rows: DataFrame, inlier_chi: float = 0.05) -> DataFrame:
    """(closure_id, n_checks, n_good) of clustered closures."""
    sizes = rows.groupBy("p", "q").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    rows = rows.join(sizes, ["p", "q"])
    own = F.pmod(F.xxhash64("closure_id"), F.col("n")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    motions = rows.select(F.col("p").alias("of_p"), F.col("q").alias("of_q"), "motion", own.alias("of_i"), every.alias("of_j"))
    checked = rows.select("p", "q", "closure_id", "left", "right", own.alias("j"), every.alias("i"))

    def check(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"closure_id": [], "n_checks": [], "n_good": []})
        motion, left, right = _matrix(a["motion"]), _matrix(b["left"]), _matrix(b["right"])
        good = np.zeros(len(b), np.int64)
        inside = b["p"].iloc[0] == b["q"].iloc[0]  # nothing moves there, and one check is all
        for m in [np.array([0.0, 0, 0, 0, 0, 0, 1])] if inside else motion:
            e = residual(compose(left, compose(np.broadcast_to(m, right.shape), right)))
            good += (e * e).sum(axis=1) < inlier_chi
        return pd.DataFrame({"closure_id": b["closure_id"], "n_checks": len(motion), "n_good": good})

    met = motions.groupBy("of_p", "of_q", "of_i", "of_j").cogroup(checked.groupBy("p", "q", "i", "j")).applyInPandas(check, "closure_id long, n_checks long, n_good long")
    return met.groupBy("closure_id").agg(F.sum("n_checks").alias("n_checks"), F.sum("n_good").alias("n_good"))


def solved(rows: DataFrame) -> DataFrame:
    """(p, q, motion, chi, n): of each cluster the motion of its second part that fits these closures best (rows have left, right and
    motion), from the motion that the closure of the smallest id asks for; chi is the sum over closures."""
    rows = keep(rows.where("p != q").select("p", "q", "closure_id", "left", "right", "motion"), "closures-fit")
    now = rows.groupBy("p", "q").agg(F.min_by("motion", "closure_id").alias("motion"))

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, m = (_array(batch.column(i)) for i in (2, 3, 4))
            e = residual(compose(left, compose(m, right)))
            jac = np.zeros((len(e), 6, 6))
            for k in range(6):
                step = []
                for sign in (1e-6, -1e-6):
                    d = np.zeros((len(e), 7))
                    d[:, k], d[:, 6] = sign, 1.0
                    d[:, 3:] /= np.linalg.norm(d[:, 3:], axis=1, keepdims=True)
                    step.append(residual(compose(left, compose(compose(d, m), right))))
                jac[:, :, k] = (step[0] - step[1]) / 2e-6
            h, b = np.einsum("nik,nil->nkl", jac, jac), -np.einsum("nik,ni->nk", jac, e)
            columns = [h[:, i, j] for i in range(6) for j in range(i, 6)] + list(b.T) + [(e * e).sum(axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns)], names=["p", "q", *_SUMS])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _array(batch.column(2))
            s = np.stack([c.to_numpy() for c in batch.columns[3:]], axis=1)
            h = np.zeros((len(m), 6, 6))
            upper = np.triu_indices(6)
            h[:, upper[0], upper[1]] = h[:, upper[1], upper[0]] = s[:, :21]
            x = np.linalg.solve(h + 1e-9 * np.eye(6), s[:, 21:27, None])[:, :, 0]
            d = np.hstack([x, np.ones((len(x), 1))])
            d[:, 3:] /= np.linalg.norm(d[:, 3:], axis=1, keepdims=True)
            moved = compose(d, m)
            moved[:, 3:] /= np.linalg.norm(moved[:, 3:], axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _struct(moved)], names=["p", "q", "motion"])

    kinds = {c: t for c, t in rows.dtypes}
    sums = f"p {kinds['p']}, q {kinds['q']}, " + ", ".join(f"{c} double" for c in _SUMS)
    gathered = lambda: rows.drop("motion", "closure_id").join(now, ["p", "q"]).mapInArrow(share, sums).groupBy("p", "q").agg(*[F.sum(c).alias(c) for c in _SUMS], F.count("*").alias("n"))
    for _ in range(_ROUNDS):
        now = keep(now.join(gathered().drop("n", "chi"), ["p", "q"]).select("p", "q", "motion", *_SUMS[:-1]).mapInArrow(step, f"p {kinds['p']}, q {kinds['q']}, motion {poses.STRUCT}"), "closures-motion")
    return now.join(gathered().select("p", "q", "chi", "n"), ["p", "q"])


_SUMS = [f"h{i}{j}" for i in range(6) for j in range(i, 6)] + [f"b{i}" for i in range(6)] + ["chi"]


def validate(variables: DataFrame, closures: DataFrame, parts: DataFrame, inlier_chi: float = 0.05, min_checks: int = 5, accept: float = 0.5, reject: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(statuses, motions). variables (id, pose), closures (closure_id, a, b, step: the pose of b in the frame of a), parts
    (variable_id, part), as visits.closure_partitions gives them.

    statuses: closure_id, p, q, n_checks, n_good, status. After min_checks checks a closure is accepted where more than `accept` of
    them fitted and rejected where fewer than `reject` did, else open; inside one part one check decides. Closures of which
    an end has no part are open, with no checks. motions: see `solved`, from the accepted closures.
    """
    rows = keep(clustered(variables, closures, parts), "closures")
    share, inside = F.col("n_good") / F.col("n_checks"), F.col("p") == F.col("q")
    enough = F.col("n_checks") >= min_checks
    status = F.when(inside & (F.col("n_good") == F.col("n_checks")), "accepted").when(inside, "rejected").when(enough & (share > accept), "accepted").when(enough & (share < reject), "rejected").otherwise("open")
    counted = rows.select("closure_id", "p", "q").join(votes(rows, inlier_chi), "closure_id").withColumn("n_good", F.when(inside, (F.col("n_good") > 0).cast("long")).otherwise(F.col("n_good"))).withColumn("n_checks", F.when(inside, F.lit(1).cast("long")).otherwise(F.col("n_checks")))
    counted = keep(counted.withColumn("status", status), "closures-votes")
    statuses = closures.select("closure_id").join(counted, "closure_id", "left").withColumns({"status": F.coalesce("status", F.lit("open")), "n_checks": F.coalesce("n_checks", F.lit(0).cast("long")), "n_good": F.coalesce("n_good", F.lit(0).cast("long"))})
    good = rows.join(counted.where("status = 'accepted'").select("closure_id"), "closure_id", "left_semi")
    return statuses, solved(good)
