"""Trajectory evaluation: matching by time, per-axis errors, errors over segments, errors of a graph under a truth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanweave.functions import geometry, poses
from scanweave.operators.messages import as_of_interpolate  # noqa: F401  (part of this module's interface)


def match_nearest(estimate: DataFrame, truth: DataFrame, max_gap: int, time: str = "t", keys: list[str] = ()) -> DataFrame:
    """Each estimate row with the truth row nearest in time within max_gap; the earlier one at a tie, and of rows of one time the
    smallest. Equal estimate rows are one.

    Both sides are united in time buckets as wide as the gap. A bucket's first and last truth row are also in the bucket before
    and after, so that an estimate finds both neighbours in its own one, and no pair of rows is ever made.
    """
    keys = list(keys)
    bucket = F.floor(F.col(time) / max_gap)
    there = [c for c in truth.columns if c not in keys]
    ordered = [c for c in there if "map<" not in dict(truth.dtypes)[c]]
    own = truth.dropna(subset=[*keys, time]).groupBy(*keys, F.col(time).alias("_t")).agg(F.min_by(F.struct(*there), F.struct(*ordered)).alias("_truth"))
    own = own.withColumn("_b", F.floor(F.col("_t") / max_gap)).withColumn("_point", F.struct("_t", F.col("_truth").alias("truth")))
    ends = own.groupBy(*keys, "_b").agg(F.min_by("_point", "_t").alias("_first"), F.max_by("_point", "_t").alias("_last"))
    beside = ends.select(*keys, F.explode(F.array(F.struct((F.col("_b") - 1).alias("_b"), F.col("_first").alias("_point")), F.struct((F.col("_b") + 1).alias("_b"), F.col("_last").alias("_point")))).alias("_e")).select(*keys, "_e.*")
    points = own.select(*keys, "_b", "_point").unionByName(beside).withColumn("_t", F.col("_point._t"))
    asked = estimate.dropna(subset=[*keys, time]).distinct().withColumns({"_b": bucket, "_t": F.col(time), "_row": F.struct(*estimate.columns)}).select(*keys, "_b", "_t", "_row")
    both = asked.unionByName(points, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_b")
    upto = lambda order: F.last("_point", ignorenulls=True).over(inside.orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    near = both.withColumns({"_before": upto(F.col("_t")), "_after": upto(F.col("_t").desc())}).where("_row is not null")
    gap = lambda side: F.abs(F.col("_t") - F.col(f"{side}._t"))
    best = F.when(F.col("_after").isNull() | (gap("_before") <= gap("_after")), F.col("_before")).otherwise(F.col("_after"))
    near = near.withColumn("_best", best).where(gap("_best") <= max_gap)
    return near.select("_row.*", F.col("_best.truth").alias("truth"))


def axis_errors(pairs: DataFrame, axes: dict[str, Column], keys: list[str] = ()) -> DataFrame:
    """Count, mean, population deviation and RMSE of each axis' error."""
    out = [F.count("*").alias("n")]
    for name, e in axes.items():
        out += [F.avg(e).alias(f"mean_{name}"), F.stddev_pop(e).alias(f"std_{name}"), F.sqrt(F.avg(e * e)).alias(f"rmse_{name}")]
    return pairs.groupBy(*keys).agg(*out)


def segment_ends(path: DataFrame, lengths: list[float], every: int = 10, keys: list[str] = ("run",)) -> DataFrame:
    """(keys, first, length, last): for every `every`-th frame and each length, the first frame whose distance along the
    path exceeds the start's by more than the length. path has (keys, frame, distance) with distance never falling."""
    keys = list(keys)
    starts = path.where(F.col("frame") % every == 0).select(*keys, F.col("frame").alias("first"), F.explode(F.array(*[F.lit(float(x)) for x in lengths])).alias("length"), F.col("distance").alias("_d"))
    goals = starts.select(*keys, "first", "length", (F.col("_d") + F.col("length")).alias("distance"), F.lit(None).cast("long").alias("frame"))
    both = goals.unionByName(path.select(*keys, "frame", "distance"), allowMissingColumns=True)
    # from the far end backwards, goals stand before the frames at their own distance, so these do not count
    both = both.withColumn("_rank", F.when(F.col("frame").isNull(), 0).otherwise(1))
    behind = Window.partitionBy(*keys).orderBy(F.col("distance").desc(), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("_last", F.min("frame").over(behind))
    return found.where("frame is null and _last is not null").select(*keys, "first", "length", F.col("_last").alias("last"))


def segment_errors(path: DataFrame, lengths: list[float], every: int = 10, keys: list[str] = ("run",)) -> DataFrame:
    """(keys, first, length, last, rotation_error, translation_error): errors per metre over segments of the given lengths.

    path has (keys, frame, distance, truth, estimate), the poses as structs of poses.FIELDS and distance along the truth. The
    error of a segment is what leads from the estimated to the true step between its ends; a run is one trajectory.
    """
    keys = list(keys)
    ends = segment_ends(path.select(*keys, "frame", "distance"), lengths, every, keys)
    for end in ("first", "last"):
        ends = ends.join(path.select(*keys, F.col("frame").alias(end), F.col("truth").alias(f"_t_{end}"), F.col("estimate").alias(f"_e_{end}")), [*keys, end])
    steps = ends.withColumns({f"_{k}": poses.struct(poses.between(poses.of(F.col(f"_{k}_first")), poses.of(F.col(f"_{k}_last")))) for k in "te"})
    error = steps.withColumn("_d", poses.struct(poses.between(poses.of(F.col("_e")), poses.of(F.col("_t")))))
    d = poses.of(F.col("_d"))
    return error.select(*keys, "first", "length", "last", (poses.angle(d[3:]) / F.col("length")).alias("rotation_error"), (poses.length(d[:3]) / F.col("length")).alias("translation_error"))


def relative_errors(pairs: DataFrame, order: str, keys: list[str] = ("run",)) -> DataFrame:
    """(keys, order, dx, dy, dz, droll, dpitch, dyaw) of each consecutive pair of matched poses: the absolute errors, axis by
    axis, of the step from the later pose back to the earlier one. pairs has (keys, order, truth, estimate)."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = pairs.withColumns({"_t0": F.lag("truth").over(w), "_e0": F.lag("estimate").over(w)}).where("_t0 is not null")
    d = d.withColumns({f"_{k}": poses.struct(poses.between(poses.of(F.col(c)), poses.of(F.col(f"_{k}0")))) for k, c in (("t", "truth"), ("e", "estimate"))})
    d = d.withColumn("_d", poses.struct(poses.between(poses.of(F.col("_e")), poses.of(F.col("_t")))))
    p = poses.of(F.col("_d"))
    return d.select(*keys, order, *[F.abs(c).alias(n) for c, n in zip((*p[:3], *poses.euler(p[3:])), ("dx", "dy", "dz", "droll", "dpitch", "dyaw"), strict=True)])


def alignment(pairs: DataFrame, keys: list[str] = ("run",)) -> DataFrame:
    """(keys, align): the rigid pose that best maps estimated positions (ex, ey, ez) onto true ones (tx, ty, tz), per run.

    Means and covariances are summed on the map side in one pass; the rotation is the largest eigenvector of the quaternion
    form of the covariance, found for one row a run.
    """
    keys = list(keys)
    sums = pairs.groupBy(*keys).agg(*[F.avg(f"{s}{c}").alias(f"_{s}{c}") for s in "et" for c in "xyz"], *[F.covar_pop(f"e{a}", f"t{b}").alias(f"_c{a}{b}") for a in "xyz" for b in "xyz"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            (xx, xy, xz), (yx, yy, yz), (zx, zy, zz) = [[f[f"_c{a}{b}"].to_numpy() for b in "xyz"] for a in "xyz"]
            n = np.stack([np.stack(r, -1) for r in ([xx + yy + zz, yz - zy, zx - xz, xy - yx], [yz - zy, xx - yy - zz, xy + yx, zx + xz], [zx - xz, xy + yx, yy - xx - zz, yz + zy], [xy - yx, zx + xz, yz + zy, zz - xx - yy])], -2)
            q = np.linalg.eigh(n)[1][:, :, -1][:, [1, 2, 3, 0]]
            e, t = (f[[f"_{s}{c}" for c in "xyz"]].to_numpy() for s in "et")
            shift = t - np.einsum("nij,nj->ni", geometry.quaternion_to_matrix(q), e)
            found = [dict(zip(poses.FIELDS, map(float, row), strict=True)) for row in np.hstack([shift, q])]
            yield f[keys].assign(align=found)

    kinds = dict(sums.dtypes)
    return sums.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + f", align {poses.STRUCT}")


def absolute_errors(pairs: DataFrame, keys: list[str] = ("run",)) -> DataFrame:
    """(keys, n, rmse, mean, largest): distances of aligned estimated positions from true ones, per run."""
    both = pairs.join(alignment(pairs, keys), list(keys))
    a = poses.of(F.col("align"))
    moved = poses.rotate(a[3:], tuple(F.col(f"e{c}") for c in "xyz"))
    far = poses.length(tuple(moved[i] + a[i] - F.col(f"t{c}") for i, c in enumerate("xyz")))
    return both.withColumn("_far", far).groupBy(*keys).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("_far") * F.col("_far"))).alias("rmse"), F.avg("_far").alias("mean"), F.max("_far").alias("largest"))
