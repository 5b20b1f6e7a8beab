"""Registration of many pairs of clouds: correspondences are found anew in each round, by a grid join at the poses of that round.

A round moves the points by their pair's pose, takes the nearest fixed point of each within a radius that shrinks from round to
round, and fits each pair's pose to what met, from grouped sums. Poses are a table keyed by pair; the driver sees one number a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.functions import poses
from scanweave.operators import cloud
from scanweave.operators.spread import _pose_of_points
from scanweave.sources.tables import keep

XYZ = ("x", "y", "z")


def moved(points: DataFrame, at: DataFrame) -> DataFrame:
    """points (pair, point_id, x, y, z) in the frame that their pair's pose (pair, pose) leads to."""
    p = poses.of(F.col("_p"))
    turned = poses.rotate(p[3:], tuple(F.col(c) for c in XYZ))
    rows = points.join(at.select("pair", F.col("pose").alias("_p")), "pair")
    return rows.select("pair", "point_id", *[(p[i] + turned[i]).alias(c) for i, c in enumerate(XYZ)])


def register(fixed: DataFrame, moving: DataFrame, start: DataFrame, radius: float, least_radius: float | None = None, shrink: float = 0.8, rounds: int = 30, tolerance: float = 1e-9, history: list[float] | None = None) -> DataFrame:
    """(pair, pose, n, rms): the pose of each moving cloud in the frame of its fixed one, from start (pair long, pose).

    fixed and moving have (pair, point_id, x, y, z). A point whose nearest fixed point is farther than the radius has no
    correspondence in that round. Pairs of which fewer than four points meet, or only points on a line, keep their pose (n and rms
    are those of the last round; 0 and null if nothing met). Ends after `rounds`, or when the radius is at its least and no pose's shift changed by more than
    tolerance. history gets the largest shift of each round.
    """
    history, least_radius = [] if history is None else history, radius / 8 if least_radius is None else least_radius
    now = keep(start.select(F.col("pair").cast("long"), "pose"), "register-poses")
    source = moving.select("pair", F.col("point_id").alias("left_id"), *[F.col(c).alias(f"m{c}") for c in XYZ])
    target = fixed.select("pair", F.col("point_id").alias("right_id"), *[F.col(c).alias(f"f{c}") for c in XYZ])
    while True:
        near = keep(cloud.nearest(moved(moving, now), fixed, radius, ["pair"]), "register-near")
        if len(history) >= rounds:
            break
        zero, one = F.lit(0.0), F.lit(1.0)
        met = near.join(source, ["pair", "left_id"]).join(target, ["pair", "right_id"])
        met = met.select(F.col("pair").cast("long").alias("target"), F.array(*[f"m{c}" for c in XYZ]).alias("measurement"), poses.struct((*[F.col(f"f{c}") for c in XYZ], zero, zero, zero, one)).alias("point"))
        fitted = _pose_of_points(met).select(F.col("id").alias("pair"), F.col("estimate").alias("_new"))
        both = keep(now.join(fitted, "pair", "left").select("pair", F.coalesce("_new", "pose").alias("pose"), F.col("pose").alias("_old")), "register-poses")
        step = [F.abs(a - b) for a, b in zip(poses.of(F.col("pose")), poses.of(F.col("_old")), strict=True)]
        sign = [F.abs(a + b) for a, b in zip(poses.of(F.col("pose")), poses.of(F.col("_old")), strict=True)]
        far = F.greatest(*step[:3], F.least(F.greatest(*step[3:]), F.greatest(*sign[3:])))  # q and -q are one rotation
        history.append(both.agg(F.coalesce(F.max(far), F.lit(0.0))).first()[0])
        now = both.select("pair", "pose")
        if radius <= least_radius and history[-1] <= tolerance:
            near = keep(cloud.nearest(moved(moving, now), fixed, radius, ["pair"]), "register-near")
            break
        radius = max(least_radius, radius * shrink)
    found = near.groupBy("pair").agg(F.count("*").alias("n"), F.sqrt(F.avg("distance2")).alias("rms"))
    return now.join(found, "pair", "left").select("pair", "pose", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "rms")
