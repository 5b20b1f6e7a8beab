"""Surfel aggregates: averages, radii, closed-form offsets, beam weights."""

from __future__ import annotations

from math import cos, pi, sin, tan

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS_FLOOR = 0.075


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def refine_offsets(observations: DataFrame, key: str = "surfel_id", order: str = "obs_id") -> DataFrame:
    """Closed-form one-parameter refinement: each surfel starts from its first observation and moves along that normal by
    the mean signed distance of all its observations. observations has (key, order, px, py, pz, nx, ny, nz)."""
    first = observations.groupBy(key).agg(F.min_by(F.struct("px", "py", "pz", "nx", "ny", "nz"), order).alias("first"))
    names = ("x", "y", "z")
    joined = observations.join(first, key)
    n = [F.col(f"first.n{c}") for c in names]
    step = dot(n, [F.col(f"p{c}") - F.col(f"first.p{c}") for c in names])
    sums = joined.groupBy(key).agg(F.count("*").alias("n_obs"), F.avg(step).alias("offset"))
    moved = sums.join(first, key)
    return moved.select(key, "n_obs", "offset", *[(F.col(f"first.p{c}") + F.col("offset") * F.col(f"first.n{c}")).alias(f"m{c}") for c in names])


def average(leaves: DataFrame, key: str = "surfel_id") -> DataFrame:
    """Unweighted mean position and normalised mean normal of each surfel's leaves (mx.., nx..)."""
    names = ("x", "y", "z")
    sums = leaves.groupBy(key).agg(F.count("*").alias("n_leaves"), *[F.avg(f"m{c}").alias(f"m{c}") for c in names], *[F.avg(f"n{c}").alias(f"_n{c}") for c in names])
    norm = F.sqrt(dot([F.col(f"_n{c}") for c in names], [F.col(f"_n{c}") for c in names]))
    return sums.select(key, "n_leaves", "mx", "my", "mz", *[F.when(norm > 0, F.col(f"_n{c}") / norm).otherwise(0.0).alias(f"n{c}") for c in names])


def max_radius(leaves: DataFrame, key: str = "surfel_id", drop_points: bool = True) -> DataFrame:
    """Largest radius sqrt(b1^2 + b2^2) / 2 over a surfel's leaves; surfels of single-point leaves only are dropped."""
    radius = F.max(F.sqrt(F.col("b1") * F.col("b1") + F.col("b2") * F.col("b2")) / 2)
    out = leaves.groupBy(key).agg(radius.alias("radius"))
    return out.where("radius > 0") if drop_points else out


def shown_radius(radius: Column) -> Column:
    """The radius written to maps, which has a floor."""
    return F.greatest(radius, F.lit(RADIUS_FLOOR))


def beams(divergence_deg: float = 0.35, side: int = 11) -> list[tuple[float, float]]:
    """Offsets (tangents) of the sub-beams inside a cone, row by row; corners outside the cone are left out."""
    half = tan(divergence_deg * pi / 360)
    steps = [(2 * i / (side - 1) - 1) * half for i in range(side)]
    return [(a, b) for a in steps for b in steps if a * a + b * b <= half * half * (1 + 1e-9)]


def beam_weight(leaves: DataFrame, divergence_deg: float = 0.35, side: int = 11, cap: float = 0.25) -> DataFrame:
    """Adds `weight`: how evenly a beam's cone meets the leaf's plane.

    leaves has (mx, my, mz) seen from the sensor and the normal (nx, ny, nz). Sub-beams around the direction of the mean
    are cut with the plane; weight = 1 - min(s, cap) / cap, with s the RMS difference of their ranges to the mean's.
    Rays along the plane are left out; without any ray the weight is 1.
    """
    m, n = ([F.col(f"{v}{c}") for c in "xyz"] for v in ("m", "n"))
    distance = F.sqrt(dot(m, m))
    d = [x / distance for x in m]
    flat = F.sqrt(d[0] * d[0] + d[1] * d[1])
    # two directions across the beam; a vertical beam takes the x and y axes
    u = [F.when(flat > 1e-9, -d[1] / flat).otherwise(1.0), F.when(flat > 1e-9, d[0] / flat).otherwise(0.0), F.lit(0.0)]
    v = [d[1] * u[2] - d[2] * u[1], d[2] * u[0] - d[0] * u[2], d[0] * u[1] - d[1] * u[0]]
    base = leaves.withColumns({"_d": distance, "_nd": dot(n, d), "_nu": dot(n, u), "_nv": dot(n, v), "_plane": dot(n, m)})
    rays = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in beams(divergence_deg, side)])
    along = lambda r: (F.col("_nd") + r["a"] * F.col("_nu") + r["b"] * F.col("_nv")) / F.sqrt(1 + r["a"] * r["a"] + r["b"] * r["b"])
    errors = F.transform(F.filter(rays, lambda r: F.abs(along(r)) >= 1e-6), lambda r: F.pow(F.col("_plane") / along(r) - F.col("_d"), F.lit(2.0)))
    total = F.aggregate(errors, F.lit(0.0), lambda s, x: s + x)
    sigma = F.when(F.size(errors) > 0, F.sqrt(total / F.size(errors))).otherwise(0.0)
    return base.withColumn("weight", 1 - F.least(sigma, F.lit(cap)) / cap).drop("_d", "_nd", "_nu", "_nv", "_plane")


def disc(radius: float, n: int = 8) -> list[tuple[float, float]]:
    """Corners of a drawn surfel disc."""
    return [(radius * cos(2 * pi * i / n), radius * sin(2 * pi * i / n)) for i in range(n)]
