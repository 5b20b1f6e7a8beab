"""Seeded noise and overwrites for factor tables, drawn from hashes of ids, so that a task that runs again draws the same."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(*keys: Column | str, seed: int = 0) -> Column:
    """In (0, 1), from the keys and the seed."""
    return (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def gaussian(*keys: Column | str, seed: int = 0) -> Column:
    """Standard normal, by Box and Muller."""
    return F.sqrt(-2 * F.log(uniform(*keys, seed=2 * seed))) * F.cos(2 * pi * uniform(*keys, seed=2 * seed + 1))


def disturb_measurements(factors: DataFrame, sigma: float, kinds: list[str], seed: int = 0) -> DataFrame:
    """Adds noise to each number of the measurements of some factor types; for measurements that are plain vectors."""
    noisy = F.transform("measurement", lambda x, i: x + sigma * gaussian(F.col("factor_id"), i, seed=seed))
    return factors.withColumn("measurement", F.when(F.col("type").isin(*kinds), noisy).otherwise(F.col("measurement")))


def overwrite_information(factors: DataFrame, diagonals: dict[str, list[float]]) -> DataFrame:
    """Sets the information of some factor types to a diagonal, as an upper triangle by rows."""
    out = F.col("information")
    for kind, d in diagonals.items():
        upper = [float(d[i]) if i == j else 0.0 for i in range(len(d)) for j in range(i, len(d))]
        out = F.when(F.col("type") == kind, F.array(*[F.lit(x) for x in upper])).otherwise(out)
    return factors.withColumn("information", out)


def disturb_points(points: DataFrame, sigma: float, seed: int = 0, columns: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Gaussian noise on each coordinate, by scan and point."""
    return points.withColumns({c: F.col(c) + sigma * gaussian("scan_id", "point_id", seed=seed + k) for k, c in enumerate(columns)})


def weighted_sample(rows: DataFrame, weight: str, n: int, keys: list[str], seed: int = 0) -> DataFrame:
    """n rows without replacement, drawn with chances in proportion to weight: the n largest of log(u) / weight.

    The top n are taken by a sort with a limit, which each partition makes small before it is merged.
    """
    return rows.where(F.col(weight) > 0).orderBy((F.log(uniform(*keys, seed=seed)) / F.col(weight)).desc()).limit(n)


def exact_sum(column: str, digits: int = 12) -> Column:
    """A sum that does not depend on the order of addition: in decimals, for magnitudes below 10^(26 - digits)."""
    return F.sum(F.col(column).cast(f"decimal(28,{digits})")).cast("double")
