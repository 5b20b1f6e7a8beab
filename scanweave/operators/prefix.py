"""Ordinals, running values and previous rows over one very long ordered stream.

A plain window over a whole stream, or over a handful of topics, sorts it in one task. Here the order is cut into buckets
that the caller names by an expression that never falls along the order: a small table has one row per key and bucket, its
prefix is taken in a window, and rows are ordered only within their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _within(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, "_bucket").orderBy(*order)


def _before(keys: list[str]):
    """All buckets of a key before the row's own; the table has one row per key and bucket."""
    return (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)


def _joined(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    on = F.lit(True)
    for k in [*keys, "_bucket"]:
        on = on & df[k].eqNullSafe(table[k])
    return df.join(table, on, "left").drop(*[table[k] for k in [*keys, "_bucket"]])


def ordinal(df: DataFrame, order: list[str], bucket: Column, keys: list[str] = (), name: str = "ordinal") -> DataFrame:
    """df with the 0-based place of each row in `order` among the rows of its keys."""
    keys = list(keys)
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    starts = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)).alias("_start"))
    return _joined(df, starts, keys).withColumn(name, F.row_number().over(_within(keys, order)) - 1 + F.col("_start")).drop("_bucket", "_start")


def running_max_before(df: DataFrame, order: list[str], bucket: Column, value: str, keys: list[str] = (), name: str = "latest") -> DataFrame:
    """df with the largest `value` of all earlier rows, null for the first."""
    keys = list(keys)
    df = df.withColumn("_bucket", bucket)
    tops = df.groupBy(*keys, "_bucket").agg(F.max(value).alias("_top"))
    tops = tops.select(*keys, "_bucket", F.max("_top").over(_before(keys)).alias("_past"))
    own = F.max(value).over(_within(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    return _joined(df, tops, keys).withColumn(name, F.greatest(own, "_past")).drop("_bucket", "_past")


def previous(df: DataFrame, order: list[str], bucket: Column, columns: list[str], keys: list[str] = (), prefix: str = "prev_") -> DataFrame:
    """df with the columns of the row before, null for the first."""
    keys = list(keys)
    df = df.withColumn("_bucket", bucket)
    lasts = df.groupBy(*keys, "_bucket").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))
    lasts = lasts.select(*keys, "_bucket", F.last("_last", ignorenulls=True).over(_before(keys)).alias("_past"))
    own = F.lag(F.struct(*columns)).over(_within(keys, order))
    out = _joined(df, lasts, keys).withColumn("_prev", F.coalesce(own, "_past"))
    return out.select("*", *[F.col(f"_prev.{c}").alias(f"{prefix}{c}") for c in columns]).drop("_bucket", "_past", "_prev")
