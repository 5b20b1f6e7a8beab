"""Operators over time-stamped messages: selection, ordering, decimation, pairing, interpolation, synchronisation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanweave.operators.prefix import ordinal, running_max_before


def select_topics(messages: DataFrame, topics: list[str]) -> DataFrame:
    """Messages of the given topics; the filter reaches the scan."""
    return messages.where(F.col("topic").isin(*topics))


def explode_packs(packs: DataFrame, column: str = "messages") -> DataFrame:
    """One row per message of each pack."""
    return packs.select(*[c for c in packs.columns if c != column], F.explode(column).alias("message"))


def decimate(messages: DataFrame, every: int, order: list[str], bucket: Column, keys: list[str] = ("topic",)) -> DataFrame:
    """The first of every `every` messages of each key, counted in order."""
    return ordinal(messages, order, bucket, list(keys), "_place").where(F.col("_place") % every == 0).drop("_place")


def skip_take(messages: DataFrame, skip: int, take: int, order: list[str], bucket: Column) -> DataFrame:
    """The `take` pairs after the first `skip` pairs, where a pair is two messages in arrival order. take < 1: all."""
    placed = ordinal(messages, order, bucket, name="_place").where(F.col("_place") >= 2 * skip)
    return (placed.where(F.col("_place") < 2 * (skip + take)) if take > 0 else placed).drop("_place")


def ordinal_pair(left: DataFrame, right: DataFrame, order: list[str], bucket: Column, columns: list[str]) -> DataFrame:
    """The i-th row of left beside the i-th row of right, whatever their times; rows without a partner wait, and are left out."""
    sides = [ordinal(d, order, bucket, name="pair").select("pair", *[F.col(c).alias(f"{side}_{c}") for c in columns]) for side, d in (("left", left), ("right", right))]
    return sides[0].join(sides[1], "pair")


def drop_late(messages: DataFrame, time: str, arrival: str, oblivion: int, bucket: Column) -> DataFrame:
    """Leaves out messages older than the latest time seen before them by more than `oblivion`; equality is kept."""
    seen = running_max_before(messages, [arrival], bucket, time, name="_latest")
    return seen.where(F.col("_latest").isNull() | (F.col(time) >= F.col("_latest") - oblivion)).drop("_latest")


def late_counts(messages: DataFrame, time: str, arrival: str, oblivion: int, bucket: Column, keys: list[str] = ("topic",)) -> DataFrame:
    """(keys, n_messages, n_dropped): what drop_late leaves out, counted."""
    seen = running_max_before(messages, [arrival], bucket, time, name="_latest")
    late = F.coalesce(F.col(time) < F.col("_latest") - oblivion, F.lit(False))
    return seen.groupBy(*keys).agg(F.count("*").alias("n_messages"), F.count(F.when(late, 1)).alias("n_dropped"))


def bracket(queries: DataFrame, samples: DataFrame, time: str, value: str, keys: list[str] = (), bucket: int | float = 3_600_000_000) -> DataFrame:
    """queries with `before` and `after`: the samples (t, v) at or next to their time on both sides; null outside them.

    Both sides are cut into time buckets and united; each bucket starts from the last sample before it and ends with the
    first after it, so no task sees more than a bucket. samples has one row per key and time.
    """
    keys = list(keys)
    kind = dict(samples.dtypes)[value]
    q = queries.withColumn("_v", F.lit(None).cast(kind)).withColumn("_is_query", F.lit(True))
    s = samples.select(*keys, time, F.col(value).alias("_v")).withColumn("_is_query", F.lit(False))
    both = q.unionByName(s, allowMissingColumns=True).withColumn("_bucket", F.floor(F.col(time) / bucket))
    point = F.when(~F.col("_is_query"), F.struct(F.col(time).alias("t"), F.col("_v").alias("v")))
    edges = both.groupBy(*keys, "_bucket").agg(F.min_by(point, F.when(point.isNotNull(), F.col(time))).alias("_first"), F.max_by(point, F.when(point.isNotNull(), F.col(time))).alias("_last"))
    # what follows is read in descending order: frames that grow are cheap, frames that shrink are summed up anew
    outer, after = (Window.partitionBy(*keys, F.lit(0)).orderBy(b) for b in (F.col("_bucket"), F.col("_bucket").desc()))
    edges = edges.select(*keys, "_bucket", F.last("_last", ignorenulls=True).over(outer.rowsBetween(Window.unboundedPreceding, -1)).alias("_past"), F.last("_first", ignorenulls=True).over(after.rowsBetween(Window.unboundedPreceding, -1)).alias("_next"))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(time)
    both = both.withColumn("_point", point).join(edges, [*keys, "_bucket"])
    low = F.coalesce(F.last("_point", ignorenulls=True).over(inner.rangeBetween(Window.unboundedPreceding, 0)), "_past")
    back = Window.partitionBy(*keys, "_bucket").orderBy(F.col(time).desc()).rangeBetween(Window.unboundedPreceding, 0)
    high = F.coalesce(F.last("_point", ignorenulls=True).over(back), "_next")
    return both.withColumns({"before": low, "after": high}).where("_is_query").select(*queries.columns, "before", "after")


def as_of_interpolate(queries: DataFrame, samples: DataFrame, time: str, value: str, keys: list[str] = (), bucket: int = 3_600_000_000) -> DataFrame:
    """queries with the samples' value at their time: exact, or linear between the samples on both sides; null outside them.
    A time that samples repeat has the mean of their values."""
    keys = list(keys)
    samples = samples.groupBy(*keys, time).agg(F.avg(value).alias("_value"))
    both = bracket(queries, samples, time, "_value", keys, bucket)
    share = (F.col(time) - F.col("before.t")) / (F.col("after.t") - F.col("before.t"))
    between = F.col("before.v") + share * (F.col("after.v") - F.col("before.v"))
    found = F.when(F.col("before.t") == F.col("after.t"), F.col("before.v")).otherwise(between)
    return both.withColumn(f"{value}_at", found).select(*queries.columns, f"{value}_at")


def synchronise(messages: DataFrame, topics: list[str], interval: float, key: str = "stream") -> DataFrame:
    """Packs of one message per topic whose times differ by less than `interval`: (key, pack, t, arrivals).

    The latest message of each topic is held; when all topics are held and close enough, they leave as a pack, whose time
    is the earliest. Streams are independent and each is read in arrival order, in batches of bounded size.
    """
    names = list(topics)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, held, pack = object(), {}, 0
        for batch in batches:
            out = []
            for own, topic, t, arrival in zip(batch[key], batch["topic"], batch["t"], batch["arrival"], strict=True):
                if own != stream:
                    stream, held, pack = own, {}, 0
                if topic not in names:
                    continue
                held[topic] = (t, arrival)
                if len(held) == len(names):
                    times = [x[0] for x in held.values()]
                    if max(times) - min(times) < interval:
                        out.append((own, pack, min(times), [held[n][1] for n in names]))
                        held, pack = {}, pack + 1
            yield pd.DataFrame(out, columns=[key, "pack", "t", "arrivals"])

    kind = dict(messages.dtypes)[key]
    rows = messages.select(key, "topic", F.col("t").cast("double").alias("t"), "arrival").repartition(key).sortWithinPartitions(key, "arrival")
    return rows.mapInPandas(run, f"{key} {kind}, pack long, t double, arrivals array<long>")


def subsample_motion(poses: DataFrame, min_distance: float, min_angle: float, key: str = "stream") -> DataFrame:
    """Poses that moved on by more than min_distance or turned by more than min_angle since the last one given out.

    poses has (key, arrival, distance, angle): the steps from the row before. Sums start again at each pose given out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, far, turned = object(), 0.0, 0.0
        for batch in batches:
            keep = []
            for own, d, a in zip(batch[key], batch["distance"], batch["angle"], strict=True):
                if own != stream:
                    stream, far, turned = own, 0.0, 0.0
                far, turned = far + d, turned + a
                keep.append(far > min_distance or turned > min_angle)
                if keep[-1]:
                    far, turned = 0.0, 0.0
            yield batch[keep]

    return poses.repartition(key).sortWithinPartitions(key, "arrival").mapInPandas(run, poses.schema)


def kalman_times(messages: DataFrame, warm_up: int = 100, gate: float = 3.0, process: float = 1e-4, measurement: float = 1e-3, key: str = "stream") -> DataFrame:
    """Message times smoothed by a Kalman filter over (time, period): (key, arrival, t, t_filtered, ready).

    The first warm_up messages set the time to the last of them and the period to the mean step; they pass as they are and
    are not ready. Then the time moves on by the period, both with process noise, and is corrected by the message, unless
    that is off by more than `gate` periods. The covariance starts as the identity. Each step needs the one before, so a
    stream is read by one task, in batches; its state is five numbers.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, n, first = object(), 0, 0.0
        t = period = s00 = s01 = s11 = 0.0
        for batch in batches:
            out, ready = [], []
            for own, at in zip(batch[key], batch["t"], strict=True):
                if own != stream:
                    stream, n, first = own, 0, at
                    s00, s01, s11 = 1.0, 0.0, 1.0
                n += 1
                ready.append(n > warm_up)
                if n <= warm_up:
                    t, period = at, (at - first) / (n - 1) if n > 1 else 0.0
                else:
                    t = t + period
                    s00, s01, s11 = s00 + 2 * s01 + s11 + process, s01 + s11, s11 + process
                    step = at - t
                    if abs(step) <= gate * period:
                        k0, k1 = s00 / (s00 + measurement), s01 / (s00 + measurement)
                        t, period = t + k0 * step, period + k1 * step
                        s00, s01, s11 = (1 - k0) * s00, (1 - k0) * s01, s11 - k1 * s01
                out.append(t)
            yield batch.assign(t_filtered=out, ready=ready)

    rows = messages.select(key, "arrival", F.col("t").cast("double").alias("t")).repartition(key).sortWithinPartitions(key, "arrival")
    return rows.mapInPandas(run, f"{key} {dict(messages.dtypes)[key]}, arrival long, t double, t_filtered double, ready boolean")
