"""Streaming operators that end: state in lists, timers that release what is held, and late rows that are said, not lost.

The state is that of Spark's RocksDB store, a list for each key that never spans more than a window of the data's own time.
A timer runs from the last row of a key; when it fires, no more rows came for `idle` milliseconds and all that is held
leaves. So a stream gives what the batch form gives, end included, and a key that falls silent keeps no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from scanweave.streaming.operators import Sorter

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ready(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _Timed(StatefulProcessor):
    """What both processors share: one timer for each key, moved on with each of its rows."""

    def __init__(self, idle: int):
        self.idle = idle

    def again(self, timers) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle)

    def close(self) -> None:
        pass


class _Sort(_Timed):
    def __init__(self, lag: float, oblivion: float, idle: int, key: str):
        super().__init__(idle)
        self.lag, self.oblivion, self.key = lag, oblivion, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "t double, arrival long")

    def _out(self, key: tuple, rows: list[tuple[float, int, bool]]) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]] * len(rows), "t": [r[0] for r in rows], "arrival": [r[1] for r in rows], "late": [r[2] for r in rows]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sorter = Sorter(self.lag, self.oblivion, [(r[0], r[1]) for r in self.held.get()] if self.held.exists() else [])
        f = pd.concat(list(rows)).sort_values("arrival")
        out = []
        for t, arrival in zip(f["t"], f["arrival"], strict=True):
            before = sorter.dropped
            out += [(a, b, False) for a, b in sorter.push(float(t), int(arrival))]
            if sorter.dropped > before:
                out.append((float(t), int(arrival), True))
        if sorter.held:
            self.held.put(sorter.held)
        self.again(timerValues)
        yield self._out(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = [(r[0], r[1], False) for r in self.held.get()] if self.held.exists() else []
        self.held.clear()
        yield self._out(key, rows)


def sort_stream(messages: DataFrame, lag: float = 1.0, oblivion: float = 5.0, idle: int = 60_000, key: str = "stream") -> DataFrame:
    """(key, t, arrival, late): messages as the sorter releases them, and late ones, marked, as they come. Per key a list of at
    most `lag` of the data's time is held; after `idle` milliseconds without a row of the key it leaves in order."""
    _ready(messages.sparkSession)
    rows = messages.selectExpr(key, "cast(t as double) as t", "cast(arrival as long) as arrival")
    output = f"{key} {dict(messages.dtypes)[key]}, t double, arrival long, late boolean"
    return rows.groupBy(key).transformWithStateInPandas(_Sort(lag, oblivion, idle, key), output, "Append", "ProcessingTime")


#: Numbers of a pose.
_POSE = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")


def between(before: tuple, after: tuple, t: float) -> tuple:
    """The pose at t between two events (t, seven numbers): straight, and along the shorter turn."""
    a, b = np.array(before[1:]), np.array(after[1:])
    u = (t - before[0]) / (after[0] - before[0]) if after[0] > before[0] else 0.0
    q, r = a[3:], b[3:] if a[3:] @ b[3:] >= 0 else -b[3:]
    angle = np.arccos(np.clip(q @ r, -1.0, 1.0))
    mix = (1 - u) * q + u * r if angle < 1e-6 else (np.sin((1 - u) * angle) * q + np.sin(u * angle) * r) / np.sin(angle)
    return tuple(map(float, [*(a[:3] + u * (b[:3] - a[:3])), *(mix / np.linalg.norm(mix))]))


class _Transforms(_Timed):
    def __init__(self, window: float, idle: int, key: str):
        super().__init__(idle)
        self.window, self.key = window, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "t double, " + ", ".join(f"{c} double" for c in _POSE))
        self.asked = handle.getListState("asked", "query_id long, t double")

    def _answers(self, key: tuple, events: list[tuple], asked: list[tuple[int, float]], last: bool) -> tuple[list[tuple], list[tuple[int, float]]]:
        times, out, wait = [e[0] for e in events], [], []
        for q, t in asked:
            k = int(np.searchsorted(times, t))  # the first event at t or after it
            if k < len(times) and times[k] == t:
                out.append((q, t, "ok", *events[k][1:]))
            elif k == 0 and times:
                out.append((q, t, "before_first", *[None] * 7))
            elif k < len(times):
                out.append((q, t, "ok", *between(events[k - 1], events[k], t)))
            elif last:
                out.append((q, t, "after_last" if times else "no_data", *[None] * 7))
            else:
                wait.append((q, t))
        return out, wait

    def _frame(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        columns = dict(zip(["query_id", "t", "status", *_POSE], zip(*out, strict=True), strict=True)) if out else dict.fromkeys(["query_id", "t", "status", *_POSE], ())
        kinds = {"query_id": "int64", "status": object}
        return pd.DataFrame({self.key: pd.Series([key[0]] * len(out), dtype=object)} | {c: pd.Series(v, dtype=kinds.get(c, "float64")) for c, v in columns.items()})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = {e[0]: tuple(e) for e in self.events.get()} if self.events.exists() else {}
        asked = [tuple(a) for a in self.asked.get()] if self.asked.exists() else []
        f, out = pd.concat(list(rows)).sort_values("arrival"), []
        # between two events nothing is forgotten, so questions are answered run by run, as they stand in the log
        for query, t, pose in zip(f["query_id"], f["t"], f[list(_POSE)].to_numpy(), strict=True):
            if not pd.isna(query):
                asked.append((int(query), float(t)))
                continue
            found, asked = self._answers(key, sorted(events.values()), asked, False)
            out += found
            events[float(t)] = (float(t), *map(float, pose))
            newest = max(events)
            events = {k: e for k, e in events.items() if k >= newest - self.window}
        held = sorted(events.values())
        found, asked = self._answers(key, held, asked, False)
        self.events.put(held) if held else self.events.clear()
        self.asked.put(asked) if asked else self.asked.clear()
        self.again(timerValues)
        yield self._frame(key, out + found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        events = [tuple(e) for e in self.events.get()] if self.events.exists() else []
        asked = [tuple(a) for a in self.asked.get()] if self.asked.exists() else []
        self.asked.clear()
        yield self._frame(key, self._answers(key, events, asked, True)[0])


def transform_stream(log: DataFrame, window: float = 5.0, idle: int = 60_000, key: str = "child") -> DataFrame:
    """(key, query_id, t, status, pose columns): a transform listener. log has (key, arrival, t, query_id, pose columns): an event
    where query_id is null, else a question for the pose at t.

    Events older than the newest by more than `window` are forgotten, and of equal times the last stays. A question waits until an event at
    its time or after it is there, and is interpolated (`ok`); one before all events that are kept is `before_first`. What still
    waits after `idle` milliseconds without a row of the key is `after_last`, or `no_data` where no event came.
    """
    _ready(log.sparkSession)
    rows = log.selectExpr(key, "cast(arrival as long) as arrival", "cast(t as double) as t", "cast(query_id as double) as query_id", *_POSE)
    output = f"{key} {dict(log.dtypes)[key]}, query_id long, t double, status string, " + ", ".join(f"{c} double" for c in _POSE)
    return rows.groupBy(key).transformWithStateInPandas(_Transforms(window, idle, key), output, "Append", "ProcessingTime")


class _Arrivals(StatefulProcessor):
    """For one variable: factors wait for it, and go on once it has come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "there boolean")
        self.waiting = handle.getListState("waiting", "factor_id long, n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(rows))
        come = [(int(a), int(n)) for a, n in zip(f["factor_id"], f["n"], strict=True) if not pd.isna(a)]
        there = self.seen.exists()
        if not there and len(come) < len(f):
            there = True
            self.seen.update((True,))
            if self.waiting.exists():
                come += [(r[0], r[1]) for r in self.waiting.get()]
                self.waiting.clear()
        if not there:
            self.waiting.appendList(come)
            come = []
        yield pd.DataFrame({"factor_id": np.array([c[0] for c in come], np.int64), "n": np.array([c[1] for c in come], np.int32)})

    def close(self) -> None:
        pass


class _Complete(StatefulProcessor):
    """For one factor: how many of its variables have come; it leaves with the last, and keeps no state then."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(rows))
        now, n = (self.count.get()[0] if self.count.exists() else 0) + len(f), int(f["n"].iloc[0])
        if now < n:
            self.count.update((now,))
        else:
            self.count.clear()
        yield pd.DataFrame({"factor_id": np.array([key[0]] if now == n else [], np.int64), "n_variables": np.array([n] if now == n else [], np.int32)})

    def close(self) -> None:
        pass


def release_stream(log: DataFrame) -> DataFrame:
    """(factor_id, n_variables): factors as the last of their variables arrives, in whatever order the log brings them.

    log has (kind: variable or factor, id, variables): each id of a kind comes once; a variable that a factor names twice counts
    once. A factor that misses a variable stays in the state; one that has left keeps none. A factor without variables never leaves.
    """
    _ready(log.sparkSession)
    own = F.array_distinct("variables")
    asked = F.transform(own, lambda v: F.struct(v.alias("variable_id"), F.col("id").cast("long").alias("factor_id"), F.size(own).alias("n")))
    come = F.array(F.struct(F.col("id").cast("long").alias("variable_id"), F.lit(None).cast("long").alias("factor_id"), F.lit(0).alias("n")))
    each = log.select(F.explode(F.when(F.col("kind") == "variable", come).otherwise(asked)).alias("r")).select("r.*")
    met = each.groupBy("variable_id").transformWithStateInPandas(_Arrivals(), "factor_id long, n int", "Append", "None")
    return met.groupBy("factor_id").transformWithStateInPandas(_Complete(), "factor_id long, n_variables int", "Append", "None")
