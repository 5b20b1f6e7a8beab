"""Streaming forms of the order-dependent message operators, keyed by stream, with their state in Spark's state store.

Within a micro-batch the rows of a key are taken in arrival order, so a replay with Trigger.AvailableNow gives what the
batch operators give. Late rows are judged by the data's own times, as in the batch forms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class Sorter:
    """Releases messages by time: drops what is older than the latest by more than `oblivion`, holds the rest until the
    span held exceeds `lag`. Messages later than the lag but within oblivion leave at once, out of order."""

    def __init__(self, lag: float = 1.0, oblivion: float = 5.0, held: list | None = None):
        self.lag, self.oblivion = lag, oblivion
        self.held: list[tuple[float, int]] = held or []
        self.dropped = 0

    def push(self, t: float, arrival: int) -> list[tuple[float, int]]:
        latest = self.held[-1][0] if self.held else -1.0
        if t < latest - self.oblivion:
            self.dropped += 1
            return []
        at = len(self.held)
        while at and self.held[at - 1][0] > t:
            at -= 1
        self.held.insert(at, (t, arrival))
        out = []
        while self.held[-1][0] - self.held[0][0] > self.lag:
            out.append(self.held.pop(0))
        return out

    def flush(self) -> list[tuple[float, int]]:
        out, self.held = self.held, []
        return out


def sort_batch(messages: DataFrame, lag: float = 1.0, oblivion: float = 5.0, key: str = "stream") -> DataFrame:
    """(key, place, t, arrival): what the sorter releases over a finished table, and the order in which it does."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, sorter, place = object(), Sorter(lag, oblivion), 0
        for f in frames:
            out = []

            def give(rows: list) -> None:
                nonlocal place
                for t, arrival in rows:
                    out.append((stream, place, t, arrival))  # noqa: B023  out is this batch's
                    place += 1

            for own, t, arrival in zip(f[key], f["t"], f["arrival"], strict=True):
                if own != stream:
                    give(sorter.flush())
                    stream, place = own, 0
                give(sorter.push(t, arrival))
            yield pd.DataFrame(out, columns=[key, "place", "t", "arrival"])
        yield pd.DataFrame([(stream, place + i, t, a) for i, (t, a) in enumerate(sorter.flush())], columns=[key, "place", "t", "arrival"])

    kind = dict(messages.dtypes)[key]
    rows = messages.selectExpr(key, "cast(t as double) as t", "arrival").repartition(key).sortWithinPartitions(key, "arrival")
    return rows.mapInPandas(run, f"{key} {kind}, place long, t double, arrival long")


def _stateful(df: DataFrame, key: str, output: str, state: str, run: Callable) -> DataFrame:
    return df.groupBy(key).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.NoTimeout)


def sort_stream(messages: DataFrame, lag: float = 1.0, oblivion: float = 5.0, key: str = "stream") -> DataFrame:
    """(key, t, arrival) as the sorter releases them; what is still held stays in the state."""

    def run(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, arrivals = state.get if state.exists else ([], [])
        sorter = Sorter(lag, oblivion, list(zip(times, arrivals, strict=True)))
        f = pd.concat(list(frames)).sort_values("arrival")
        out = [x for t, a in zip(f["t"], f["arrival"], strict=True) for x in sorter.push(float(t), int(a))]
        state.update(([x[0] for x in sorter.held], [x[1] for x in sorter.held]))
        yield pd.DataFrame([(own[0], t, a) for t, a in out], columns=[key, "t", "arrival"])

    kind = dict(messages.dtypes)[key]
    return _stateful(messages.select(key, "t", "arrival"), key, f"{key} {kind}, t double, arrival long", "times array<double>, arrivals array<long>", run)


def synchronise_stream(messages: DataFrame, topics: list[str], interval: float, key: str = "stream") -> DataFrame:
    """(key, pack, t, arrivals): the packs of messages.synchronise as they complete."""
    names = list(topics)

    def run(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pack, topics_held, times, arrivals = state.get if state.exists else (0, [], [], [])
        held = {n: (t, a) for n, t, a in zip(topics_held, times, arrivals, strict=True)}
        f = pd.concat(list(frames)).sort_values("arrival")
        out = []
        for topic, t, arrival in zip(f["topic"], f["t"], f["arrival"], strict=True):
            if topic not in names:
                continue
            held[topic] = float(t), int(arrival)
            both = [x[0] for x in held.values()]
            if len(held) == len(names) and max(both) - min(both) < interval:
                out.append((own[0], pack, min(both), [held[n][1] for n in names]))
                held, pack = {}, pack + 1
        state.update((pack, [*held], [x[0] for x in held.values()], [x[1] for x in held.values()]))
        yield pd.DataFrame(out, columns=[key, "pack", "t", "arrivals"])

    kind = dict(messages.dtypes)[key]
    schema = "pack long, topics array<string>, times array<double>, arrivals array<long>"
    return _stateful(messages.select(key, "topic", "t", "arrival"), key, f"{key} {kind}, pack long, t double, arrivals array<long>", schema, run)


def subsample_stream(poses: DataFrame, min_distance: float, min_angle: float, key: str = "stream") -> DataFrame:
    """(key, arrival) of the poses that messages.subsample_motion keeps."""

    def run(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        far, turned = state.get if state.exists else (0.0, 0.0)
        f = pd.concat(list(frames)).sort_values("arrival")
        out = []
        for d, a, arrival in zip(f["distance"], f["angle"], f["arrival"], strict=True):
            far, turned = far + float(d), turned + float(a)
            if far > min_distance or turned > min_angle:
                out.append((own[0], int(arrival)))
                far, turned = 0.0, 0.0
        state.update((far, turned))
        yield pd.DataFrame(out, columns=[key, "arrival"])

    kind = dict(poses.dtypes)[key]
    return _stateful(poses.select(key, "arrival", "distance", "angle"), key, f"{key} {kind}, arrival long", "far double, turned double", run)
