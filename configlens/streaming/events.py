"""Stateful streams: progress throttling, event-time windows and arriving files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

THROTTLE_MS = 50


def throttle(progress: DataFrame, gap_ms: int = THROTTLE_MS) -> DataFrame:
    """Of a stream of progress (host_id, status, message, at_ms), what is emitted.

    A host's event is dropped if status and message are those of its last emitted
    one and less than gap_ms have passed since that. The gap is measured to the
    last emitted event, so a lag over neighbours would not do; the state is that
    event. Events of one time are taken by status and message. An event without a
    time is emitted, after the others, and none is measured against it. The same function takes a batch table, whose hosts are sorted by Spark
    and pass batch by batch, so that memory doesn't follow a host's history.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        together = pd.concat(list(frames))  # a micro-batch of one host, which its trigger bounds
        out, last = _emitted(together, last, gap_ms)
        if last:
            state.update(last)
        yield out

    schema = "host_id string, status string, message string, at_ms bigint"
    rows = progress.select("host_id", "status", "message", "at_ms")
    if progress.isStreaming:
        return rows.groupBy("host_id").applyInPandasWithState(step, schema, "status string, message string, at_ms bigint", "append", GroupStateTimeout.NoTimeout)

    def carry(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, last = None, None
        for frame in frames:
            for _, part in frame.groupby(_runs(frame["host_id"]), sort=False):
                if part["host_id"].iloc[0] != host:
                    host, last = part["host_id"].iloc[0], None
                out, last = _emitted(part, last, gap_ms)
                yield out

    ordered = rows.repartition("host_id").sortWithinPartitions("host_id", F.asc_nulls_last("at_ms"), "status", "message")
    return ordered.mapInPandas(carry, schema)


def _runs(values: pd.Series) -> pd.Series:
    """Numbers of the runs of equal values, nulls being equal."""
    before = values.shift()
    return ((values != before) & ~(values.isna() & before.isna())).cumsum()


def _emitted(frame: pd.DataFrame, last: tuple | None, gap_ms: int) -> tuple[pd.DataFrame, tuple | None]:
    keep = []
    frame = frame.astype({"at_ms": "Int64"}).sort_values(["at_ms", "status", "message"], kind="stable", na_position="last")
    for status, message, at in zip(frame["status"], frame["message"], frame["at_ms"], strict=True):
        if at is pd.NA:
            keep.append(True)
            continue
        fresh = last is None or (status, message) != tuple(last[:2]) or at - last[2] >= gap_ms
        keep.append(fresh)
        if fresh:
            last = (status, message, int(at))
    return frame[pd.Series(keep, index=frame.index, dtype=bool)], last


def tumbling(events: DataFrame, at: str, width: str, *aggregates: Column, late: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates per window of a width; in a stream, events later than `late` are dropped."""
    rows = events.withWatermark(at, late) if late else events
    return rows.groupBy(F.window(at, width), *by).agg(*aggregates).select(F.col("window.start").alias("window_start"), *by, *(c for c in _names(rows, aggregates)))


def sliding(events: DataFrame, at: str, width: str, step: str, *aggregates: Column, late: str | None = None) -> DataFrame:
    """Aggregates per overlapping window."""
    rows = events.withWatermark(at, late) if late else events
    return rows.groupBy(F.window(at, width, step)).agg(*aggregates).select(F.col("window.start").alias("window_start"), *_names(rows, aggregates))


def sessions(events: DataFrame, at: str, gap: str, by: tuple[str, ...], *aggregates: Column, late: str | None = None) -> DataFrame:
    """Aggregates per session of a key: events less than a gap apart. The window itself is grouped by, so sessions merge."""
    rows = events.withWatermark(at, late) if late else events
    grouped = rows.groupBy(F.session_window(at, gap), *by).agg(*aggregates)
    return grouped.select(*by, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *_names(rows, aggregates))


def _names(rows: DataFrame, aggregates: tuple[Column, ...]) -> list[str]:
    return rows.groupBy().agg(*aggregates).columns


def on_arrival(files: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> object:
    """Start a query that hands each micro-batch of arriving files to handle(batch, id)."""
    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
