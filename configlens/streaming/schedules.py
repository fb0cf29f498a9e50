"""Schedules as a state machine over commands, in a stream with timers or over a table.

A command (name, at, seq, command, until, every_seconds, window_start, window_end)
is one of

* register: runs begin at `at`, every so many seconds, aligned to a daily window
* complete: the pending run has ended, the next one is an interval later
* skip: no run before `until`
* cancel: the schedule is gone
* snapshot: say what the state is

Times are whole seconds since 1970 in UTC. A run is due when its time has come, by
a timer or by the next command of its schedule; it is pending until completed,
skipped or cancelled, and no other is due meanwhile. Each step leaves a row (name,
at, seq, event, next_run, pending): event is registered, due, completed, skipped,
cancelled, state, or rejected for a command that doesn't fit: a second register, a
complete without a pending run, anything for a name that isn't registered, an
unknown command. A command without a time is rejected too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COMMANDS = "name string, at bigint, seq bigint, command string, until bigint, every_seconds bigint, window_start bigint, window_end bigint"
EVENTS = "name string, at bigint, seq bigint, event string, next_run bigint, pending bigint"
STATE = "next_run bigint, pending bigint, every_seconds bigint, window_start bigint, window_end bigint"
_COLUMNS = [c.split()[0] for c in COMMANDS.split(", ")]
DAY = 86400


def align(at: int, start: int | None, end: int | None) -> int:
    """The time itself inside the daily window, else the window's next start; a window may go over midnight."""
    if start is None or end is None:
        return at
    second = at % DAY
    inside = start <= second <= end if start <= end else second >= start or second <= end
    return at if inside else at - second + start + (0 if second < start else DAY)


class Schedule:
    """One schedule; state is (next_run, pending, every_seconds, window_start, window_end), or None where there is none."""

    def __init__(self, name: str, state: tuple | None = None):
        self.name, self.state = name, state

    def _row(self, at: int | None, seq: int | None, event: str) -> tuple:
        next_run, pending = self.state[:2] if self.state else (None, None)
        return self.name, at, seq, event, next_run, pending

    def due(self, now: int) -> Iterator[tuple]:
        """What has become due by now."""
        if self.state and self.state[1] is None and self.state[0] <= now:
            self.state = (self.state[0], self.state[0], *self.state[2:])
            yield self._row(self.state[0], None, "due")

    def take(self, command: tuple) -> Iterator[tuple]:
        """Rows of one command, those that were due before it first."""
        _, at, seq, kind, until, every, start, end = command
        if at is None:
            yield self._row(at, seq, "rejected")
            return
        yield from self.due(at)
        event = "rejected"
        if kind == "register":
            if self.state is None and every is not None and every > 0:
                self.state, event = (align(at, start, end), None, every, start, end), "registered"
        elif self.state is None:
            pass
        elif kind == "complete" and self.state[1] is not None:
            self.state, event = (align(at + self.state[2], *self.state[3:]), None, *self.state[2:]), "completed"
        elif kind == "skip" and until is not None:
            self.state, event = (align(until, *self.state[3:]), None, *self.state[2:]), "skipped"
        elif kind == "cancel":
            self.state, event = None, "cancelled"
        elif kind == "snapshot":
            event = "state"
        yield self._row(at, seq, event)


def _ints(frame: pd.DataFrame) -> Iterator[tuple]:
    """Rows as tuples, nulls as None and numbers as integers."""
    columns = [frame[c].astype(object).where(frame[c].notna(), None) for c in _COLUMNS]
    for name, at, seq, command, *rest in zip(*columns, strict=True):
        yield name, at if at is None else int(at), seq if seq is None else int(seq), command, *(x if x is None else int(x) for x in rest)


def _frame(rows: Iterable[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in EVENTS.split(", ")], dtype=object)
    return frame.astype({c: "Int64" for c in ("at", "seq", "next_run", "pending")})


class _Machine(StatefulProcessor):
    """The state of one schedule and a timer at its next run."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("schedule", STATE)

    def _kept(self, schedule: Schedule) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if schedule.state is None:
            self.value.clear()
        else:
            self.value.update(schedule.state)
            if schedule.state[1] is None:
                self.handle.registerTimer(schedule.state[0] * 1000)

    def _schedule(self, name: str) -> Schedule:
        return Schedule(name, tuple(self.value.get()) if self.value.exists() else None)

    def handleInputRows(self, key, rows, timerValues):
        schedule = self._schedule(key[0])
        commands = sorted((c for frame in rows for c in _ints(frame)), key=lambda c: (c[1] is None, c[1] or 0, c[2] is None, c[2] or 0))  # one schedule's of a trigger
        out = [row for command in commands for row in schedule.take(command)]
        out += schedule.due(timerValues.getCurrentWatermarkInMs() // 1000)
        self._kept(schedule)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        schedule = self._schedule(key[0])
        out = list(schedule.due(expiredTimerInfo.getExpiryTimeInMs() // 1000))
        self._kept(schedule)
        if out:
            yield _frame(out)

    def close(self) -> None:
        pass


def follow(commands: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Rows of a stream of commands; runs are due when the watermark passes their time.

    The session has to keep its state in RocksDB, as all processors with timers.
    Commands that are later than `late` are dropped by the watermark.
    """
    timed = commands.select(*_COLUMNS, F.timestamp_seconds("at").alias("_time")).withWatermark("_time", late)
    return timed.groupBy("name").transformWithStateInPandas(statefulProcessor=_Machine(), outputStructType=EVENTS, outputMode="append", timeMode="EventTime")


def replay(commands: DataFrame, until: int) -> DataFrame:
    """The same over a table of commands, with what becomes due up to `until`.

    Commands are taken in order of at and seq, those without a time last. Spark
    sorts them, and a schedule passes batch by batch with its state, so memory
    doesn't follow a schedule's history.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        schedule, begun = Schedule(""), False
        for frame in frames:
            out: list[tuple] = []
            for command in _ints(frame):
                if not begun or command[0] != schedule.name:
                    if begun:
                        out += schedule.due(until)
                    schedule, begun = Schedule(command[0]), True
                out += schedule.take(command)
            yield _frame(out)
        if begun:
            yield _frame(schedule.due(until))

    ordered = commands.select(*_COLUMNS).repartition("name").sortWithinPartitions("name", F.asc_nulls_last("at"), F.asc_nulls_last("seq"))
    return ordered.mapInPandas(run, EVENTS)
