"""Schedules as tables: intervals, daily windows, what is due and what comes next."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def interval_seconds(text: str | int | float) -> int:
    """Seconds of `90`, `15m`, `1h30m` or `PT45M`; none or less than one is an error."""
    value = str(text).strip().lower()
    if re.fullmatch(r"\d+(\.\d+)?", value):
        total = int(float(value))
    else:
        body = value.removeprefix("p").replace("t", "")
        if not re.fullmatch(r"(\d+[smhd])+", body):
            raise ValueError(f"not an interval: {text}")
        total = sum(int(n) * _UNITS[u] for n, u in re.findall(r"(\d+)([smhd])", body))
    if total <= 0:
        raise ValueError("an interval must be positive")
    return total


def interval(text: Column) -> Column:
    """The same of a column of texts; null for what isn't an interval of at least a second."""
    value = F.lower(F.trim(text))
    body = F.regexp_replace(F.regexp_replace(value, r"\Ap", ""), "t", "")
    number = lambda unit: F.aggregate(F.regexp_extract_all(body, F.lit(rf"(\d+){unit}"), F.lit(1)), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    units = [number(unit) * seconds for unit, seconds in _UNITS.items()]
    total = F.when(value.rlike(r"\A\d+(\.\d+)?\z"), value.cast("double").cast("bigint")).when(body.rlike(r"\A(\d+[smhd])+\z"), sum(units[1:], units[0]))
    return F.when(total > 0, total)


def seconds_of_day(text: str) -> int:
    """Seconds since midnight of `HH:MM` or `HH:MM:SS`."""
    parts = [int(p) for p in text.split(":")]
    return parts[0] * 3600 + parts[1] * 60 + (parts[2] if len(parts) > 2 else 0)


def _of_day(at: Column) -> Column:
    return F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)


def in_window(at: Column, start: Column, end: Column) -> Column:
    """Whether a time lies in a daily window of seconds of day; a window that ends before it starts goes over midnight."""
    s = _of_day(at)
    return F.when(start <= end, (s >= start) & (s <= end)).otherwise((s >= start) | (s <= end))


def align(at: Column, start: Column, end: Column) -> Column:
    """The time itself inside the window, else the window's next start; without a window the time."""
    s = _of_day(at)
    later = F.date_trunc("day", at) + F.make_dt_interval(secs=start.cast("decimal(18,6)")) + F.make_dt_interval(days=F.when(s < start, 0).otherwise(1))
    return F.when(start.isNull() | in_window(at, start, end), at).otherwise(later)


def next_run(completed: Column, every_seconds: Column, start: Column, end: Column) -> Column:
    """The run after a completion."""
    return align(completed + F.make_dt_interval(secs=every_seconds.cast("decimal(18,6)")), start, end)


def due(schedules: DataFrame, now: Column) -> DataFrame:
    """Schedules whose next run has come or that are pending, by time and name; they stay pending until completed."""
    rows = schedules.where(F.col("pending") | (F.col("next_run") <= now)).withColumn("pending", F.lit(True))
    return rows.orderBy("next_run", "name")


def complete(schedules: DataFrame, completions: DataFrame) -> DataFrame:
    """Schedules after completions (name, completed_at): no longer pending, with their next run."""
    last = completions.groupBy("name").agg(F.max("completed_at").alias("completed_at"))
    rows = schedules.join(last, "name", "left")
    done = F.col("completed_at").isNotNull()
    run = F.when(done, next_run(F.col("completed_at"), F.col("every_seconds"), F.col("window_start"), F.col("window_end"))).otherwise(F.col("next_run"))
    return rows.withColumn("next_run", run).withColumn("pending", F.col("pending") & ~done).drop("completed_at")


def skip_until(schedules: DataFrame, name: str, until: Column) -> DataFrame:
    """Schedules with one that doesn't run before `until`."""
    mine = F.col("name") == name
    run = F.when(mine, align(F.greatest("next_run", until), F.col("window_start"), F.col("window_end"))).otherwise(F.col("next_run"))
    return schedules.withColumn("next_run", run).withColumn("pending", F.col("pending") & ~mine)
