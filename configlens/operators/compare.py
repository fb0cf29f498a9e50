"""Comparison of two keyed tables, and ordered first or last wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compare(before: DataFrame, after: DataFrame, key: Sequence[str], value: Column) -> DataFrame:
    """key columns and status: added, removed, changed or same by value (nulls are equal)."""
    a, b = before.select(*key, value.alias("_old"), F.lit(1).alias("_a")), after.select(*key, value.alias("_new"), F.lit(1).alias("_b"))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")
    return a.join(b, list(key), "full_outer").select(*key, status.alias("status"))


def first_wins(rows: DataFrame, key: Sequence[str], *order: Column | str) -> DataFrame:
    """One row of each key, the first in order, which has to be total."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep_newest(rows: DataFrame, key: Sequence[str], at: str, keep: int, cutoff: Column, *ties: str) -> DataFrame:
    """rows with drop_reason: 'count' beyond the newest `keep` of a key, else 'age' before cutoff, else null."""
    w = Window.partitionBy(*key).orderBy(F.desc(at), *(F.desc(t) for t in ties))
    reason = F.when(F.row_number().over(w) > keep, "count").when(F.col(at) < cutoff, "age")
    return rows.withColumn("drop_reason", reason)
