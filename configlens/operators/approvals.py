"""Approvals of token candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("token", "placeholder", "excerpt_hash")


def _same(a: DataFrame, b: DataFrame):
    condition = F.lit(True)
    for c in KEY:
        condition = condition & a[c].eqNullSafe(b[c])
    return condition


def approved(candidates: DataFrame, approvals: DataFrame) -> DataFrame:
    """Candidates with an approval of equal key; nulls are equal to nulls."""
    return candidates.join(approvals, _same(candidates, approvals), "left_semi")


def pending(candidates: DataFrame, approvals: DataFrame) -> DataFrame:
    """Candidates without one."""
    return candidates.join(approvals, _same(candidates, approvals), "left_anti")


def with_approval(candidates: DataFrame, approvals: DataFrame) -> DataFrame:
    """All candidates with what the approval of equal key says, null where there is none."""
    return candidates.join(approvals, _same(candidates, approvals), "left").drop(*(approvals[c] for c in KEY))


def upsert(store: DataFrame, new: DataFrame, order: str = "position") -> DataFrame:
    """The store after new approvals: of each key the last by (new after old, order)."""
    rows = store.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(*KEY).orderBy(F.desc("_new"), F.desc(order))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new")
