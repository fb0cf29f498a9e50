"""Budgets on what is read: samples in order until so many bytes have been taken."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SAMPLE, MAX_SAMPLE = 128 << 10, 512 << 10
DEFAULT_BUDGET, HOST_BUDGET = 16 << 20, 64 << 20


def clamp_sample(size: int) -> int:
    """A sample size within bounds; less than 1 is an error."""
    if size < 1:
        raise ValueError("sample size must be positive")
    if size > MAX_SAMPLE:
        warnings.warn(f"sample size {size} is cut to {MAX_SAMPLE}", stacklevel=2)
    return min(size, MAX_SAMPLE)


def within_budget(files: DataFrame, order: str, length: str, sample: int = DEFAULT_SAMPLE, budget: int = DEFAULT_BUDGET, by: Sequence[str] = (), chunk_width: int = 10_000) -> DataFrame:
    """The files that a reader in `order` (a whole number, unique per group) still reads, with sample_bytes.

    Each file takes min(length, sample) bytes of its group's budget; the one that
    crosses it is cut and later ones are never read; budget_remaining and
    budget_exhausted say what it leaves. Running sums are taken inside
    chunks of order // chunk_width, then over the chunks' totals, so that no task
    sorts a whole group.
    """
    sample = clamp_sample(sample)
    rows = files.withColumn("_taken", F.least(F.col(length), F.lit(sample)).cast("bigint")).withColumn("_chunk", F.floor(F.col(order) / chunk_width))
    totals = rows.groupBy(*by, "_chunk").agg(F.sum("_taken").alias("_total"))
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).where(F.col("_start") < budget).drop("_total")
    inside = Window.partitionBy(*by, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    kept = rows.join(starts, [*by, "_chunk"]).withColumn("_before", F.col("_start") + F.coalesce(F.sum("_taken").over(inside), F.lit(0)))
    kept = kept.where(F.col("_before") < budget).withColumn("sample_bytes", F.least("_taken", F.lit(budget) - F.col("_before")))
    kept = kept.withColumn("budget_remaining", F.lit(budget) - F.col("_before") - F.col("sample_bytes"))
    return kept.withColumn("budget_exhausted", F.col("budget_remaining") <= 0).drop("_taken", "_chunk", "_start", "_before")


def exceeds(files: DataFrame, order: str, original: str, stored: str, limit: int, chunk_width: int = 10_000) -> DataFrame:
    """Files at which a package would grow beyond limit: stored sizes before them plus their original size; in chunks as above."""
    rows = files.withColumn("_chunk", F.floor(F.col(order) / chunk_width))
    totals = rows.groupBy("_chunk").agg(F.sum(stored).alias("_total"))
    starts = totals.withColumn("_start", F.coalesce(F.sum("_total").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_total")  # a row for each chunk
    before = F.sum(stored).over(Window.partitionBy("_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(starts, "_chunk").withColumn("_before", F.col("_start") + F.coalesce(before, F.lit(0)))
    return rows.where(F.col("_before") + F.col(original) > limit).drop("_chunk", "_start", "_before")
