"""Broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast; beyond that the join shuffles.
SMALL_ROWS = 10_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df, marked for broadcast if a count shows that it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
