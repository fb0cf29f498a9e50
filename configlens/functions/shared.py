"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='configlens-')}"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of this process', which only a local session can share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir has to name a folder that all executors of {master} share")
    return _own_folder()


class Tables:
    """Tables of one call, written so that no lineage hangs on an executor; numbered, so that none is overwritten."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def write(self, rows: DataFrame) -> DataFrame:
        """What rows are now, read from where they have been written."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)
