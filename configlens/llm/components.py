"""Connected components of a written table of edges, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """class and component, its component's smallest class, of each node that has an edge.

    edges has columns a and b; loops and repeated edges change nothing. In a large
    star round each node's larger neighbours are linked to its smallest one, in a
    small star round the smaller ones; rounds end when the edges no longer change,
    then each node is linked with its component's smallest. A node with many
    edges is aggregated partially and joined, never gathered.
    """
    current = work.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    before = _digest(current)
    step = 0
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        made = small.union(lowest.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        previous, current = f"{name}-{step - 1}", work.write(made, f"{name}-{step}")
        after = _digest(current)
        work.drop(previous)
        if after == before:
            break
        before = after
    roots = current.select(F.col("v").alias("class")).distinct().select("class", F.col("class").alias("component"))
    return current.select(F.col("u").alias("class"), F.col("v").alias("component")).union(roots)


def _digest(edges: DataFrame) -> tuple:
    """Count and a hash sum of edges, equal for equal sets."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h
