"""How well detectors hold when files are damaged: mutations by seed, and a score by detector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mutations, by their number.
MUTATIONS = ("flip", "drop", "repeat", "comment", "cut")


def drawn(seed: int, path: Column, trial: Column, what: str) -> Column:
    """A number from 0 to 2**32 - 1 that seed, file, trial and purpose decide."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), path.cast("string"), trial.cast("string"), F.lit(what)), 256), 1, 8), 16, 10).cast("bigint")


def mutated(files: DataFrame, trials: int, seed: int = 1, mutations: Sequence[str] = MUTATIONS) -> DataFrame:
    """files (relative_path, sample) once for each trial, with trial, mutation and the damaged sample.

    flip changes one byte, drop leaves out a tenth, repeat says a tenth twice,
    comment puts a comment line at the top, cut ends the sample at its half or
    later. Empty samples get a comment line whatever is drawn, null ones stay null.
    """
    rows = files.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))) if trials else files.withColumn("trial", F.lit(0)).limit(0)
    path, trial, sample = F.col("relative_path"), F.col("trial"), F.col("sample")
    names = F.array(*map(F.lit, mutations))
    size = F.octet_length("sample")
    kind = F.when(size == 0, "comment").otherwise(F.element_at(names, (drawn(seed, path, trial, "mutation") % len(mutations) + 1).cast("int")))
    at = (drawn(seed, path, trial, "place") % F.greatest(size, F.lit(1))).cast("int")
    rows = rows.withColumn("mutation", kind).withColumn("_at", at).withColumn("_tenth", F.greatest(F.lit(1), F.floor(size / 10)).cast("int"))
    head = lambda n: F.substring(sample, F.lit(1), n)
    tail = lambda n: F.substring(sample, n + 1, F.lit(1 << 30))
    at, tenth = F.col("_at"), F.col("_tenth")
    byte = F.conv(F.hex(F.substring(sample, at + 1, F.lit(1))), 16, 10).cast("int")
    other = F.unhex(F.lpad(F.hex((byte + 1 + drawn(seed, path, trial, "byte") % 255) % 256), 2, "0"))
    join = lambda *parts: F.concat(*parts)
    damaged = (
        F.when(F.col("mutation") == "flip", join(head(at), other, tail(at + 1)))
        .when(F.col("mutation") == "drop", join(head(at), tail(at + tenth)))
        .when(F.col("mutation") == "repeat", join(head(at + tenth), tail(at)))
        .when(F.col("mutation") == "comment", join(F.concat(F.lit("# note "), (drawn(seed, path, trial, "byte") % 10_000).cast("string"), F.lit("\n")).cast("binary"), sample))
        .otherwise(head(F.greatest(at, F.floor(size / 2).cast("int"))))
    )
    return rows.withColumn("sample", F.when(sample.isNotNull(), damaged)).drop("_at", "_tenth")


def robustness(before: DataFrame, after: DataFrame) -> DataFrame:
    """plugin, trials, kept, moved, lost and score of detectors: what became of the files that each claimed (before: relative_path, plugin, format) in all trials (after: the same with trial).

    kept files are claimed as the same format, moved ones as another, lost ones by
    none; score is the share kept. Files that nothing claimed count under
    unmatched, where being claimed is a move.
    """
    was = before.select("relative_path", F.coalesce("plugin", F.lit("unmatched")).alias("plugin"), "format")
    rows = after.select("relative_path", F.col("format").alias("now")).join(was, "relative_path")
    kept = F.col("now").eqNullSafe(F.col("format"))
    lost = ~kept & F.col("now").isNull()
    count = lambda c: F.count_if(c).alias
    found = rows.groupBy("plugin").agg(F.count("*").alias("trials"), count(kept)("kept"), count(~kept & ~lost)("moved"), count(lost)("lost"))
    return found.withColumn("score", F.round(F.col("kept") / F.col("trials"), 6))
