"""Summaries of detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def detection_summary(detections: DataFrame) -> DataFrame:
    """Counts, highest confidence and distinct reasons per (format, variant), per format, and over all.

    detections has format, variant, confidence and reasons. level says what a row
    sums up: variant, format or all.
    """
    rows = detections.withColumn("reason", F.explode_outer("reasons")).withColumn("one", F.lit(1))
    per = rows.groupBy("format", "variant").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    counted = detections.rollup("format", "variant").agg(F.grouping_id().alias("g"), F.count("*").alias("detections"), F.max("confidence").alias("max_confidence"))
    level = F.when(F.col("g") == 0, "variant").when(F.col("g") == 1, "format").otherwise("all")
    counted = counted.withColumn("level", level).drop("g")
    same = counted["format"].eqNullSafe(per["format"]) & counted["variant"].eqNullSafe(per["variant"]) & (F.col("level") == "variant")
    return counted.join(per, same, "left").select("level", counted["format"], counted["variant"], "detections", "max_confidence", "reasons")


def severity_counts(detections: DataFrame) -> DataFrame:
    """Detections by catalog_severity."""
    return detections.groupBy("catalog_severity").agg(F.count("*").alias("detections"))
