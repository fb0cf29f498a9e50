"""Health telemetry of scenarios, transcripts and regression logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip


def evaluate(scenarios: DataFrame, max_failure_rate: float, min_runs: int, stale_before: Column | None = None) -> DataFrame:
    """scenarios (name, total_runs, passes, failures, last_status, last_updated) with failure_rate, issues and status."""
    rate = F.when(F.col("total_runs") > 0, F.col("failures") / F.col("total_runs")).otherwise(F.lit(0.0))
    issues = [
        F.when(F.col("total_runs") < min_runs, "too few runs"),
        F.when(rate > max_failure_rate, "failure rate"),
        F.when(F.lower("last_status") != "pass", "last status"),
    ]
    if stale_before is not None:
        issues.append(F.when(F.col("last_updated").isNull() | (F.col("last_updated") < stale_before), "stale"))
    found = F.filter(F.array(*issues), lambda x: x.isNotNull())
    return scenarios.withColumn("failure_rate", rate).withColumn("issues", found).withColumn("status", F.when(F.size("issues") > 0, "issue").otherwise("ok"))


def issue_summary(evaluated: DataFrame) -> DataFrame:
    """Count and sorted names of scenarios by issue."""
    return evaluated.select("name", F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("scenarios"), F.array_sort(F.collect_set("name")).alias("names"))


def missing_scenarios(required: DataFrame, observed: DataFrame) -> DataFrame:
    """Required names that weren't observed, whatever the case and blanks around them."""
    key = lambda df: df.withColumn("_key", F.lower(strip(F.col("name"))))
    return key(required).join(key(observed).select("_key"), "_key", "left_anti").drop("_key")


def transcript_sections(transcripts: DataFrame) -> DataFrame:
    """path, title, section and body of transcripts (path, text) with `# title` and `## section` lines."""
    rows = transcripts.select("path", F.posexplode(F.split("text", "\r?\n")).alias("at", "line"))
    order = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    is_section = F.col("line").rlike(r"^##\s+\S")
    rows = rows.withColumn("section", F.last(F.when(is_section, strip(F.regexp_replace("line", r"^##\s+", ""))), ignorenulls=True).over(order))
    rows = rows.withColumn("title", F.last(F.when(F.col("line").rlike(r"^#\s+\S"), strip(F.regexp_replace("line", r"^#\s+", ""))), ignorenulls=True).over(order))
    body = rows.where(F.col("section").isNotNull() & ~is_section)
    return body.groupBy("path", "title", "section").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])).alias("body"))


def missing_keywords(expectations: DataFrame, sections: DataFrame) -> DataFrame:
    """expectations (path, section, keywords) with found and the keywords that the section's body lacks."""
    rows = expectations.join(sections.select("path", "section", "body"), ["path", "section"], "left")
    missing = F.filter("keywords", lambda k: ~F.contains(F.lower(F.coalesce("body", F.lit(""))), F.lower(k)))
    return rows.select("path", "section", F.col("body").isNotNull().alias("found"), missing.alias("missing"))


def log_entries(logs: DataFrame, header: str = r"^\[(\d{4}-\d\d-\d\dT[\d:.]+Z?)\]\s*(.*)$") -> DataFrame:
    """path, entry, timestamp, header and stack of logs (path, text): a header line begins an entry, other lines follow it."""
    rows = logs.select("path", F.posexplode(F.split("text", "\r?\n")).alias("at", "line"))
    order = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.col("line").rlike(header)
    rows = rows.withColumn("entry", F.count_if(starts).over(order)).where("entry > 0")
    of = F.array_sort(F.collect_list(F.struct("at", "line")))
    grouped = rows.groupBy("path", "entry").agg(of.alias("lines"))
    first = F.element_at("lines", 1)["line"]
    return grouped.select("path", "entry", F.regexp_extract(first, header, 1).alias("timestamp"), F.regexp_extract(first, header, 2).alias("header"), F.transform(F.slice("lines", 2, F.size("lines")), lambda x: x["line"]).alias("stack"))


def usage_counters(calls: DataFrame) -> DataFrame:
    """calls, ok, errors, mean and last milliseconds of each operation of an event log (op, ok, ms, at)."""
    return calls.groupBy("op").agg(F.count("*").alias("calls"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("errors"), F.avg("ms").alias("avg_ms"), F.max_by("ms", "at").alias("last_ms"))


def compliance(checks: DataFrame) -> DataFrame:
    """package, is_compliant and the names of failed checks of (package, check, passed)."""
    return checks.groupBy("package").agg(F.every("passed").alias("is_compliant"), F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("check")))).alias("failed"))
