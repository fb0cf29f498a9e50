"""JSON documents that people keep: profile stores, hunt hits, schedules, telemetry and approvals.

Each kind has a schema, a parser of a column of JSON texts and a reader of files.
What doesn't parse gives no rows; fields that are missing are null.
"""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise_tags
from ..operators.schedule import interval
from . import sqlite as tables

_CONFIG = "struct<id:string,path:string,path_glob:string,application:string,version:string,branch:string,tags:array<string>,expected_format:string,expected_variant:string,metadata:map<string,string>>"
PROFILES = f"struct<profiles:array<struct<name:string,description:string,tags:array<string>,metadata:map<string,string>,configs:array<{_CONFIG}>>>>"
HITS = "array<struct<rule:struct<name:string,token_name:string>,path:string,relative_path:string,line_number:bigint,excerpt:string>>"
SCHEDULES = "struct<schedules:array<struct<name:string,profile:string,every:string,start_at:timestamp,window:struct<start:string,`end`:string,timezone:string>,tags:array<string>,metadata:map<string,string>>>>"
TELEMETRY = "struct<generatedAt:timestamp,scenarios:array<struct<name:string,totalRuns:bigint,passes:bigint,failures:bigint,lastStatus:string,lastUpdated:timestamp,lastDetails:string>>>"
APPROVAL_FIELDS = ("token_name", "placeholder", "excerpt_hash", "source_path", "catalog_variant", "sample_hash", "approved_by", "approved_at_utc", "expires_at_utc", "secure_location", "notes")
APPROVALS = "array<struct<" + ",".join(f"{f}:string" for f in APPROVAL_FIELDS) + ">>"


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def parse_profiles(documents: DataFrame, column: str = "value") -> DataFrame:
    """name, description, tags and configs of profile stores, as operators.profiles takes them; tags are trimmed and sorted."""
    rows = documents.select(F.explode(F.from_json(column, PROFILES)["profiles"]).alias("p")).select("p.*")
    flag = lambda c: F.coalesce(c["metadata"]["ignore_review_flags"].cast("boolean"), F.lit(False))
    none = F.array().cast("array<string>")
    one = lambda c: F.struct(
        *(c[f].alias(f) for f in ("id", "path", "path_glob", "application", "version", "branch")), normalise_tags(F.coalesce(c["tags"], none)).alias("tags"), *(c[f].alias(f) for f in ("expected_format", "expected_variant")), flag(c).alias("ignore_review_flags")
    )
    return rows.select("name", "description", normalise_tags(F.coalesce("tags", none)).alias("tags"), F.transform("configs", one).alias("configs"))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profile stores of files."""
    return parse_profiles(_texts(spark, path))


def parse_hits(documents: DataFrame, column: str = "value") -> DataFrame:
    """rule, token, path, relative_path, line_number and excerpt of lists of hunt hits."""
    rows = documents.select(F.explode(F.from_json(column, HITS)).alias("h"))
    return rows.select(F.col("h.rule.name").alias("rule"), F.col("h.rule.token_name").alias("token"), "h.path", "h.relative_path", "h.line_number", "h.excerpt")


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Hunt hits of files."""
    return parse_hits(_texts(spark, path))


def parse_schedules(documents: DataFrame, column: str = "value") -> DataFrame:
    """name, profile, every_seconds, start_at and the daily window in seconds of day; an interval that isn't one is null."""
    rows = documents.select(F.explode(F.from_json(column, SCHEDULES)["schedules"]).alias("s"))
    seconds = lambda c: F.aggregate(F.transform(F.split(c, ":"), lambda x: x.cast("int")), F.lit(0), lambda a, x: a * 60 + x, lambda a: a * F.when(F.size(F.split(c, ":")) == 2, 60).otherwise(1))
    return rows.select("s.name", "s.profile", interval(F.col("s.every")).alias("every_seconds"), "s.start_at", seconds(F.col("s.window.start")).alias("window_start"), seconds(F.col("s.window.end")).alias("window_end"), F.coalesce("s.tags", F.array().cast("array<string>")).alias("tags"))


def read_schedules(spark: SparkSession, path: str) -> DataFrame:
    """Schedules of files."""
    return parse_schedules(_texts(spark, path))


def parse_telemetry(documents: DataFrame, column: str = "value") -> DataFrame:
    """generated_at and the scenarios as operators.telemetry takes them."""
    rows = documents.select(F.from_json(column, TELEMETRY).alias("t")).select(F.col("t.generatedAt").alias("generated_at"), F.explode("t.scenarios").alias("s"))
    return rows.select("generated_at", "s.name", F.col("s.totalRuns").alias("total_runs"), "s.passes", "s.failures", F.col("s.lastStatus").alias("last_status"), F.col("s.lastUpdated").alias("last_updated"), F.col("s.lastDetails").alias("last_details"))


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry of files."""
    return parse_telemetry(_texts(spark, path))


def parse_approvals(documents: DataFrame, column: str = "value") -> DataFrame:
    """Approvals of lists, with their place in the list."""
    return documents.select(F.posexplode(F.from_json(column, APPROVALS)).alias("position", "a")).select("position", "a.*")


def read_approvals(spark: SparkSession, path: str) -> DataFrame:
    """Approvals of a JSON file, or of the table token_approvals of a SQLite file."""
    if path.endswith((".db", ".sqlite", ".sqlite3")):
        return tables.read_table(spark, path, "token_approvals")
    return parse_approvals(_texts(spark, path)).drop("position")


def write_approvals(approvals: DataFrame, path: str) -> None:
    """Approvals as JSON lines, in place of what was there."""
    approvals.select(*APPROVAL_FIELDS).write.mode("overwrite").json(path)


def write_approvals_sqlite(approvals: DataFrame, path: str) -> None:
    """Approvals as the table token_approvals of a SQLite file, in place of its rows; for stores of people's size, row by row through the driver."""
    columns = ", ".join(f"{f} TEXT{' NOT NULL' if f in ('token_name', 'placeholder') else ''}" for f in APPROVAL_FIELDS)
    with sqlite3.connect(path) as c:
        c.execute(f"CREATE TABLE IF NOT EXISTS token_approvals ({columns})")
        c.execute("DELETE FROM token_approvals")
        c.executemany(f"INSERT INTO token_approvals VALUES ({', '.join('?' * len(APPROVAL_FIELDS))})", (tuple(r) for r in approvals.select(*APPROVAL_FIELDS).toLocalIterator()))
