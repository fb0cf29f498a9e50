"""Configurations across hosts: baseline, drift, coverage, severity and each host's status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import small
from ..functions.text import slug, strip

XML_FORMATS = ("structured-config-xml", "xml")


def baseline_host(plans: DataFrame) -> DataFrame:
    """The one plan that others are compared with: preferred, then highest priority, then first in the list."""
    return plans.orderBy(F.desc("is_preferred"), F.desc("priority"), "plan_order").limit(1)


#: Fields of metadata that name a configuration, in the order in which they are asked.
IDENTITY = ("config_original_filename", "config_role", "msbuild_kind", "top_level_type")


def config_id() -> Column:
    """Identity of a configuration across hosts, from the format, variant and the first name that metadata gives."""
    name = F.coalesce(*(F.nullif(strip(F.col(f"metadata.{c}")), F.lit("")) for c in IDENTITY), F.col("relative_path"))
    plain = F.concat_ws("/", slug(F.col("format")), F.nullif(slug(F.col("variant")), F.lit("")), slug(name))
    return F.when(name != "", plain).otherwise(F.concat(F.col("format"), F.lit("#"), F.substring(F.sha1(F.col("relative_path").cast("binary")), 1, 12)))


def last_scanned(records: DataFrame) -> DataFrame:
    """One record per host and configuration: the one scanned last."""
    last = Window.partitionBy("host_id", "config_id").orderBy(F.desc("scan_order"))
    return records.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def signature() -> Column:
    """What changes exactly if a cached comparison of the record is no longer valid."""
    return F.sha2(F.concat_ws(":", "host_id", "config_id", "root_fingerprint", "file_hash").cast("binary"), 256)


def content_type() -> Column:
    """How a record is compared: xml for the XML formats, else text."""
    return F.when(F.col("format").isin(*XML_FORMATS), "xml").otherwise("text")


def against_baseline(records: DataFrame, baseline: str) -> DataFrame:
    """Records (host_id, config_id, canonical) with baseline_host and baseline_canonical.

    A configuration that the baseline host lacks is compared with that of the
    smallest host_id. It takes one window over each configuration's hosts.
    """
    first = Window.partitionBy("config_id").orderBy(F.col("host_id") != baseline, "host_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return records.withColumn("baseline_host", F.first("host_id").over(first)).withColumn("baseline_canonical", F.first("canonical").over(first))


def catalog(compared: DataFrame, hosts: DataFrame) -> DataFrame:
    """One row per configuration: how many hosts have it, how many drift, coverage and severity.

    compared has host_id, config_id and drift_lines; hosts has host_id. Severity
    is high from max(1, hosts div 2) drifting hosts on, medium from one.
    """
    total = hosts.select(F.count("*").alias("total_hosts"))
    by_config = compared.groupBy("config_id").agg(F.count_distinct("host_id").alias("present_hosts"), F.count_if(F.col("drift_lines") > 0).alias("drift_count"), F.sum("drift_lines").alias("drift_lines"))
    rows = by_config.crossJoin(F.broadcast(total))  # one row
    coverage = F.when(F.col("present_hosts") == 0, "missing").when(F.col("present_hosts") >= F.col("total_hosts"), "full").otherwise("partial")
    severity = F.when(F.col("drift_count") >= F.greatest(F.lit(1).cast("bigint"), F.expr("total_hosts div 2")), "high").when(F.col("drift_count") > 0, "medium").otherwise("none")
    return rows.withColumn("coverage", coverage).withColumn("severity", severity).withColumn("missing_hosts", F.col("total_hosts") - F.col("present_hosts"))


def server_status(compared: DataFrame, hosts: DataFrame) -> DataFrame:
    """host_id, config_id and status for every host and configuration: match, drift, missing, or why the host is out.

    hosts has host_id and availability (ok, permission_denied, not_found, offline).
    """
    grid = compared.select("config_id").distinct().crossJoin(small(hosts.select("host_id", "availability")))  # as many rows as the result
    found = compared.select("host_id", "config_id", "drift_lines", F.lit(True).alias("_here"))
    status = (
        F.when(F.col("availability") == "permission_denied", "permission denied")
        .when(F.col("availability") != "ok", "offline")
        .when(F.col("_here").isNull(), "missing")
        .when(F.col("drift_lines") > 0, "drift")
        .otherwise("match")
    )
    return grid.join(found, ["host_id", "config_id"], "left").select("host_id", "config_id", status.alias("status"))


def run_summary(catalog_rows: DataFrame) -> DataFrame:
    """configs_evaluated, drifting_configs and total_hosts."""
    return catalog_rows.agg(F.count("*").alias("configs_evaluated"), F.count_if(F.col("drift_count") > 0).alias("drifting_configs"), F.max("total_hosts").alias("total_hosts"))


def grid(catalog_rows: DataFrame, search: str = "", coverage: str | None = None, severity: str | None = None, format: str | None = None) -> DataFrame:
    """Catalog rows that fit all filters, whatever the case; the search looks for its text in config_id and, where there is one, display_name."""
    rows = catalog_rows
    if search:
        named = [F.contains(F.lower(c), F.lit(search.lower())) for c in ("config_id", "display_name") if c in rows.columns]
        rows = rows.where(F.coalesce(named[0], F.lit(False)) | F.coalesce(named[-1], F.lit(False)))
    for column, wanted in (("coverage", coverage), ("severity", severity), ("format", format)):
        rows = rows.where(F.lower(column) == wanted.lower()) if wanted else rows
    return rows


def coverage_ratio(catalog_rows: DataFrame) -> DataFrame:
    """catalog rows with coverage_ratio, the share of hosts that have the configuration; 0 without hosts."""
    return catalog_rows.withColumn("coverage_ratio", F.when(F.col("total_hosts") > 0, F.col("present_hosts") / F.col("total_hosts")).otherwise(F.lit(0.0)))


def formats(catalog_rows: DataFrame) -> DataFrame:
    """Distinct formats, whatever the case; of each spelling that differs only so, the smallest."""
    return catalog_rows.groupBy(F.lower("format").alias("_key")).agg(F.min("format").alias("format")).select("format")


def hosts_to_rescan(statuses: DataFrame) -> DataFrame:
    """Distinct hosts, whatever the case, that some configuration is missing on."""
    rows = statuses.where("status = 'missing'").groupBy(F.lower("host_id").alias("_key")).agg(F.min("host_id").alias("host_id"), F.count("*").alias("missing_configs"))
    return rows.select("host_id", "missing_configs")


def drilldown(compared: DataFrame, baseline: str) -> DataFrame:
    """config_id, host_id and diff that a configuration's page shows: the baseline host's own one, else that of the first host."""
    first = F.struct(F.col("host_id") != baseline, "host_id")
    return compared.groupBy("config_id").agg(F.min_by(F.struct("host_id", "diff"), first).alias("shown")).select("config_id", "shown.*")


def redaction_status(masked: Column, secrets: Column) -> Column:
    """masked, secrets or visible."""
    return F.when(masked, "masked").when(secrets, "secrets").otherwise("visible")


def availability(found: DataFrame, roots: DataFrame) -> DataFrame:
    """host_id and availability of hosts (roots: host_id, exists) from what scanning gave (found: host_id, error, whose name tells its class).

    Without an existing root a host is not_found; a permission error makes it
    permission_denied, any other error that leaves nothing readable offline.
    """
    listed = roots.groupBy("host_id").agg(F.bool_or("exists").alias("exists"))
    errors = found.groupBy("host_id").agg(F.bool_or(F.coalesce(F.col("error") == "PermissionError", F.lit(False))).alias("denied"), F.every(F.col("error").isNotNull()).alias("all_failed"))
    status = F.when(~F.col("exists"), "not_found").when(F.col("denied"), "permission_denied").when(F.col("all_failed"), "offline").otherwise("ok")
    return listed.join(errors, "host_id", "left").select("host_id", status.alias("availability"))


SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2, "none": 3}


def severity_rank(severity: Column) -> Column:
    """0 for the most severe."""
    return F.create_map(*(F.lit(x) for pair in SEVERITY_RANK.items() for x in pair))[severity]


def by_severity(catalog_rows: DataFrame) -> DataFrame:
    """Catalog rows, the most severe first, then by config_id."""
    return ordered(catalog_rows, "severity", False)


def ordered(catalog_rows: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Catalog rows by a column, severities by their rank and texts whatever the case, then by display_name or config_id."""
    value = severity_rank(F.col(key)) if key == "severity" else F.lower(key) if dict(catalog_rows.dtypes)[key] == "string" else F.col(key)
    name = F.lower("display_name" if "display_name" in catalog_rows.columns else "config_id")
    return catalog_rows.orderBy(value.desc() if descending else value.asc(), name)


def cached(records: DataFrame, cache: DataFrame) -> DataFrame:
    """What the cache holds for records under their present signature."""
    return cache.join(records.select("host_id", "config_id", "signature"), ["host_id", "config_id", "signature"], "left_semi")


def changed_only(records: DataFrame, cache: DataFrame) -> DataFrame:
    """Records whose comparison isn't cached under their present signature."""
    return records.join(cache.select("host_id", "config_id", "signature"), ["host_id", "config_id", "signature"], "left_anti")
