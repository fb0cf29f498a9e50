"""The engine's commands: scanning trees, hunting in them, comparing hosts."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.shared import Tables
from .operators import budget as budgets
from .operators import classify, compare, diffs, hosts, hunt, package, profiles, secrets, sinks, snapshots
from .sources import decode, files, listing, sqlite


def samples(listed: DataFrame, limit: int | None, sample_size: int = budgets.DEFAULT_SAMPLE, by: Sequence[str] = (), opened: Accumulator | None = None) -> DataFrame:
    """Listed files with their samples; with a budget of sampled bytes only those within it, the last one cut. Files beyond it are not opened."""
    if limit is None:
        return listing.read_samples(listed, sample_size, opened)
    sized = listed.withColumn("_length", F.coalesce("length", F.lit(0)))
    kept = budgets.within_budget(sized, "file_order", "_length", sample_size, limit, by).drop("_length")
    return listing.read_samples(kept, "sample_bytes", opened)


def scan(spark: SparkSession, root: str, budget: int | None = budgets.DEFAULT_BUDGET, sample_size: int = budgets.DEFAULT_SAMPLE, using: Sequence | None = None, glob: str = "**", links: bool = True, opened: Accumulator | None = None) -> DataFrame:
    """The files below a root, classified, with catalog severities.

    The tree is listed at once, contents are read lazily. In path order, files
    beyond a budget of sampled bytes are neither read nor returned; budget=None
    reads all. `using` replaces the detectors.
    """
    rows = samples(listing.listing(spark, {"local": [root]}, glob, links), budget, sample_size, opened=opened)
    return classify.with_catalog(classify.classify(decode.with_text(rows), using))


def scan_with_profiles(detections: DataFrame, store: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Scanned files with the profiles that apply to each, nested; reviews that these ignore are suppressed."""
    given = profiles.provided(list(tags))
    matched = profiles.matching(detections.select("relative_path").distinct(), store, given)
    nested = matched.groupBy("relative_path").agg(F.array_sort(F.collect_list(F.struct("profile", "position", "config_id", "expected_format", "expected_variant"))).alias("profiles"))
    return profiles.suppress_review(detections, matched).join(nested, "relative_path", "left")


def _texts(spark: SparkSession, root: str) -> DataFrame:
    return decode.with_text(listing.read_samples(listing.listing(spark, {"local": [root]}))).where("text IS NOT NULL")


def hunt_tree(spark: SparkSession, root: str, rules: Sequence[hunt.Rule] = hunt.DEFAULT_RULES, exclude: Sequence[str] = ()) -> DataFrame:
    """Hits of rules in the text files below a root."""
    texts = _texts(spark, root)
    return hunt.hunt(texts.select(F.col("relative_path").alias("path"), "text"), rules, exclude)


def records(texts: DataFrame) -> DataFrame:
    """Configurations of hosts' decoded files (host_id, name, extension, relative_path, sample, text, scan_order): config_id and canonical.

    Of several files of one configuration on a host the last one scanned stays.
    XML is taken in canonical form, everything else as text.
    """
    found = classify.identity(classify.classify(texts).where("format IS NOT NULL"))
    rows = hosts.last_scanned(found.withColumn("config_id", hosts.config_id())).withColumn("kind", hosts.content_type())
    xml = diffs.canonical(F.when(F.col("kind") == "xml", F.col("text")), "xml")  # a null for all others, so that all pass once
    return rows.withColumn("_xml", xml).withColumn("canonical", F.when(F.col("kind") == "xml", F.col("_xml")).otherwise(diffs.canonical(F.col("text")))).drop("_xml")


def compare_hosts(spark: SparkSession, roots: dict[str, list[str]], baseline: str | None = None, budget: int | None = budgets.HOST_BUDGET, sample_size: int = budgets.DEFAULT_SAMPLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Catalog, each host's status, and the compared records of several hosts' trees.

    The first host is the baseline unless another is named. Each host has a
    budget of sampled bytes for all of its roots.
    """
    listed = listing.listing(spark, roots)
    read = samples(listed, budget, sample_size, ["host_id"]).withColumn("scan_order", F.col("file_order"))
    found = Tables(spark, "records").write(records(decode.with_text(read)))  # read and classified once for all three results
    compared = hosts.against_baseline(found.select("host_id", "config_id", "format", "variant", "relative_path", "canonical"), baseline or next(iter(roots)))
    compared = diffs.line_diff(compared, "baseline_canonical", "canonical")
    known = spark.createDataFrame([(h,) for h in roots], "host_id string")
    exists = spark.createDataFrame([(h, files.exists(r)) for h, paths in roots.items() for r in paths], "host_id string, exists boolean")
    available = hosts.availability(listed.select("host_id", "error"), exists)
    return hosts.catalog(compared, known), hosts.server_status(compared, available), compared


def find_secrets(spark: SparkSession, root: str, rules: Sequence[secrets.SecretRule] | secrets.SecretSettings = secrets.SAMPLE_RULES) -> DataFrame:
    """Lines with secrets in the text files below a root, by rules or by a job's settings."""
    texts = _texts(spark, root)
    used = rules if isinstance(rules, secrets.SecretSettings) else secrets.SecretSettings(tuple(rules))
    return secrets.scan(texts.select(F.col("relative_path").alias("path"), "text"), used.rules, used.ignore_rules, used.ignore_patterns)


def diff(spark: SparkSession, before: str, after: str, plan: diffs.DiffPlan = diffs.DiffPlan()) -> DataFrame:
    """Two files of any size that a driver can read, compared by a plan."""

    def text(path: str) -> str:
        with open(path, encoding="utf-8", errors="ignore") as file:
            return file.read()

    pair = spark.createDataFrame([(before, after, text(before), text(after))], "before_path string, after_path string, before string, after string")
    return diffs.comparisons(diffs.execute(plan, pair), plan)


def export_snapshot(spark: SparkSession, database: str, folder: str, masked: object = (), hashed: object = (), salt: str = "", include: Sequence[str] = (), exclude: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """The tables of a SQLite file as JSON below a folder, masked and hashed, and their manifest; nothing there is overwritten."""
    hide, hash_ = snapshots.column_map(masked), snapshots.column_map(hashed)
    names = snapshots.chosen_tables(sqlite.tables(database), include, exclude)
    stem = os.path.splitext(os.path.basename(database))[0]
    free = next(f"{stem}{suffix}" for suffix in ("", *(f"-{i}" for i in range(1, 1 << 20))) if not os.path.exists(os.path.join(folder, f"{stem}{suffix}")))
    tables = {n: sqlite.read_table(spark, database, n) for n in names}
    for name, rows in tables.items():
        snapshots.snapshot(rows, name, hide.get(name, ()), hash_.get(name, ()), salt, limit=limit).write.json(os.path.join(folder, free, name))
    manifest = snapshots.manifest(tables, hide, hash_)
    manifest.write.json(os.path.join(folder, free, "manifest"))
    return manifest


def run_profile(spark: SparkSession, name: str, sources: Sequence[str], folder: str, timestamp: str, baseline: str | None = None, rules: Sequence[secrets.SecretRule] = secrets.SAMPLE_RULES, base_dir: str = ".") -> tuple[DataFrame, DataFrame]:
    """Copies of a profile's files below folder/name/timestamp, secrets replaced in texts, with metadata, and the findings.

    Binary files are copied as they are. The folder has to be shared by all executors.
    """
    paths = package.expand_sources(sources, baseline, base_dir)
    rows = spark.createDataFrame([(p, os.path.join(f"source_{k:02d}", os.path.basename(p))) for k, p in enumerate(paths)], "source string, destination string")
    content = spark.read.format("binaryFile").load([p for p in paths if os.path.getsize(p)] or []).select(F.regexp_replace("path", "^file:/*", "/").alias("source"), "content") if any(map(os.path.getsize, paths)) else spark.createDataFrame([], "source string, content binary")
    rows = rows.join(content, "source", "left").withColumn("content", F.coalesce("content", F.lit(b"")))
    texts = rows.where(~secrets.is_binary(F.col("content"))).withColumn("text", F.decode(F.col("content"), "UTF-8"))
    findings = secrets.scan(texts.select(F.col("source").alias("path"), "text"), rules)
    found = findings.select(F.col("path").alias("source")).distinct()
    clean = secrets.sanitise(texts.join(found, "source", "left_semi"), rules).withColumn("content", F.col("text").cast("binary")).drop("text")
    copied = package.copy_files(rows.join(found, "source", "left_anti").unionByName(clean), os.path.join(folder, package_name(name), timestamp))
    written = os.path.join(folder, package_name(name), timestamp, "metadata")
    copied.write.json(written)
    return spark.read.schema(copied.schema).json(written), findings


def package_name(name: str) -> str:
    """A name as a folder: letters, digits, `.`, `_` and `-`."""
    return "".join(c if c.isalnum() or c in "._-" else "-" for c in name.strip()).strip("-") or "item"


def capture(spark: SparkSession, root: str, folder: str, identity: Mapping[str, str], tokens: Sequence[str] = (), rules: Sequence[hunt.Rule] = hunt.DEFAULT_RULES) -> DataFrame:
    """Detections and hits of a tree below a folder, redacted, and the manifest of the capture.

    identity has id, operator, environment and reason, none of them empty.
    """
    missing = [k for k in ("id", "operator", "environment", "reason") if not str(identity.get(k, "")).strip()]
    if missing:
        raise ValueError(f"a capture needs {', '.join(missing)}")
    from .functions.text import redact

    found = scan(spark, root).where("format IS NOT NULL").select("relative_path", "format", "variant", "confidence", "catalog_severity")
    hits = hunt_tree(spark, root, rules)
    excerpt, counts = redact(F.col("excerpt"), tokens)
    redacted = hits.select("rule", "token", "path", "line_number", excerpt.alias("excerpt"), sum(counts.values(), F.lit(0)).cast("bigint").alias("redactions"))
    where = os.path.join(folder, package_name(identity["id"]))
    found.write.mode("overwrite").json(os.path.join(where, "detections"))
    redacted.write.mode("overwrite").json(os.path.join(where, "hits"))
    detections = read_capture(spark, where)
    kept = spark.read.schema(redacted.schema).json(os.path.join(where, "hits"))
    totals = detections.agg(F.count("*").alias("detections")).crossJoin(kept.agg(F.count("*").alias("hunt_hits"), F.coalesce(F.sum("redactions"), F.lit(0)).alias("total_redactions")))  # one row each
    manifest = totals.select(*(F.lit(str(identity[k])).alias(k) for k in sorted(identity)), F.lit(root).alias("root"), F.lit(len(set(tokens))).alias("mask_token_count"), "*", F.lit(sinks.RETENTION_DAYS).alias("retention_days"))
    manifest.write.mode("overwrite").json(os.path.join(where, "manifest"))
    return manifest


def read_capture(spark: SparkSession, where: str) -> DataFrame:
    """The detections of a capture."""
    return spark.read.schema("relative_path string, format string, variant string, confidence double, catalog_severity string").json(os.path.join(where, "detections"))


def compare_captures(before: DataFrame, after: DataFrame) -> DataFrame:
    """relative_path, format, variant and status of the detections of two captures; a changed one has another confidence or severity."""
    return compare.compare(before, after, ["relative_path", "format", "variant"], F.struct("confidence", "catalog_severity"))


def run_hosts(spark: SparkSession, request: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """compare_hosts() of a request in JSON: schema_version and plans (host_id, roots, baseline with is_preferred and priority)."""
    rows = spark.createDataFrame([(request,)], "value string")
    schema = "struct<schema_version:string,plans:array<struct<host_id:string,label:string,roots:array<string>,baseline:struct<is_preferred:boolean,priority:int>>>>"
    found = rows.select(F.from_json("value", schema).alias("r")).first().r
    if not found or not found.plans:
        raise ValueError("a request has plans")
    if found.schema_version not in (None, "multi-server.v1"):
        raise ValueError(f"no such schema version: {found.schema_version}")
    best = min(enumerate(found.plans), key=lambda p: (not (p[1].baseline and p[1].baseline.is_preferred), -((p[1].baseline and p[1].baseline.priority) or 0), p[0]))[1]
    return compare_hosts(spark, {p.host_id: list(p.roots or ()) for p in found.plans}, best.host_id)
