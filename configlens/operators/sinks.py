"""What results are written as: typed JSON lines, reports, manifests and notifications."""

from __future__ import annotations

import html
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from email.message import EmailMessage

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RETENTION_DAYS = 30


def json_records(**kinds: DataFrame) -> DataFrame:
    """value: one JSON line {"payload": ..., "type": ...} for each row of each kind, keys sorted."""
    out = None
    for kind in sorted(kinds):
        rows = kinds[kind]
        payload = F.struct(*(F.col(f"`{c}`") for c in sorted(rows.columns)))
        lines = rows.select(F.to_json(F.struct(payload.alias("payload"), F.lit(kind).alias("type"))).alias("value"))
        out = lines if out is None else out.unionByName(lines)
    return out


def write_json_lines(path: str, **kinds: DataFrame) -> None:
    """json_records() as text files."""
    json_records(**kinds).write.mode("overwrite").text(path)


def snapshot_manifest(captured: DataFrame, operator: str, environment: str, reason: str, classification: str = "internal") -> DataFrame:
    """One row that says what a snapshot holds, who took it and how long it may be kept."""
    return captured.agg(F.count("*").alias("records")).select("records", F.lit(operator).alias("operator"), F.lit(environment).alias("environment"), F.lit(reason).alias("reason"), F.lit(classification).alias("classification"), F.lit(RETENTION_DAYS).alias("retention_days"))


def html_report(summary: DataFrame, hits: DataFrame, title: str = "Configuration report", rows: int = 200) -> str:
    """A page with a summary and the first hits, for people; at most `rows` rows of each reach the driver."""

    def part(df: DataFrame) -> str:
        cells = lambda tag, xs: "".join(f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>" for x in xs)
        return f"<table><tr>{cells('th', df.columns)}</tr>" + "".join(f"<tr>{cells('td', r)}</tr>" for r in df.limit(rows).collect()) + "</table>"

    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><h2>Detections</h2>{part(summary)}<h2>Hits</h2>{part(hits)}</body></html>"


def slack_payload(message: Mapping[str, str]) -> str:
    """A message with title, body and details as a chat webhook takes it."""
    details = "".join(f"\n• {k}: {v}" for k, v in sorted(message.items()) if k not in ("title", "body"))
    return json.dumps({"text": f"*{message['title']}*\n{message['body']}{details}"}, ensure_ascii=False)


def teams_payload(message: Mapping[str, str]) -> str:
    """The same as a message card."""
    facts = [{"name": k, "value": v} for k, v in sorted(message.items()) if k not in ("title", "body")]
    return json.dumps({"@type": "MessageCard", "@context": "https://schema.org/extensions", "title": message["title"], "text": message["body"], "sections": [{"facts": facts}]}, ensure_ascii=False)


def mail_payload(message: Mapping[str, str], sender: str, to: Sequence[str]) -> str:
    """The same as a plain mail with headers."""
    mail = EmailMessage()
    mail["Subject"], mail["From"], mail["To"] = message["title"], sender, ", ".join(to)
    details = "".join(f"\n{k}: {v}" for k, v in sorted(message.items()) if k not in ("title", "body"))
    mail.set_content(f"{message['body']}{details}")
    return mail.as_string()


def notify(send: Callable[[str], None], build: Callable[[Mapping[str, str]], str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that sends every message (title, body and string columns) of each batch, a partition's at a time."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        for row in batch.toLocalIterator():
            send(build({k: str(v) for k, v in row.asDict().items()}))

    return handle


#: Columns of the table that a scan prints, and how wide the last two may get (fixed values).
TABLE_COLUMNS = ("Path", "Format", "Variant", "Confidence", "Severity", "Severity hint", "Metadata keys")
TABLE_WIDTHS = {"Severity hint": 72, "Metadata keys": 48}
NOTHING = "\u2014"


def ellipsis(value: Column, width: int) -> Column:
    """A text of at most so many characters, the last one an ellipsis where it is cut."""
    return F.when(F.length(value) <= width, value).otherwise(F.concat(F.left(value, F.lit(width - 1)), F.lit("\u2026")))


def scan_table(detections: DataFrame) -> DataFrame:
    """The printed table's cells for each file: a dash where there is nothing, long ones cut."""
    metadata = F.array_join(F.array_sort(F.map_keys("metadata")), ", ") if "metadata" in detections.columns else F.lit(None).cast("string")
    hint = F.col("severity_hint") if "severity_hint" in detections.columns else F.lit(None).cast("string")
    cells = [F.col("relative_path"), F.col("format"), F.col("variant"), F.format_string("%.2f", "confidence"), F.col("catalog_severity"), hint, metadata]
    cells[3] = F.when(F.col("confidence").isNotNull(), cells[3])
    filled = [F.coalesce(F.nullif(c, F.lit("")), F.lit(NOTHING)) for c in cells]
    return detections.select(*((ellipsis(c, TABLE_WIDTHS[n]) if n in TABLE_WIDTHS else c).alias(n) for n, c in zip(TABLE_COLUMNS, filled, strict=True)))


def table_lines(detections: DataFrame) -> Iterator[str]:
    """The table for people line by line, all files by path; only one partition at a time is on the driver."""
    table = scan_table(detections)
    longest = table.agg(*(F.max(F.length(c)).alias(c) for c in TABLE_COLUMNS)).first()
    widths = [max(len(c), 4, longest[c] or 0) for c in TABLE_COLUMNS]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)).rstrip()
    yield line(TABLE_COLUMNS)
    yield line(["-" * w for w in widths])
    for row in table.orderBy("Path").toLocalIterator():
        yield line([row[c] for c in TABLE_COLUMNS])


def print_table(detections: DataFrame) -> str:
    """The table as one text."""
    return "\n".join(table_lines(detections))


def scan_json(detections: DataFrame) -> DataFrame:
    """value: one JSON object for each file with path and detected, and for detected ones format, variant, confidence and severity; keys sorted, nulls kept."""
    detected = F.col("format").isNotNull()
    keep = {"ignoreNullFields": "false"}
    full = F.struct("confidence", detected.alias("detected"), "format", F.col("relative_path").alias("path"), F.col("catalog_severity").alias("severity"), "variant")
    bare = F.struct(detected.alias("detected"), F.col("relative_path").alias("path"))
    return detections.select(F.when(detected, F.to_json(full, keep)).otherwise(F.to_json(bare, keep)).alias("value"))


def patch_name(before: Column, after: Column) -> Column:
    """The file name of a difference between two paths: their stems, blanks as dashes."""
    stem = lambda path: F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*\z", ""), " ", "-")
    named = lambda path, other: F.coalesce(F.nullif(stem(path), F.lit("")), F.lit(other))
    return F.concat(named(before, "baseline"), F.lit("--"), named(after, "comparison"), F.lit(".patch"))


def write_patches(diffs: DataFrame, folder: str) -> None:
    """Differences (before_path, after_path, diff) as text, in a folder for each patch name."""
    named = diffs.select(patch_name(F.col("before_path"), F.col("after_path")).alias("patch"), F.col("diff").alias("value"))
    named.write.mode("overwrite").partitionBy("patch").text(folder)


def free_names(wanted: DataFrame, taken: DataFrame, key: str = "name") -> DataFrame:
    """wanted (name, rank) with free_name: name, or the first of name-1, name-2, ... that is neither taken nor wanted by itself, in order of rank.

    Names taken by others leave gaps, which are filled; each name is given once.
    """
    # What is taken, or wanted as such, by the stem before its number; the bare name is number 0.
    asked = wanted.select(key).distinct()
    used = taken.select(key).union(asked).distinct()
    numbered = used.select(F.regexp_replace(key, r"-[1-9]\d{0,8}\z", "").alias(key), F.regexp_extract(key, r"-([1-9]\d{0,8})\z", 1).alias("_n")).where("_n <> ''")
    used = numbered.select(key, F.col("_n").cast("bigint").alias("_n")).union(taken.select(key, F.lit(0).cast("bigint"))).distinct().join(asked, key, "left_semi")
    place = lambda order: F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("bigint") - 1
    # A used number is passed by the rows whose place is at least the count of free numbers below it, so free ones are never listed.
    passed = used.select(key, (F.col("_n") - place("_n")).alias("_at"), F.lit(1).alias("_used"))
    rows = wanted.withColumn("_at", place("rank")).withColumn("_used", F.lit(0)).unionByName(passed, allowMissingColumns=True)
    before = Window.partitionBy(key).orderBy("_at", F.desc("_used")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_n", F.col("_at") + F.sum("_used").over(before)).where("_used = 0")
    name = F.when(F.col("_n") == 0, F.col(key)).otherwise(F.concat(key, F.lit("-"), F.col("_n").cast("string")))
    return rows.withColumn("free_name", name).select(*wanted.columns, "free_name")


def write_diff_cache(compared: DataFrame, path: str) -> None:
    """Comparisons (host_id, config_id, signature and more) as the cache that changed_only() and cached() read, with the name of each entry."""
    entry = F.sha1(F.concat_ws(":", "host_id", "config_id").cast("binary"))
    compared.withColumn("entry", entry).write.mode("overwrite").parquet(path)
