"""Details of classified files: namespaces, attributes that matter, keys, indentation and spacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import line_count, lines

#: Characters of a document in which namespaces and root attributes are looked for; keys shown of a resource file.
HEAD, KEYS = 4096, 10


def xml_namespaces(files: DataFrame) -> DataFrame:
    """path, prefix (null: default), uri, line, column and fingerprint of the namespace declarations at a document's head."""
    head = F.left(F.col("text"), F.lit(HEAD))
    found = F.regexp_extract_all(head, F.lit(r"""\sxmlns(?::[\w.-]+)?\s*=\s*(?:"[^"]*"|'[^']*')"""), F.lit(0))
    rows = files.select("path", head.alias("head"), F.explode(F.array_distinct(found)).alias("declaration"))
    prefix = F.nullif(F.regexp_extract("declaration", r"xmlns:([\w.-]+)", 1), F.lit(""))
    uri = F.regexp_extract("declaration", r"""=\s*["'](.*)["']\z""", 1)
    before = F.substring(F.col("head"), F.lit(1), F.instr("head", F.col("declaration")))
    column = F.length(F.regexp_replace(before, r"(?s)\A.*\n", "")) + 1
    line = F.regexp_count(before, F.lit("\n")) + 1
    return rows.select("path", prefix.alias("prefix"), uri.alias("uri"), line.cast("bigint").alias("line"), column.cast("bigint").alias("column"), F.substring(F.sha1(uri.cast("binary")), 1, 12).alias("fingerprint"))


def schema_locations(files: DataFrame) -> DataFrame:
    """path, namespace and location of schemaLocation pairs."""
    value = F.regexp_extract("text", r"""schemaLocation\s*=\s*["']([^"']*)["']""", 1)
    parts = F.filter(F.split(F.trim(value), r"\s+"), lambda x: x != "")
    rows = files.select("path", F.posexplode(parts).alias("at", "part")).withColumn("pair", F.floor(F.col("at") / 2))
    pairs = rows.groupBy("path", "pair").agg(F.min_by("part", "at").alias("namespace"), F.max_by("part", "at").alias("location"), F.count("*").alias("n"))
    return pairs.where("n = 2").select("path", "namespace", "location")


def resource_keys(files: DataFrame) -> DataFrame:
    """path, key_count and the first keys of resource files."""
    keys = F.regexp_extract_all("text", F.lit(r"""<data\s+[^>]*\bname\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return files.select("path", F.size(keys).cast("bigint").alias("key_count"), F.slice(keys, 1, KEYS).alias("keys"))


#: Patterns of attributes that hold connections, addresses and switches.
HINTS = {
    "connection-string": r"""(?i)\bconnectionString\s*=\s*["']([^"']+)["']""",
    "endpoint": r"""(?i)\b(?:address|endpoint|serviceUrl|baseAddress)\s*=\s*["']([a-z][a-z0-9+.-]*://[^"']+)["']""",
    "feature-flag": r"""(?i)\bkey\s*=\s*["'][^"']*(?:feature|flag|toggle)[^"']*["'][^>]*\bvalue\s*=\s*["']([^"']+)["']""",
}


def attribute_hints(files: DataFrame) -> DataFrame:
    """path, kind and value_sha256 of attributes of note, each value once; values themselves are never shown."""
    found = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("values")) for k, p in HINTS.items()))
    rows = files.select("path", F.explode(found).alias("hint")).select("path", "hint.kind", F.explode("hint.values").alias("value"))
    return rows.select("path", "kind", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256")).distinct()


def build_imports(files: DataFrame) -> DataFrame:
    """path, target names and digests of imported projects of build files."""
    targets = F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit(r"""<Target\s+[^>]*\bName\s*=\s*["']([^"']*)["']"""), F.lit(1))), 1, KEYS)
    imports = F.regexp_extract_all("text", F.lit(r"""<Import\s+[^>]*\bProject\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return files.select("path", targets.alias("targets"), F.transform(F.array_distinct(imports), lambda x: F.sha2(x.cast("binary"), 256)).alias("import_sha256"))


def _most_frequent(rows: DataFrame, value: str) -> DataFrame:
    """Each path's most frequent value; of equally frequent ones the first met."""
    counted = rows.groupBy("path", value).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    return counted.groupBy("path").agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))


def indentation(files: DataFrame) -> DataFrame:
    """path, style (spaces, tabs, mixed), width (the most frequent step) and outlier_lines of indented files.

    A line is an outlier if its indentation is no multiple of the width.
    """
    rows = files.select("path", F.posexplode(lines(F.col("text"))).alias("at", "line")).where(F.col("line").rlike(r"^[ \t]+[^\s#]"))
    rows = rows.withColumn("blank", F.regexp_extract("line", r"^[ \t]+", 0)).withColumn("depth", F.length("blank"))
    before = F.coalesce(F.lag("depth").over(Window.partitionBy("path").orderBy("at")), F.lit(0))
    steps = rows.withColumn("width", F.abs(F.col("depth") - before)).where("width > 0 AND blank NOT LIKE '%\t%'")
    width = _most_frequent(steps, "width")
    tabs, spaces = F.bool_or(F.contains("blank", F.lit("\t"))), F.bool_or(F.contains("blank", F.lit(" ")))
    style = F.when(tabs & spaces, "mixed").when(tabs, "tabs").otherwise("spaces")
    joined = rows.join(width, "path", "left")
    outlier = F.col("width").isNotNull() & (F.col("depth") % F.col("width") != 0)
    return joined.groupBy("path").agg(style.alias("style"), F.max("width").cast("bigint").alias("width"), F.array_sort(F.collect_list(F.when(outlier, F.col("at") + 1))).alias("outlier_lines"))


def assignment_spacing(files: DataFrame) -> DataFrame:
    """path, spacing (the most frequent blanks around =, as `b=a`) and lines with tabs there."""
    pattern = r"^\s*[\w.\-\"]+([ \t]*)=([ \t]*)\S"
    rows = files.select("path", F.posexplode(lines(F.col("text"))).alias("at", "line")).where(F.col("line").rlike(pattern))
    before, after = (F.regexp_extract("line", pattern, i) for i in (1, 2))
    rows = rows.withColumn("spacing", F.concat(F.length(before), F.lit("="), F.length(after))).withColumn("tab", F.contains(F.concat(before, after), F.lit("\t")))
    tabs = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.when(F.col("tab"), F.col("at") + 1))).alias("tab_lines"))
    return _most_frequent(rows, "spacing").join(tabs, "path")


def text_profile(text: Column) -> dict[str, Column]:
    """Line, comment and blank line counts of a text."""
    every = lines(text)
    count = lambda p: F.size(F.filter(every, lambda x: x.rlike(p))).cast("bigint")
    return {"lines": line_count(text), "comment_lines": count(r"^\s*[#;]"), "blank_lines": count(r"^\s*$")}
