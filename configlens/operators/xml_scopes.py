"""The heads of XML documents: tags with their scopes, the root, and the variant that its namespace says.

Tags in comments, processing instructions, CDATA and document types are none. A
prefix means what the nearest element around binds it to, so declarations below
the root don't change what the root is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .metadata import HEAD

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<\?.*?(?:\?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<!DOCTYPE(?:[^\[>"']|"[^"]*"|'[^']*'|\[.*?\])*(?:>|\Z)|<(/?)([^\W\d][\w:.-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)(>?)""", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s=<>"'/]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_ROW = "depth int, element string, element_namespace string, attribute string, value string, line int, column int"
_SCOPES = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType() if k == "int" else T.StringType()) for n, k in (x.split() for x in _ROW.split(", "))]))


def tags(head: str) -> Iterator[tuple]:
    """A row for each attribute of each start tag (one without attribute for a bare tag), with depth and the element's namespace by the scopes around it."""
    scopes: list[tuple[str, dict[str, str]]] = []
    lines = [0, *(m.end() for m in re.finditer("\n", head))]
    for token in _TOKEN.finditer(head):
        closing, name, inside = token.group(1), token.group(2), token.group(3)
        if name is None:
            continue
        if closing:
            while scopes and scopes.pop()[0] != name:  # what isn't closed ends with what is around it
                pass
            continue
        found = [(m.group(1), m.group(2) if m.group(2) is not None else m.group(3), token.start(3) + m.start()) for m in _ATTRIBUTE.finditer(inside)]
        bound = dict(scopes[-1][1]) if scopes else {}
        bound |= {key.partition(":")[2]: value.strip() for key, value, _ in found if key == "xmlns" or key.startswith("xmlns:")}
        prefix = name.partition(":")[0] if ":" in name else ""
        for key, value, at in found or [(None, None, token.start())]:
            line = _line(lines, at)
            yield len(scopes), name, bound.get(prefix) or None, key, value, line + 1, at - lines[line] + 1
        if not inside.rstrip().endswith("/"):
            scopes.append((name, bound))


def _line(starts: list[int], at: int) -> int:
    low, high = 0, len(starts)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if starts[middle] <= at else (low, middle)
    return low


@F.pandas_udf(_SCOPES)
def _scopes(heads: pd.Series) -> pd.Series:
    names = [f.name for f in _SCOPES.elementType]
    return heads.map(lambda head: [dict(zip(names, row, strict=True)) for row in tags(head)], na_action="ignore")


def scopes(files: DataFrame, head: int = HEAD) -> DataFrame:
    """path, depth, element, element_namespace, attribute, value, line and column of the tags in the first characters of each text; null texts have none."""
    return files.select("path", F.explode(_scopes(F.left(F.col("text"), F.lit(head)))).alias("tag")).select("path", "tag.*")


def namespaces(files: DataFrame) -> DataFrame:
    """path, prefix (null: default), uri, element, depth, line, column and fingerprint of every declaration in a head."""
    rows = scopes(files).where(F.col("attribute").rlike(r"\Axmlns(:|\z)"))
    uri = F.trim("value")
    fingerprint = F.substring(F.sha1(F.concat("attribute", F.lit("|"), uri).cast("binary")), 1, 12)
    return rows.select("path", F.nullif(F.substring("attribute", 7, 1 << 20), F.lit("")).alias("prefix"), uri.alias("uri"), "element", "depth", "line", "column", fingerprint.alias("fingerprint"))


#: Formats and variants by the root's namespace, and by its local name (fixed values).
BY_NAMESPACE = [
    (r"(?i)urn:schemas-microsoft-com:asm\.v1", "xml", "app-manifest-xml"),
    (r"(?i)http://schemas\.microsoft\.com/.*resx", "xml", "resource-xml"),
    (r"(?i)http://schemas\.microsoft\.com/winfx/2006/xaml", "xml", "interface-xml"),
    (r"(?i)http://www\.w3\.org/1999/XSL/Transform", "xml", "xslt-xml"),
]
VENDOR_ROOTS = ("nlog", "log4net", "serilog")
_KINDS = {".targets": "msbuild-targets", ".props": "msbuild-props"}


def root_variant(root: Column, namespace: Column, extension: Column) -> Column:
    """Struct of format and variant that a document's root says, null where it says nothing: its namespace first, then its local name; the suffix only tells kinds of build files."""
    local = F.lower(F.regexp_replace(root, r"\A.*:", ""))
    pair = lambda kind, variant: F.struct(F.lit(kind).alias("format"), (variant if isinstance(variant, Column) else F.lit(variant)).alias("variant"))
    found = F.when(F.lit(False), pair("xml", "generic"))
    for pattern, kind, variant in BY_NAMESPACE:
        found = found.when(namespace.rlike(pattern), pair(kind, variant))
    build = (local == "project") & (namespace.isNull() | namespace.rlike(r"(?i)http://schemas\.microsoft\.com/developer/msbuild/2003"))
    kinds = F.coalesce(*(F.when(extension == suffix, variant) for suffix, variant in _KINDS.items()), F.lit("msbuild-project"))
    return found.when(build, pair("xml", kinds)).when(local.isin(*VENDOR_ROOTS), pair("structured-config-xml", F.concat(local, F.lit("-config"))))


def roots(files: DataFrame) -> DataFrame:
    """path, root, root_prefix, root_namespace, attributes (a map without declarations), line, column, format and variant of each document (path, extension, text) with a root."""
    first = scopes(files).where("depth = 0").groupBy("path", "element", "element_namespace").agg(
        F.min(F.struct("line", "column")).alias("at"),
        F.map_from_entries(F.array_distinct(F.collect_list(F.when(~F.col("attribute").rlike(r"\Axmlns(:|\z)"), F.struct("attribute", "value"))))).alias("attributes"),
    )
    # A head has one root; of several elements at its depth, as broken texts have, the first is it.
    one = first.groupBy("path").agg(F.min_by(F.struct("element", "element_namespace", "attributes", "at"), "at").alias("r")).select("path", "r.*")
    rows = one.join(files.select("path", "extension"), "path")
    prefix = F.nullif(F.regexp_extract("element", r"\A(.+):", 1), F.lit(""))
    said = root_variant(F.col("element"), F.col("element_namespace"), F.col("extension"))
    rows = rows.select("path", F.col("element").alias("root"), prefix.alias("root_prefix"), F.col("element_namespace").alias("root_namespace"), "attributes", "at.line", "at.column", said.alias("said"))
    return rows.select("path", "root", "root_prefix", "root_namespace", "attributes", "line", "column", F.col("said.format").alias("format"), F.col("said.variant").alias("variant"))
