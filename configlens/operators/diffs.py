"""Canonical forms and differences of texts.

Text form, digests and counts are column expressions; JSON and XML forms and
line differences need Python and are small pandas UDFs, which equal texts skip.
"""

from __future__ import annotations

import difflib
import json
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import line_count, normalise_text, redact

#: Bounds of what a difference shows (fixed values): bytes of a canonical text and of a diff, and its lines.
MAX_CANONICAL, MAX_DIFF, MAX_DIFF_LINES = 256 << 10, 128 << 10, 600
MAX_XML = 512 << 10
#: Suffixes of files that are compared as XML (fixed values).
XML_SUFFIXES = (".config", ".csproj", ".resx", ".targets", ".vbproj", ".xml", ".xaml", ".xslt")


def _json_form(compact: bool):
    style = {"separators": (",", ":")} if compact else {"indent": 2}

    @F.pandas_udf(T.StringType())
    def form(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False, **style) if text else None
            except (ValueError, RecursionError):
                return None

        return texts.map(one)

    return form


_HEAD = re.compile(r"\s*(<\?xml\b.*?\?>)?\s*(?:<!--.*?-->\s*)*(<!DOCTYPE[^\[>]*>)?", re.DOTALL)


@F.pandas_udf(T.StringType())
def _canonical_xml(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        if not text or len(text) > MAX_XML or "<!ENTITY" in text:  # never expand entities
            return None
        head = _HEAD.match(text)
        if "<!DOCTYPE" in text and not head[2]:  # one with declarations inside, or out of place
            return None
        try:
            root = ET.fromstring(text)
        except ET.ParseError:
            return None
        for node in root.iter():
            node.attrib = dict(sorted(node.attrib.items()))
            node.text = node.text if node.text and node.text.strip() else None
            node.tail = node.tail if node.tail and node.tail.strip() else None
        ET.indent(root)
        return "\n".join([x for x in head.groups() if x] + [ET.tostring(root, encoding="unicode")])

    return texts.map(one)


def canonical(text: Column, kind: str = "text", compact: bool = False) -> Column:
    """The canonical form of text, json (indented, or compact) or xml; what isn't valid JSON or XML is taken as text."""
    plain = normalise_text(text)
    if kind == "json":
        return F.coalesce(_json_form(compact)(text), plain)
    if kind == "xml":
        return F.coalesce(_canonical_xml(plain), plain)
    return plain


def clamped(text: Column, most: int = MAX_CANONICAL) -> Column:
    """A canonical text as it is shown: at most so many bytes, and a line with its size and digest where it is longer."""
    size = F.octet_length(text)
    notice = F.concat(F.lit("\n[cut: "), size.cast("string"), F.lit(" bytes, sha256 "), F.sha2(text.cast("binary"), 256), F.lit("]"))
    # A character may be cut in the middle; what is left of it goes.
    head = F.rtrim(F.try_validate_utf8(F.substring(text.cast("binary"), 1, most).cast("string")))
    shorter = F.coalesce(head, F.left(text, F.lit(most // 4)))
    return F.when(size <= most, text).otherwise(F.concat(shorter, notice))


_DIFF = T.StructType().add("diff", "string").add("added", "long").add("removed", "long").add("changed", "long").add("truncated", "boolean")


def _line_diff(labels: tuple[str, str], context: int):
    @F.pandas_udf(_DIFF)
    def differ(before: pd.Series, after: pd.Series) -> pd.DataFrame:
        def one(a: str | None, b: str | None) -> tuple:
            old, new = (a or "").splitlines(), (b or "").splitlines()
            added = removed = changed = 0
            for tag, i, j, k, m in difflib.SequenceMatcher(None, old, new).get_opcodes():
                added += (m - k) * (tag == "insert")
                removed += (j - i) * (tag == "delete")
                changed += max(j - i, m - k) * (tag == "replace")
            shown = list(difflib.unified_diff(old, new, *labels, lineterm="", n=context))
            text = "\n".join(shown[:MAX_DIFF_LINES])
            data = text.encode()
            cut = len(shown) > MAX_DIFF_LINES or len(data) > MAX_DIFF
            return data[:MAX_DIFF].decode(errors="ignore"), added, removed, changed, cut

        return pd.DataFrame([one(a, b) for a, b in zip(before, after, strict=True)], columns=["diff", "added", "removed", "changed", "truncated"])

    return differ


def line_diff(pairs: DataFrame, before: str = "before", after: str = "after", tokens: tuple[str, ...] = (), labels: tuple[str, str] = ("before", "after"), context: int = 3) -> DataFrame:
    """pairs with diff, added, removed, changed, truncated and drift_lines; tokens are redacted first, equal texts differ in nothing."""
    a, b = (redact(F.col(c), tokens)[0] for c in (before, after))
    rows = pairs.withColumn("_a", F.coalesce(a, F.lit(""))).withColumn("_b", F.coalesce(b, F.lit("")))
    same = rows.where("_a = _b").withColumn("_d", F.expr("named_struct('diff', '', 'added', 0L, 'removed', 0L, 'changed', 0L, 'truncated', false)"))
    other = rows.where("_a <> _b").withColumn("_d", _line_diff(labels, context)("_a", "_b"))
    out = same.unionByName(other).select("*", "_d.*").drop("_a", "_b", "_d")
    return out.withColumn("drift_lines", F.col("added") + F.col("removed") + F.col("changed"))


@dataclass(frozen=True)
class DiffPlan:
    """How pairs are compared: kind of content, labels, names, tokens to redact and lines of context."""

    content_type: str = "text"
    from_label: str = "before"
    to_label: str = "after"
    baseline_name: str | None = None
    comparison_name: str | None = None
    mask_tokens: tuple[str, ...] = ()
    placeholder: str = "[REDACTED]"
    context_lines: int = 3

    def __post_init__(self):
        if self.content_type not in ("text", "xml", "json"):
            raise ValueError(f"no such content type: {self.content_type}")
        if self.context_lines < 0:
            raise ValueError("context_lines must not be negative")


def execute(plan: DiffPlan, pairs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """pairs in canonical form, redacted and then compared, with how often each token was replaced on both sides."""
    rows = pairs
    for name in (before, after):
        text, found = redact(canonical(F.col(name), plan.content_type), plan.mask_tokens, plan.placeholder)
        counts = F.map_from_arrays(F.array(*map(F.lit, found)), F.array(*found.values())) if found else F.lit(None).cast("map<string,bigint>")
        rows = rows.withColumn(f"{name}_redactions", counts).withColumn(name, text)
    return line_diff(rows, before, after, (), (plan.from_label, plan.to_label), plan.context_lines)


def guess_content_type(before: Column, after: Column) -> Column:
    """xml if one of two paths has a suffix of XML files, else text."""
    suffix = lambda path: F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(?<=.)(\.[^.]*)\z", 1))
    return F.when(suffix(before).isin(*XML_SUFFIXES) | suffix(after).isin(*XML_SUFFIXES), "xml").otherwise("text")


def comparisons(compared: DataFrame, plan: DiffPlan = DiffPlan()) -> DataFrame:
    """compared with payload, a JSON object of each comparison: labels, names, content type, digests and counts of lines."""
    digests = diff_summary(F.col("before"), F.col("after"))
    summary = F.struct(*(digests[c].alias(c) for c in ("before_digest", "after_digest", "diff_digest", "before_lines", "after_lines")), *(F.col(c).alias(f"{c}_lines") for c in ("added", "removed", "changed")))
    metadata = F.struct(F.lit(plan.content_type).alias("content_type"), F.lit(plan.context_lines).alias("context_lines"), F.lit(plan.baseline_name).cast("string").alias("baseline_name"), F.lit(plan.comparison_name).cast("string").alias("comparison_name"))
    one = F.struct(F.lit(plan.from_label).alias("from"), F.lit(plan.to_label).alias("to"), metadata.alias("metadata"), summary.alias("summary"))
    return compared.withColumn("payload", F.to_json(one, {"ignoreNullFields": "false"}))


def diff_summary(before: Column, after: Column) -> dict[str, Column]:
    """Digests and line counts of a pair of canonical texts."""
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return {
        "before_digest": sha(before),
        "after_digest": sha(after),
        "diff_digest": sha(F.concat(before, F.lit("\n---\n"), after)),
        "before_lines": line_count(before),
        "after_lines": line_count(after),
        "identical": before.eqNullSafe(after),
    }


def binary_diff(before: Column, after: Column) -> dict[str, Column]:
    """Sizes, digests and difference in size of a pair of binary values."""
    size = lambda x: F.octet_length(x).cast("bigint")
    return {"before_size": size(before), "after_size": size(after), "delta": size(after) - size(before), "before_sha256": F.sha2(before, 256), "after_sha256": F.sha2(after, 256), "identical": before.eqNullSafe(after)}


def elect_baseline(texts: DataFrame) -> DataFrame:
    """Of texts (path, host_id, canonical), the most frequent one of each path and the first host that has it."""
    counted = texts.groupBy("path", "canonical").agg(F.count("*").alias("hosts"), F.min("host_id").alias("host_id"))
    best = F.min_by(F.struct("host_id", "canonical", "hosts"), F.struct(-F.col("hosts"), F.col("host_id")))
    return counted.groupBy("path").agg(best.alias("best")).select("path", "best.*")
