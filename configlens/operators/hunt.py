"""Hunt: rules search the lines of files for values that differ between hosts."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import digest, glob_from_right, lines, strip


@dataclass(frozen=True)
class Rule:
    """A file takes part if its text has all keywords; a line hits with any keyword and a pattern."""

    name: str
    token: str | None = None
    keywords: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    description: str = ""

    @property
    def flagged(self) -> list[str]:
        return [f"(?iuU){p}" for p in self.patterns]


#: The default rules: names, tokens, keywords and patterns are fixed values.
DEFAULT_RULES = (
    Rule("server-name", "server_name", ("server", "host"), (r"\b[a-z0-9_-]+\.(local|lan|corp|com|net|internal)\b",), "names of machines"),
    Rule("certificate-thumbprint", "certificate_thumbprint", ("thumbprint", "certificate"), (r"\b[0-9a-f]{40}\b", r"\b[0-9a-f]{64}\b"), "digests of certificates"),
    Rule("version-number", "version", ("version",), (r"\b\d+\.\d+\.\d+(?:\.\d+)?\b",), "versions of three or four numbers"),
    Rule("install-path", "install_path", ("path", "install"), (r"[A-Za-z]:\\\\[\\w\\-\\.\\s]+", r"/opt/[\w\-\.]+"), "folders of installations"),
    Rule("connection-string", "connection_string", (), (r"""connectionstring\s*=\s*['"][^'"\n]+['"]""",), "connection strings in attributes"),
    Rule("service-endpoint", "service_endpoint", (), (r"""<endpoint\b[^>]*\baddress\s*=\s*['"][^'\"]+['"]""", r"""(endpoint|serviceurl|baseaddress)\s*=\s*['"][^'\"]+['"]""", r"""key\s*=\s*['"][^'\"]*(endpoint|serviceurl|baseaddress|address)[^'\"]*['"][^\n]*value\s*=\s*['"][^'\"]+['"]"""), "addresses of services"),
    Rule("feature-flag", "feature_flag", (), (r"""key\s*=\s*['"][^'\"]*(feature|flag|toggle)[^'\"]*['"][^\n]*value\s*=\s*['"][^'\"]+['"]""", r"""<feature\b[^>]*\b(enabled|value)\s*=\s*['"][^'\"]+['"]"""), "switches of features"),
)


def _fields(groups: list[int]) -> Callable[[Column], Column]:
    return lambda row: F.array(*(row[f"g{g}"] for g in groups))


def _matches(line: Column, rule: Rule) -> Column:
    """Non-empty groups, then whole matches, of each pattern, stripped and distinct in order; the stripped line where nothing but empty text matches."""
    found = []
    for plain, pattern in zip(rule.patterns, rule.flagged, strict=True):
        groups = [*range(1, re.compile(plain).groups + 1), 0]
        per_group = [F.regexp_extract_all(line, F.lit(pattern), F.lit(g)) for g in groups]
        if len(per_group) == 1:
            found.append(per_group[0])
        else:
            zipped = F.arrays_zip(*(x.alias(f"g{g}") for g, x in zip(groups, per_group, strict=True)))
            found.append(F.flatten(F.transform(zipped, _fields(groups))))
    if not found:
        return F.filter(F.array(strip(line)), lambda x: x != "")
    filled = F.filter(F.flatten(F.array(*found)), lambda x: x.isNotNull() & (x != ""))
    values = F.when(F.size(filled) == 0, F.array(line)).otherwise(filled)
    return F.array_distinct(F.filter(F.transform(values, strip), lambda x: x != ""))


def _has(text: Column, keyword: str) -> Column:
    return F.contains(F.lower(text), F.lit(keyword.lower()))


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


HIT = "struct<rule:string,token:string,matches:array<string>>"


def _hit(line: Column, rule: Rule, possible: Column) -> Column:
    """A struct where the rule finds something in the line of a file that it is possible in, else null."""
    condition = possible
    if rule.keywords:
        condition = condition & _any([_has(line, k) for k in rule.keywords])
    if rule.patterns:
        condition = condition & _any([line.rlike(p) for p in rule.flagged])
    found = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.token).cast("string").alias("token"), _matches(line, rule).alias("matches"))
    return F.when(condition, found)


def hunt(files: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, exclude: Sequence[str] = ()) -> DataFrame:
    """rule, token, path, line_number (from 1), excerpt and matches of every hit in files (path, text).

    Files are read and split into lines once for all rules, whose patterns are
    literals that compile once; a file that no rule's keywords are in is filtered
    before that. Files whose path fits an exclude glob take no part.
    """
    for glob in exclude:
        files = files.where(~F.col("path").rlike(glob_from_right(glob)))
    possible = {r.name: _all([_has(F.col("text"), k) for k in r.keywords]) for r in rules}
    rows = files.where(_any(list(possible.values())))
    flags = {name: f"_possible{k}" for k, name in enumerate(possible)}
    rows = rows.select("path", *(c.alias(flags[n]) for n, c in possible.items()), F.posexplode(lines(F.col("text"))).alias("at", "line"))
    hits = F.filter(F.array(*(_hit(F.col("line"), r, F.col(flags[r.name])) for r in rules)).cast(f"array<{HIT}>"), lambda x: x.isNotNull())
    rows = rows.select("path", (F.col("at") + 1).cast("bigint").alias("line_number"), strip(F.col("line")).alias("excerpt"), F.inline(hits))
    return rows.select("rule", "token", "path", "line_number", "excerpt", "matches")


def with_excerpt(hits: DataFrame, text: str | None) -> DataFrame:
    """Hits whose excerpt holds a text, whatever the case; all of them without a text."""
    return hits.where(_has(F.col("excerpt"), text)) if text else hits


def relative_paths(hits: DataFrame, root: str | None = None) -> DataFrame:
    """hits with relative_path: the given one, else the path below root, else its last component."""
    under = (root or "").rstrip("/") + "/"
    last = F.element_at(F.split("path", "/"), -1)
    below = F.when(F.startswith("path", F.lit(under)), F.substring(F.col("path"), len(under) + 1, 1 << 30)).otherwise(last) if root else last
    given = F.nullif(F.col("relative_path"), F.lit("")) if "relative_path" in hits.columns else F.lit(None).cast("string")
    return hits.withColumn("relative_path", F.coalesce(given, F.when(F.col("path") != "", below)))


def plan_transforms(hits: DataFrame, template: str = "{{{{ {token} }}}}") -> DataFrame:
    """token, value, placeholder, rule, path, line_number and excerpt of hits whose rule has a token.

    The value is the first match that looks like an address or path, else the
    first match, else the excerpt; repeats of (token, value, path, line) keep the
    first by rule.
    """
    before, after = template.format(token="\0").split("\0")
    matches = F.col("matches")
    value = F.coalesce(F.try_element_at(F.filter(matches, lambda x: x.rlike(r"[.:/\\]")), F.lit(1)), F.try_element_at(matches, F.lit(1)), F.col("excerpt"))
    rows = hits.where(F.col("token").isNotNull()).withColumn("value", value).withColumn("placeholder", F.concat(F.lit(before), "token", F.lit(after)))
    first = Window.partitionBy("token", "value", "path", "line_number").orderBy("rule")
    kept = rows.withColumn("n", F.row_number().over(first)).where("n = 1")
    return kept.select("token", "value", "placeholder", "rule", "path", "line_number", "excerpt")


def candidates(transforms: DataFrame) -> DataFrame:
    """Transforms with excerpt_hash, one for each (token, placeholder, excerpt_hash, path): that of the first line."""
    rows = transforms.withColumn("excerpt_hash", digest(F.col("excerpt")))
    first = Window.partitionBy("token", "placeholder", "excerpt_hash", "path").orderBy("line_number", "rule", "value")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def token_counts(hits: DataFrame) -> DataFrame:
    """Hits by token; those without a token are counted as unexpected."""
    return hits.groupBy(F.coalesce("token", F.lit("unexpected")).alias("token")).agg(F.count("*").alias("hits"))
