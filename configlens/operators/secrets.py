"""Secret scanning of lines: rules in order, the first one that isn't cancelled wins."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines, strip

PLACEHOLDER = "[SECRET]"


@dataclass(frozen=True)
class SecretRule:
    """A named pattern."""

    name: str
    pattern: str


#: The sample rules and their version (fixed values).
SAMPLE_VERSION = "2024-06-01"
SAMPLE_RULES = (
    SecretRule("PasswordAssignment", r"""(?i)password\s*[:=]\s*['"]?[A-Za-z0-9\-_/+=]{8,}"""),
    SecretRule("GenericApiToken", r"""(?i)(api|auth|token)[-_ ]?(key|token)\s*[:=]\s*['"]?[A-Za-z0-9]{16,}"""),
    SecretRule("AwsAccessKeyId", r"AKIA[0-9A-Z]{16}"),
)


def compile_rules(rules: object) -> tuple[SecretRule, ...] | None:
    """Rules of mappings with name, pattern and flags; incomplete and invalid ones are left out, no list gives None."""
    if not isinstance(rules, (list, tuple)):
        return None
    out = []
    for rule in rules:
        name, pattern = str(rule.get("name") or "").strip(), rule.get("pattern")
        if not name or not pattern:
            continue
        pattern = f"(?i){pattern}" if "i" in str(rule.get("flags") or "") else pattern
        try:
            re.compile(pattern)
        except re.error:
            continue
        out.append(SecretRule(name, pattern))
    return tuple(out)


def option_list(value: object) -> tuple[str, ...]:
    """Entries of an option: a text split at blanks, commas and semicolons, or a list's trimmed texts."""
    if isinstance(value, str):
        return tuple(x for x in re.split(r"[\s,;]+", value) if x)
    if isinstance(value, (list, tuple)):
        return tuple(str(x).strip() for x in value if x is not None and str(x).strip())
    return ()


@dataclass(frozen=True)
class SecretSettings:
    """What a scan looks for and what it lets pass."""

    rules: tuple[SecretRule, ...]
    ignore_rules: tuple[str, ...] = ()
    ignore_patterns: tuple[str, ...] = ()
    version: str = "unknown"


def settings(options: Mapping | None = None, scanner: Mapping | None = None, embedded: Mapping | None = None) -> SecretSettings:
    """The settings of a job: a ruleset inline in its scanner beats the embedded one, which is the sample rules if none is given.

    A ruleset is a mapping with version and rules; one whose rules are no list
    is none. Rules and patterns to ignore are those of the options
    (secret_ignore_rules, secret_ignore_patterns), then those of the scanner
    (ignore_rules, ignore_patterns), each once; patterns that don't compile are
    left out. Without any rule nothing is found.
    """
    options, scanner = options or {}, scanner or {}

    def merged(key: str) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*option_list(options.get(f"secret_{key}")), *option_list(scanner.get(key)))))

    def compiles(pattern: str) -> bool:
        try:
            return bool(re.compile(pattern))
        except re.error:
            return False

    rules, version = SAMPLE_RULES, SAMPLE_VERSION
    for ruleset in (scanner.get("ruleset"), embedded):
        found = compile_rules(ruleset.get("rules")) if isinstance(ruleset, Mapping) else None
        if found is not None:
            rules, version = found, str(ruleset.get("version") or "unknown")
            break
    return SecretSettings(rules, merged("ignore_rules"), tuple(filter(compiles, merged("ignore_patterns"))), version)


def is_binary(content: Column) -> Column:
    """Whether the first 1024 bytes hold a zero byte."""
    return F.regexp_count(F.hex(F.substring(content, 1, 1024)), F.lit("^(..)*?00")) > 0


def _rule_of(line: Column, rules: Sequence[SecretRule], ignored: Sequence[str]) -> Column:
    found = F.lit(None).cast("string")
    cancelled = F.lit(False)
    for pattern in ignored:
        cancelled = cancelled | line.rlike(pattern)
    for rule in reversed(rules):
        # A match has to have characters, else replacing it would change nothing.
        hit = line.rlike(rule.pattern) & (F.length(F.regexp_extract(line, rule.pattern, 0)) > 0) & ~cancelled
        found = F.when(hit, F.lit(rule.name)).otherwise(found)
    return found


def _redacted(line: Column, rule: Column, rules: Sequence[SecretRule]) -> Column:
    out = line
    for r in rules:
        match = F.regexp_extract(line, r.pattern, 0)
        at = F.instr(line, match)
        once = F.concat(F.substring(line, F.lit(1), at - 1), F.lit(PLACEHOLDER), F.substring(line, at + F.length(match), F.length(line)))
        out = F.when(rule == r.name, once).otherwise(out)
    return out


def scan(files: DataFrame, rules: Sequence[SecretRule] = SAMPLE_RULES, ignore_rules: Sequence[str] = (), ignore_patterns: Sequence[str] = ()) -> DataFrame:
    """path, line_number, rule and snippet of each line of files (path, text) that a rule finds; one finding per line."""
    used = [r for r in rules if r.name not in set(ignore_rules)]
    rows = files.select("path", F.posexplode(lines(F.col("text"))).alias("at", "line"))
    rows = rows.withColumn("rule", _rule_of(F.col("line"), used, ignore_patterns)).where("rule IS NOT NULL")
    snippet = F.left(strip(_redacted(F.col("line"), F.col("rule"), used)), F.lit(200))
    return rows.select("path", (F.col("at") + 1).cast("bigint").alias("line_number"), "rule", snippet.alias("snippet"))


def sanitise(files: DataFrame, rules: Sequence[SecretRule] = SAMPLE_RULES, ignore_rules: Sequence[str] = (), ignore_patterns: Sequence[str] = ()) -> DataFrame:
    """files with text whose found matches are replaced, line by line; other lines stay as they are."""
    used = [r for r in rules if r.name not in set(ignore_rules)]
    clean = F.transform(lines(F.col("text")), lambda x: F.coalesce(_redacted(x, _rule_of(x, used, ignore_patterns), used), x))
    return files.withColumn("text", F.array_join(clean, "\n"))


def paths_with_secrets(files: DataFrame, findings: DataFrame) -> DataFrame:
    """files with has_secrets."""
    found = findings.select("path", F.lit(True).alias("has_secrets")).distinct()
    return files.join(found, "path", "left").withColumn("has_secrets", F.coalesce("has_secrets", F.lit(False)))
