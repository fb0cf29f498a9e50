"""All queries of the engine's own operators and their SQL, by name.

The tables hold no configuration files, so each query runs an operator on what
comes closest: documents are files, nations are hosts, brands are configurations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import digest, line_count, mask_hash, redact
from ..operators import approvals, budget, compare, diffs, hosts, hunt, profiles, schedule, secrets, snapshots, summary, telemetry
from ..streaming import events as streams
from . import config_files, records, walks  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES, query
from .registry import read as _read

#: Rules that fit the tables; the default ones find nothing in them.
RULES = (
    hunt.Rule("access-token", "access_token", ("token",), (r"""token = "([0-9a-f]{40})\"""",)),
    hunt.Rule("ip-address", "ip_address", (), (r"\b\d{1,3}(?:\.\d{1,3}){3}\b",)),
    hunt.Rule("email", None, ("mail", "@"), (r"[a-z0-9.]+@[a-z0-9.]+\.com",)),
    hunt.Rule("license", "license", ("licensed",), ()),
)
SECRET_RULES = (
    secrets.SecretRule("AccessToken", r"token = .[0-9a-f]{40}"),
    secrets.SecretRule("IpAddress", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    secrets.SecretRule("Email", r"[a-z0-9.]+@[a-z0-9.]+\.com"),
)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")


#: Documents as lines in SQL. Their texts hold no line break but the line feed.
_LINES = r"""
files AS (SELECT doc_id::VARCHAR AS path, text, lower(text) AS low FROM documents),
lines AS (
  SELECT path, low, i AS line_number, l[i] AS line FROM (SELECT path, low, string_split(text, chr(10)) AS l FROM files), range(1, len(l) + 1) t(i)
  WHERE NOT (i = len(l) AND l[i] = '')
)"""
_HITS = rf"""
{_LINES.strip()},
hits AS (
  SELECT 'access-token' AS rule, 'access_token' AS token, path, line_number, trim(line) AS excerpt, list_distinct_ordered FROM (
    SELECT *, [regexp_extract(line, 'token = "([0-9a-f]{{40}})"', 1), regexp_extract(line, 'token = "([0-9a-f]{{40}})"', 0)] AS list_distinct_ordered FROM lines
    WHERE contains(low, 'token') AND contains(lower(line), 'token') AND regexp_matches(line, '(?i)token = "([0-9a-f]{{40}})"'))
  UNION ALL
  SELECT 'ip-address', 'ip_address', path, line_number, trim(line), regexp_extract_all(line, '\b\d{{1,3}}(?:\.\d{{1,3}}){{3}}\b') FROM lines WHERE regexp_matches(line, '\b\d{{1,3}}(?:\.\d{{1,3}}){{3}}\b')
  UNION ALL
  SELECT 'email', NULL, path, line_number, trim(line), regexp_extract_all(line, '(?i)[a-z0-9.]+@[a-z0-9.]+\.com') FROM lines
    WHERE contains(low, 'mail') AND contains(low, '@') AND (contains(lower(line), 'mail') OR contains(line, '@')) AND regexp_matches(line, '(?i)[a-z0-9.]+@[a-z0-9.]+\.com')
  UNION ALL
  SELECT 'license', 'license', path, line_number, trim(line), [trim(line)] FROM lines WHERE contains(low, 'licensed') AND contains(lower(line), 'licensed')
)"""


@query(f"WITH {_HITS} SELECT rule, token, path, line_number, excerpt, array_to_string(list_filter(list_distinct_ordered, lambda x, i: list_position(list_distinct_ordered, x) = i), '|') AS matches FROM hits")
def hunt_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that rules find, with what matched."""
    return hunt.hunt(_files(spark, sf_dir), RULES).withColumn("matches", F.array_join("matches", "|"))


@query(f"WITH {_HITS} SELECT rule, path, line_number FROM hits WHERE contains(lower(excerpt), 'licensed')")
def hunt_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits whose excerpt holds a text, whatever the case."""
    return hunt.with_excerpt(hunt.hunt(_files(spark, sf_dir), RULES), "LICENSED").select("rule", "path", "line_number")


@query(f"WITH {_HITS} SELECT coalesce(token, 'unexpected') AS token, count(*)::BIGINT AS hits FROM hits GROUP BY 1")
def hunt_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by token."""
    return hunt.token_counts(hunt.hunt(_files(spark, sf_dir), RULES))


_TRANSFORMS = f"""WITH {_HITS}, valued AS (
  SELECT *, coalesce(list_filter(list_distinct_ordered, lambda x: regexp_matches(x, '[.:/\\\\]'))[1], list_distinct_ordered[1], excerpt) AS value FROM hits WHERE token IS NOT NULL),
transforms AS (SELECT token, value, '{{{{ ' || token || ' }}}}' AS placeholder, rule, path, line_number, excerpt FROM valued
  QUALIFY row_number() OVER (PARTITION BY token, value, path, line_number ORDER BY rule) = 1),
candidates AS (SELECT *, CASE WHEN excerpt <> '' THEN sha256(excerpt) END AS excerpt_hash FROM transforms
  QUALIFY row_number() OVER (PARTITION BY token, placeholder, excerpt_hash, path ORDER BY line_number, rule, value) = 1)"""


def _transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hunt.plan_transforms(hunt.hunt(_files(spark, sf_dir), RULES))


@query(_TRANSFORMS + " SELECT * FROM transforms")
def hunt_plan_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values to replace by placeholders."""
    return _transforms(spark, sf_dir)


def _approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of even documents are approved."""
    rows = hunt.candidates(_transforms(spark, sf_dir)).where(F.col("path").cast("bigint") % 2 == 0)
    return rows.select("token", "placeholder", "excerpt_hash").distinct()


_APPROVED = _TRANSFORMS + ", approvals AS (SELECT DISTINCT token, placeholder, excerpt_hash FROM candidates WHERE path::BIGINT % 2 = 0)"
_EQUAL = "a.token IS NOT DISTINCT FROM c.token AND a.placeholder IS NOT DISTINCT FROM c.placeholder AND a.excerpt_hash IS NOT DISTINCT FROM c.excerpt_hash"


@query(f"{_APPROVED} SELECT token, path, excerpt_hash FROM candidates c WHERE EXISTS (SELECT 1 FROM approvals a WHERE {_EQUAL})")
def approvals_approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with an approval."""
    return approvals.approved(hunt.candidates(_transforms(spark, sf_dir)), _approvals(spark, sf_dir)).select("token", "path", "excerpt_hash")


@query(f"{_APPROVED} SELECT token, path, excerpt_hash FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM approvals a WHERE {_EQUAL})")
def approvals_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates without one."""
    return approvals.pending(hunt.candidates(_transforms(spark, sf_dir)), _approvals(spark, sf_dir)).select("token", "path", "excerpt_hash")


@query("""SELECT c_custkey, 'sha256:' || sha256('customer.c_name:pepper' || '"' || c_name || '"') AS c_name, '[MASK]' AS c_mktsegment,
  'sha256:' || sha256('customer.c_nationkey:pepper' || c_nationkey::VARCHAR) AS c_nationkey, c_acctbal FROM customer""")
def snapshot_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with hashed and masked columns."""
    table = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal")
    return snapshots.snapshot(table, "customer", ["c_mktsegment"], ["c_name", "c_nationkey"], "pepper", "[MASK]")


@query("""SELECT 'nation' AS "table", count(*)::BIGINT AS row_count, '' AS masked, 'n_name' AS hashed FROM nation
UNION ALL SELECT 'supplier', count(*), 's_acctbal', '' FROM supplier""")
def snapshot_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a snapshot holds."""
    tables = {n: _read(spark, sf_dir, n) for n in ("nation", "supplier")}
    return snapshots.manifest(tables, {"supplier": ["s_acctbal"]}, {"nation": ["n_name"]})


@query("""SELECT s_suppkey, s_name, s_nationkey FROM supplier ORDER BY s_suppkey LIMIT 25""")
def snapshot_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a table by its key: the feature is the limit."""
    return snapshots.snapshot(_read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "supplier", limit=25, order=["s_suppkey"])


@query("""WITH a AS (SELECT doc_id, text, replace(text, 'the ', '[X]') AS t1 FROM documents),
b AS (SELECT *, replace(t1, 'the', '[X]') AS t2 FROM a), c AS (SELECT *, replace(t2, 'of', '[X]') AS t3 FROM b)
SELECT doc_id, sha256(t3) AS redacted_sha256, ((length(text) - length(replace(text, 'the ', ''))) // 4)::BIGINT AS n_the_blank,
  ((length(t1) - length(replace(t1, 'the', ''))) // 3)::BIGINT AS n_the, ((length(t2) - length(replace(t2, 'of', ''))) // 2)::BIGINT AS n_of FROM c""")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens replaced, longest first, with counts on what is left."""
    text, counts = redact(F.col("text"), ["of", "the", "the "], "[X]")
    return _read(spark, sf_dir, "documents").select("doc_id", F.sha2(text.cast("binary"), 256).alias("redacted_sha256"), counts["the "].alias("n_the_blank"), counts["the"].alias("n_the"), counts["of"].alias("n_of"))


_STORE = [
    ("site", [], [("all-french", None, "http://*/fr/*", None), ("exact", "http://blog.ththan.example.net/en/960", None, None)]),
    ("prod", ["prod"], [("https-only", None, "https:*", "web"), ("everything", None, None, None)]),
    ("stage", ["stage"], [("never", None, "*", None)]),
]


def _store(spark: SparkSession) -> DataFrame:
    rows = [(n, t, [(i, p, g, a, None, None, [], None, None, False) for i, p, g, a in c]) for n, t, c in _STORE]
    return spark.createDataFrame(rows, f"name string, tags array<string>, configs array<{profiles.CONFIG_TYPE}>")


_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(url, '/+', '/', 'g'), '(^|/)(\./)+', '\1', 'g'), '(.)/\.?$', '\1')"


@query(rf"""WITH p AS (SELECT page_id, {_NORMAL} AS path FROM pages)
SELECT page_id, 'site' AS profile, 'all-french' AS config_id FROM p WHERE regexp_matches(path, '(?s)^http:/.*/fr/.*$')
UNION ALL SELECT page_id, 'prod', 'https-only' FROM p WHERE regexp_matches(path, '(?s)^https:.*$')
UNION ALL SELECT page_id, 'prod', 'everything' FROM p""")
def profile_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the profile configurations that apply to their paths."""
    store = _store(spark).withColumn("configs", F.expr("transform(configs, c -> named_struct('id', c.id, 'path', c.path, 'path_glob', replace(c.path_glob, '//', '/'), 'application', c.application, 'version', c.version, 'branch', c.branch, 'tags', c.tags, 'expected_format', c.expected_format, 'expected_variant', c.expected_variant, 'ignore_review_flags', c.ignore_review_flags))"))
    given = profiles.provided(["prod", "application:web"])
    files = _read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("relative_path"))
    return profiles.matching(files, store, given).select("page_id", "profile", "config_id")


@query("""WITH a AS (SELECT o_custkey AS k, sum(o_totalprice)::DECIMAL(18,2) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1),
b AS (SELECT o_custkey AS k, sum(o_totalprice)::DECIMAL(18,2) AS v FROM orders GROUP BY 1)
SELECT coalesce(a.k, b.k) AS custkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.k = b.k""")
def snapshot_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose orders changed between two snapshots."""
    orders = _read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "custkey")
    total = lambda df: df.groupBy("custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return compare.compare(total(orders.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))), total(orders), ["custkey"], F.col("v"))


#: What a host has of a configuration: a coarse figure of its parts' lines, so that some hosts agree.
_CELLS = """cells AS (SELECT s_nationkey::VARCHAR AS host_id, p_brand AS config_id, ((count(*) FILTER (l_returnflag = 'R')) * 3 // count(*))::VARCHAR AS canonical
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE NOT (s_nationkey % 5 = 2 AND p_brand LIKE '%3') GROUP BY 1, 2),
compared AS (SELECT *, first_value(canonical) OVER (PARTITION BY config_id ORDER BY host_id <> '7', host_id) AS base,
  (CASE WHEN canonical <> first_value(canonical) OVER (PARTITION BY config_id ORDER BY host_id <> '7', host_id) THEN 1 ELSE 0 END)::BIGINT AS drift_lines FROM cells),
hosts AS (SELECT n_nationkey::VARCHAR AS host_id, CASE WHEN n_nationkey = 3 THEN 'permission_denied' WHEN n_nationkey = 4 THEN 'not_found' ELSE 'ok' END AS availability FROM nation)"""
_CATALOG = f"""WITH {_CELLS}, total AS (SELECT count(*)::BIGINT AS total_hosts FROM hosts),
by_config AS (SELECT config_id, count(DISTINCT host_id)::BIGINT AS present_hosts, (count(*) FILTER (drift_lines > 0))::BIGINT AS drift_count, sum(drift_lines)::BIGINT AS drift_lines FROM compared GROUP BY 1),
catalog AS (SELECT *, CASE WHEN present_hosts = 0 THEN 'missing' WHEN present_hosts >= total_hosts THEN 'full' ELSE 'partial' END AS coverage,
  CASE WHEN drift_count >= greatest(1, total_hosts // 2) THEN 'high' WHEN drift_count > 0 THEN 'medium' ELSE 'none' END AS severity, total_hosts - present_hosts AS missing_hosts FROM by_config, total)"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    suppliers = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    parts = _read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    joined = joined.where(~((F.col("s_nationkey") % 5 == 2) & F.col("p_brand").endswith("3")))
    cells = joined.groupBy(F.col("s_nationkey").cast("string").alias("host_id"), F.col("p_brand").alias("config_id"))
    cells = cells.agg(F.floor(F.count_if(F.col("l_returnflag") == "R") * 3 / F.count("*")).cast("string").alias("canonical"))
    rows = hosts.against_baseline(cells, "7")
    return rows.withColumn("drift_lines", F.when(F.col("canonical") != F.col("baseline_canonical"), 1).otherwise(0).cast("bigint"))


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    available = F.when(key == 3, "permission_denied").when(key == 4, "not_found").otherwise("ok")
    return _read(spark, sf_dir, "nation").select(key.cast("string").alias("host_id"), available.alias("availability"))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.catalog(_compared(spark, sf_dir), _hosts(spark, sf_dir))


@query(f"{_CATALOG} SELECT config_id, present_hosts, drift_count, drift_lines, total_hosts, coverage, severity, missing_hosts FROM catalog")
def host_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each configuration's coverage, drift and severity across hosts."""
    return _catalog(spark, sf_dir)


@query(f"""WITH {_CELLS} SELECT h.host_id, c.config_id, CASE WHEN availability = 'permission_denied' THEN 'permission denied' WHEN availability <> 'ok' THEN 'offline'
  WHEN x.host_id IS NULL THEN 'missing' WHEN x.drift_lines > 0 THEN 'drift' ELSE 'match' END AS status
FROM (SELECT DISTINCT config_id FROM compared) c CROSS JOIN hosts h LEFT JOIN compared x ON x.host_id = h.host_id AND x.config_id = c.config_id""")
def host_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each host's status for each configuration."""
    return hosts.server_status(_compared(spark, sf_dir), _hosts(spark, sf_dir))


@query(f"{_CATALOG} SELECT count(*)::BIGINT AS configs_evaluated, (count(*) FILTER (drift_count > 0))::BIGINT AS drifting_configs, max(total_hosts)::BIGINT AS total_hosts FROM catalog")
def host_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a run over hosts."""
    return hosts.run_summary(_catalog(spark, sf_dir))


@query(f"{_CATALOG} SELECT config_id, severity, coverage FROM catalog WHERE contains(lower(config_id), 'brand#2') AND coverage = 'partial'")
def host_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows that fit a search and a coverage."""
    return hosts.grid(_catalog(spark, sf_dir), search="Brand#2", coverage="partial").select("config_id", "severity", "coverage")


@query("""WITH plans AS (SELECT n_nationkey AS plan_order, n_name AS host_id, n_regionkey = 2 AS is_preferred, n_nationkey % 4 AS priority FROM nation)
SELECT host_id FROM plans ORDER BY is_preferred DESC, priority DESC, plan_order LIMIT 1""")
def host_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host that others are compared with."""
    plans = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("plan_order"), F.col("n_name").alias("host_id"), (F.col("n_regionkey") == 2).alias("is_preferred"), (F.col("n_nationkey") % 4).alias("priority"))
    return hosts.baseline_host(plans).select("host_id")


@query("""WITH t AS (SELECT doc_id, least(n_chars, 2000) AS taken, coalesce(sum(least(n_chars, 2000)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT doc_id, least(taken, 1000000 - before)::BIGINT AS sample_bytes FROM t WHERE before < 1000000""")
def sample_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a reader with a budget still reads: the budget is the feature."""
    return budget.within_budget(_read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 2000, 1_000_000).select("doc_id", "sample_bytes")


@query("""WITH t AS (SELECT source, doc_id, least(n_chars, 2000) AS taken, coalesce(sum(least(n_chars, 2000)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT source, doc_id, least(taken, 30000 - before)::BIGINT AS sample_bytes FROM t WHERE before < 30000""")
def sample_budget_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a budget for each source."""
    rows = _read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return budget.within_budget(rows, "doc_id", "n_chars", 2000, 30_000, ["source"]).select("source", "doc_id", "sample_bytes")


@query("""SELECT doc_id, text_digest FROM (SELECT doc_id, sha256(text) AS text_digest FROM documents) QUALIFY row_number() OVER (PARTITION BY text_digest ORDER BY doc_id DESC) = 1""")
def dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal texts the last one."""
    rows = _read(spark, sf_dir, "documents").select("doc_id", digest(F.col("text")).alias("text_digest"))
    return compare.first_wins(rows, ["text_digest"], F.desc("doc_id"))


@query("""WITH d AS (SELECT lang AS format, source AS variant, least(1.0, n_chars / 10000.0)::DOUBLE AS confidence, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS reason FROM documents),
per AS (SELECT format, variant, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons FROM d GROUP BY 1, 2)
SELECT CASE grouping(r.format, r.variant) WHEN 0 THEN 'variant' WHEN 1 THEN 'format' ELSE 'all' END AS level, r.format, r.variant, count(*)::BIGINT AS detections, max(confidence) AS max_confidence,
  CASE WHEN grouping(r.format, r.variant) = 0 THEN (SELECT reasons FROM per WHERE per.format = r.format AND per.variant = r.variant) END AS reasons FROM d r GROUP BY ROLLUP (r.format, r.variant)""")
def detection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections by variant, format and over all."""
    size = F.col("n_chars")
    rows = _read(spark, sf_dir, "documents").select(F.col("lang").alias("format"), F.col("source").alias("variant"), F.least(F.lit(1.0), size / 10000).alias("confidence"), F.array(F.when(size > 2000, "long").otherwise("short")).alias("reasons"))
    return summary.detection_summary(rows).withColumn("reasons", F.array_join("reasons", ","))


_TELEMETRY = """s AS (SELECT user_id, count(*)::BIGINT AS total_runs, (count(*) FILTER (event_type = 'error'))::BIGINT AS failures, max(ts) AS last_updated FROM events GROUP BY 1),
e AS (SELECT *, failures / total_runs AS failure_rate FROM s),
i AS (SELECT user_id::VARCHAR AS name, total_runs, failures, round(failure_rate, 6) AS failure_rate, list_filter([CASE WHEN total_runs < 10 THEN 'too few runs' END,
  CASE WHEN failure_rate > 0.2 THEN 'failure rate' END, CASE WHEN failures % 2 = 1 THEN 'last status' END], lambda x: x IS NOT NULL) AS issues FROM e)"""


def _telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("total_runs"), F.count_if(F.col("event_type") == "error").alias("failures"))
    rows = rows.select(F.col("user_id").cast("string").alias("name"), "total_runs", "failures", F.when(F.col("failures") % 2 == 1, "fail").otherwise("pass").alias("last_status"))
    return telemetry.evaluate(rows, 0.2, 10)


@query(f"WITH {_TELEMETRY} SELECT name, total_runs, failures, failure_rate, array_to_string(issues, ',') AS issues, CASE WHEN len(issues) > 0 THEN 'issue' ELSE 'ok' END AS status FROM i")
def telemetry_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios with their issues."""
    return _telemetry(spark, sf_dir).select("name", "total_runs", "failures", F.round("failure_rate", 6).alias("failure_rate"), F.array_join("issues", ",").alias("issues"), "status")


@query(f"WITH {_TELEMETRY} SELECT issue, count(*)::BIGINT AS scenarios FROM (SELECT unnest(issues) AS issue FROM i) GROUP BY 1")
def telemetry_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios by issue."""
    return telemetry.issue_summary(_telemetry(spark, sf_dir)).select("issue", "scenarios")


@query("""SELECT DISTINCT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def missing_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required ids that weren't observed."""
    name = lambda df: df.select(F.col("doc_id").cast("string").alias("name"))
    found = telemetry.missing_scenarios(name(_read(spark, sf_dir, "documents")), name(_read(spark, sf_dir, "labels")))
    return found.select(F.col("name").cast("bigint").alias("doc_id")).distinct()


_SECRETS = rf"""WITH {_LINES.strip()}, found AS (SELECT path, line_number, line, CASE WHEN regexp_matches(line, 'licensed') THEN NULL WHEN regexp_matches(line, 'token = .[0-9a-f]{{40}}') THEN 'AccessToken'
  WHEN regexp_matches(line, '[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}') THEN 'IpAddress' WHEN regexp_matches(line, '[a-z0-9.]+@[a-z0-9.]+\.com') THEN 'Email' END AS rule FROM lines)"""


@query(rf"""{_SECRETS} SELECT path, line_number::BIGINT AS line_number, rule, substr(trim(CASE rule WHEN 'AccessToken' THEN regexp_replace(line, 'token = .[0-9a-f]{{40}}', '[SECRET]')
  WHEN 'IpAddress' THEN regexp_replace(line, '[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}', '[SECRET]') ELSE regexp_replace(line, '[a-z0-9.]+@[a-z0-9.]+\.com', '[SECRET]') END), 1, 200) AS snippet FROM found WHERE rule IS NOT NULL""")
def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with secrets, the first rule that fits."""
    return secrets.scan(_files(spark, sf_dir), SECRET_RULES, ignore_patterns=["licensed"])


@query(r"""WITH """ + _LINES.strip() + r""", found AS (SELECT path, line_number, line, CASE WHEN regexp_matches(line, 'licensed') OR regexp_matches(line, '\.example') THEN NULL
  WHEN regexp_matches(line, '(?i)token = .[0-9a-f]{40}') THEN 'AccessToken' WHEN regexp_matches(line, '[a-z0-9.]+@[a-z0-9.]+\.com') THEN 'Email' END AS rule FROM lines)
SELECT '7' AS version, rule, count(*)::BIGINT AS lines, count(DISTINCT path)::BIGINT AS files, min(line_number)::BIGINT AS first_line FROM found WHERE rule IS NOT NULL GROUP BY rule""")
def secret_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by rule under a job's settings: an inline ruleset, rules and patterns that options and scanner ignore."""
    flags = {"AccessToken": "i"}
    inline = {"version": 7, "rules": [{"name": r.name, "pattern": r.pattern, "flags": flags.get(r.name)} for r in SECRET_RULES] + [{"name": "Broken", "pattern": "("}]}
    scanner = {"ruleset": inline, "ignore_rules": ["IpAddress"], "ignore_patterns": ["licensed", "[", r"\.example"]}
    used = secrets.settings({"secret_ignore_rules": "Other; IpAddress", "secret_ignore_patterns": "licensed"}, scanner, {"rules": [{"name": "Never", "pattern": "e"}]})
    found = secrets.scan(_files(spark, sf_dir), used.rules, used.ignore_rules, used.ignore_patterns)
    return found.groupBy(F.lit(used.version).alias("version"), "rule").agg(F.count("*").alias("lines"), F.countDistinct("path").alias("files"), F.min("line_number").alias("first_line"))


@query(f"{_SECRETS} SELECT f.path, bool_or(rule IS NOT NULL) AS has_secrets FROM files f LEFT JOIN found USING (path) GROUP BY 1")
def secret_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with whether they hold secrets."""
    files = _files(spark, sf_dir)
    return secrets.paths_with_secrets(files, secrets.scan(files, SECRET_RULES, ignore_patterns=["licensed"])).select("path", "has_secrets")


@query("""WITH p AS (SELECT doc_id, text AS a, replace(text, 'the', 'THE') AS b FROM documents)
SELECT doc_id, sha256(a) AS before_digest, sha256(b) AS after_digest, sha256(a || chr(10) || '---' || chr(10) || b) AS diff_digest,
  (len(string_split(a, chr(10))) - CASE WHEN a = '' OR a LIKE '%' || chr(10) THEN 1 ELSE 0 END)::BIGINT AS before_lines,
  (len(string_split(b, chr(10))) - CASE WHEN b = '' OR b LIKE '%' || chr(10) THEN 1 ELSE 0 END)::BIGINT AS after_lines, a = b AS identical FROM p""")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and line counts of texts before and after an edit."""
    before, after = F.col("text"), F.replace(F.col("text"), F.lit("the"), F.lit("THE"))
    return _read(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in diffs.diff_summary(before, after).items()))


@query("""SELECT page_id, strlen(html)::BIGINT AS before_size, strlen(url)::BIGINT AS after_size, (strlen(url) - strlen(html))::BIGINT AS delta, sha256(html) AS before_sha256, sha256(url) AS after_sha256, html = url AS identical FROM pages""")
def binary_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and digests of pairs of binary values."""
    cells = diffs.binary_diff(F.col("html").cast("binary"), F.col("url").cast("binary"))
    return _read(spark, sf_dir, "pages").select("page_id", *(c.alias(n) for n, c in cells.items()))


@query("""SELECT event_id, user_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) > 5 THEN 'count' WHEN ts < TIMESTAMP '2024-01-10' THEN 'age' END AS drop_reason FROM events""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with why retention drops them."""
    rows = compare.keep_newest(_read(spark, sf_dir, "events"), ["user_id"], "ts", 5, F.lit("2024-01-10").cast("timestamp_ntz"), "event_id")
    return rows.select("event_id", "user_id", "drop_reason")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and type."""
    return streams.tumbling(_read(spark, sf_dir, "events"), "ts", "1 hour", F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), by=("event_type",))


@query("""SELECT w AS window_start, count(*)::BIGINT AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts - INTERVAL 30 MINUTE) + INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour, every half hour."""
    return streams.sliding(_read(spark, sf_dir, "events"), "ts", "1 hour", "30 minutes", F.count("*").alias("n"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users."""
    return streams.sessions(_read(spark, sf_dir, "events"), "ts", "30 minutes", ("user_id",), F.count("*").alias("n"))


@query("""WITH r AS (SELECT event_id, ts + INTERVAL 90 MINUTE AS t FROM events), s AS (SELECT *, extract(hour FROM t) * 3600 + extract(minute FROM t) * 60 + floor(extract(second FROM t)) AS day_second FROM r)
SELECT event_id, CASE WHEN day_second >= 79200 OR day_second <= 7200 THEN t ELSE date_trunc('day', t) + INTERVAL 22 HOUR END AS next_run FROM s""")
def schedule_next_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next run after each completion, every 90 minutes between 22:00 and 02:00."""
    every = F.lit(schedule.interval_seconds("1h30m"))
    start, end = (F.lit(schedule.seconds_of_day(t)) for t in ("22:00", "02:00"))
    return _read(spark, sf_dir, "events").select("event_id", schedule.next_run(F.col("ts"), every, start, end).alias("next_run"))


@query("""SELECT n_nationkey AS nationkey, CASE WHEN c.k IS NOT NULL AND s.k IS NOT NULL THEN 'both' WHEN c.k IS NOT NULL THEN 'customers' WHEN s.k IS NOT NULL THEN 'suppliers' ELSE 'none' END AS held
FROM nation LEFT JOIN (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000) c ON c.k = n_nationkey LEFT JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier) s ON s.k = n_nationkey""")
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in one, both or neither of two key sets."""
    a = _read(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).distinct()
    b = _read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    named = a.intersect(b).withColumn("held", F.lit("both")).union(a.exceptAll(b).withColumn("held", F.lit("customers"))).union(b.exceptAll(a).withColumn("held", F.lit("suppliers")))
    return _read(spark, sf_dir, "nation").join(named, F.col("n_nationkey") == F.col("k"), "left").select(F.col("n_nationkey").alias("nationkey"), F.coalesce("held", F.lit("none")).alias("held"))


@query("""SELECT p_brand AS path, first(canonical ORDER BY hosts DESC, host_id) AS canonical, first(hosts ORDER BY hosts DESC, host_id)::BIGINT AS hosts, first(host_id ORDER BY hosts DESC, host_id) AS host_id FROM
(SELECT p_brand, p_type AS canonical, count(*) AS hosts, min(p_partkey) AS host_id FROM part GROUP BY 1, 2) GROUP BY 1""")
def elected_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent content of each path."""
    texts = _read(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("host_id"), F.col("p_type").alias("canonical"))
    return diffs.elect_baseline(texts)


@query("""SELECT doc_id, (len(string_split(text, chr(10))) - CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 1 ELSE 0 END)::BIGINT AS n_lines FROM documents""")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents."""
    return _read(spark, sf_dir, "documents").select("doc_id", line_count(F.col("text")).alias("n_lines"))


@query()
def line_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line differences between each document and the one before it of the same source; a text that is null is empty."""
    docs = _read(spark, sf_dir, "documents")
    # Only ids pass the window of a source; texts are joined by id.
    before = F.lag("doc_id").over(Window.partitionBy("source").orderBy("doc_id"))
    pairs = docs.select("doc_id", before.alias("before_id")).where("before_id IS NOT NULL")
    texts = docs.select("doc_id", "text")
    pairs = pairs.join(texts.withColumnRenamed("text", "after"), "doc_id").join(texts.select(F.col("doc_id").alias("before_id"), F.col("text").alias("before")), "before_id")
    return diffs.line_diff(pairs).select("doc_id", "added", "removed", "changed", "drift_lines", "truncated")


@query("""WITH RECURSIVE e AS (SELECT (user_id % 50)::VARCHAR AS host_id, event_type AS status, epoch_us(ts) // 1000 AS at_ms, row_number() OVER (PARTITION BY user_id % 50 ORDER BY epoch_us(ts) // 1000, event_type) AS n FROM events),
r AS (SELECT host_id, n, status, at_ms, TRUE AS fresh, status AS last_status, at_ms AS last_ms FROM e WHERE n = 1
  UNION ALL SELECT e.host_id, e.n, e.status, e.at_ms, e.status <> r.last_status OR e.at_ms - r.last_ms >= 3600000,
    CASE WHEN e.status <> r.last_status OR e.at_ms - r.last_ms >= 3600000 THEN e.status ELSE r.last_status END, CASE WHEN e.status <> r.last_status OR e.at_ms - r.last_ms >= 3600000 THEN e.at_ms ELSE r.last_ms END
  FROM r JOIN e ON e.host_id = r.host_id AND e.n = r.n + 1)
SELECT host_id, status, 'm' AS message, at_ms FROM r WHERE fresh""")
def progress_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that a throttle of one hour still emits, by user."""
    rows = _read(spark, sf_dir, "events").select((F.col("user_id") % 50).cast("string").alias("host_id"), F.col("event_type").alias("status"), F.lit("m").alias("message"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return streams.throttle(rows, 3_600_000)
