"""Queries over what scans leave: hits, registries, logs, stores, packages, hosts and reports, and their SQL.

As in config_files, parts, suppliers and the like stand for the records, and the
SQL says from their columns what has to come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_from_right, glob_from_root, redact_json
from ..operators import approvals, budget, diffs, hosts, hunt, package, profiles, registry, schedule, secrets, sinks, telemetry
from ..sources import stores
from .config_files import digit, if_, on
from .registry import query, read

_HEX = "sha1(s_name)"


@query(f"""WITH s AS (SELECT s_suppkey AS k, {_HEX} AS h FROM supplier) SELECT k::VARCHAR AS path, rule, token, n::BIGINT AS line_number, excerpt, matches FROM (
  SELECT k, 'server-name' AS rule, 'server_name' AS token, 1 AS n, 'Server host: srv' || k || '.corp.local' AS excerpt, 'corp|srv' || k || '.corp' AS matches FROM s
  UNION ALL SELECT k, 'version-number', 'version', 2, 'Version 1.' || k || '.0', '1.' || k || '.0' FROM s
  UNION ALL SELECT k, 'install-path', 'install_path', 3, 'install path /opt/app-' || k, '/opt/app-' || k FROM s
  UNION ALL SELECT k, 'feature-flag', 'feature_flag', 4, 'key="NewFeature" value="on"', 'Feature|key="NewFeature" value="on"' FROM s
  UNION ALL SELECT k, 'certificate-thumbprint', 'certificate_thumbprint', 5, 'certificate thumbprint ' || h, h FROM s
  UNION ALL SELECT k, 'connection-string', 'connection_string', 6, 'connectionString = "Db=x"', 'connectionString = "Db=x"' FROM s WHERE k % 2 = 1
  UNION ALL SELECT k, 'service-endpoint', 'service_endpoint', 6, 'BaseAddress="http://x/"', 'BaseAddress|BaseAddress="http://x/"' FROM s WHERE k % 2 = 0)""")
def hunt_default_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default rules over lines with tabs and blanks at their ends."""
    key = F.col("s_suppkey").cast("string")
    parts = [
        F.lit("\tServer host: srv"), key, F.lit(".corp.local\t \r\n Version 1."), key, F.lit(".0\ninstall path /opt/app-"), key, F.lit('\n\t key="NewFeature" value="on"\ncertificate thumbprint '), F.sha1(F.col("s_name").cast("binary")), F.lit("\n"),
        F.when(F.col("s_suppkey") % 2 == 1, '  connectionString = "Db=x"').otherwise('BaseAddress="http://x/"'),
    ]
    files = read(spark, sf_dir, "supplier").select(key.alias("path"), F.concat(*parts).alias("text"))
    return hunt.hunt(files).withColumn("matches", F.array_join("matches", "|"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'given/' || p_partkey WHEN 1 THEN 'a/b.txt' WHEN 2 THEN 'c.txt' ELSE 'rooted.txt' END AS relative_path FROM part""")
def hit_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of hits relative to a root."""
    given = F.when(digit(1, 4) == 0, F.concat(F.lit("given/"), F.col("p_partkey").cast("string"))).when(digit(1, 4) == 1, "")
    path = F.element_at(F.array(*map(F.lit, ("/root/x", "/root/a/b.txt", "/other/c.txt", "/rooted.txt"))), (digit(1, 4) + 1).cast("int"))
    return hunt.relative_paths(read(spark, sf_dir, "part").select("p_partkey", given.alias("relative_path"), path.alias("path")), "/root").select("p_partkey", "relative_path")


_UNINSTALL = "SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Uninstall\\App"


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An uninstall key for each part, of some a second view."""
    key = F.concat(F.lit(_UNINSTALL), F.col("p_partkey").cast("string"))
    hive = if_(digit(1, 3) == 0, "HKCU", "HKLM")
    views = F.explode(F.when(digit(1, 4) == 0, F.array(F.lit("64"), F.lit("32"))).otherwise(F.array(F.lit("64"))))
    rows = read(spark, sf_dir, "part").select("p_partkey", hive.alias("hive"), views.alias("view"), key.alias("key_path"), "p_name", "p_brand")
    name = F.when(digit(1, 5) == 0, " ").otherwise(F.col("p_name"))
    values = F.array(F.struct(F.lit("DisplayName").alias("value_name"), name.alias("data")), F.struct(F.lit("Publisher").alias("value_name"), F.col("p_brand").alias("data")), F.struct(F.lit("DisplayVersion").alias("value_name"), F.concat_ws(".", F.lit("1"), F.col("view")).alias("data")))
    return rows.select("hive", "view", "key_path", F.inline(values))


@query(rf"""SELECT CASE WHEN p_partkey % 3 = 0 THEN 'HKCU' ELSE 'HKLM' END AS hive, '{_UNINSTALL}' || p_partkey AS key_path, p_name AS display_name, p_brand AS publisher, '1.64' AS version FROM part WHERE p_partkey % 5 <> 0""")
def registry_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Installed applications with a name, each key once."""
    return registry.installed_apps(_registry(spark, sf_dir)).select("hive", "key_path", "display_name", "publisher", "version")


@query(r"""WITH apps AS (SELECT p_name AS n, p_brand AS p FROM part WHERE p_partkey % 5 <> 0), t AS (SELECT unnest(['brand#11', 'GEAR']) AS token),
hit AS (SELECT token, n, p FROM t JOIN apps ON contains(lower(n), lower(token)) OR contains(lower(p), lower(token)))
SELECT DISTINCT token, hive, path FROM (SELECT token, 'HKLM' AS hive, 'SOFTWARE\' || p || '\' || n AS path FROM hit UNION ALL SELECT token, 'HKCU', 'SOFTWARE\' || p || '\' || n FROM hit UNION ALL SELECT token, 'HKLM', 'SOFTWARE\' || p FROM hit)""")
def registry_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likely roots of applications by words of their name or publisher."""
    tokens = spark.createDataFrame([("brand#11",), ("GEAR",)], "token string")
    return registry.suggest_roots(tokens, registry.installed_apps(_registry(spark, sf_dir)))


@query(rf"""SELECT key_path, value_name FROM (SELECT '{_UNINSTALL}' || p_partkey AS key_path, view, unnest(['DisplayName', 'Publisher', 'DisplayVersion']) AS value_name FROM
  (SELECT p_partkey, unnest(CASE WHEN p_partkey % 4 = 0 THEN ['64', '32'] ELSE ['64'] END) AS view FROM part WHERE p_partkey % 3 <> 0)) WHERE contains(lower(key_path), 'app1') ORDER BY key_path, value_name, view LIMIT 50""")
def registry_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first values below a root that hold a keyword: the limit is the feature."""
    return registry.search(_registry(spark, sf_dir), [("HKLM", "SOFTWARE\\Microsoft")], keywords=["APP1"], max_hits=50).select("key_path", "value_name")


@query("""SELECT p_partkey::VARCHAR AS path, e::BIGINT AS entry, '2024-01-0' || e || 'T00:00:00Z' AS timestamp, 'Error ' || e AS header, CASE WHEN e = 1 THEN 'at one|at two' ELSE '' END AS stack FROM part, range(1, 4) t(e) WHERE e <= p_partkey % 3 + 1""")
def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of logs with their stacks."""
    text = F.concat(F.lit("no entry\n[2024-01-01T00:00:00Z] Error 1\nat one\r\nat two"), *(if_(digit(1, 3) > k - 2, f"\n[2024-01-0{k}T00:00:00Z]  Error {k}") for k in (2, 3)))
    logs = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), text.alias("text"))
    return telemetry.log_entries(logs).withColumn("stack", F.array_join("stack", "|"))


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("# Transcript \n## Focus\t\nTab moves to "), "p_name", F.lit("\n"), if_(on(1), "## Colour\nhigh contrast"))
    return telemetry.transcript_sections(read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), text.alias("text")))


@query("""SELECT p_partkey::VARCHAR AS path, 'Transcript' AS title, 'Focus' AS section, 'Tab moves to ' || p_name || CASE WHEN p_partkey % 2 = 1 THEN '' ELSE chr(10) END AS body FROM part
UNION ALL SELECT p_partkey::VARCHAR, 'Transcript', 'Colour', 'high contrast' FROM part WHERE p_partkey % 2 = 1""")
def transcript_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of transcripts under their titles."""
    return _transcripts(spark, sf_dir)


@query("""SELECT p_partkey::VARCHAR AS path, 'Focus' AS section, TRUE AS found, 'Escape' AS missing FROM part UNION ALL SELECT p_partkey::VARCHAR, 'Colour', p_partkey % 2 = 1, CASE WHEN p_partkey % 2 = 1 THEN '' ELSE 'CONTRAST' END FROM part""")
def missing_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that sections lack."""
    expected = F.array(F.struct(F.lit("Focus").alias("section"), F.array(F.lit("TAB"), F.lit("Escape")).alias("keywords")), F.struct(F.lit("Colour").alias("section"), F.array(F.lit("CONTRAST")).alias("keywords")))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.inline(expected))
    return telemetry.missing_keywords(rows, _transcripts(spark, sf_dir)).withColumn("missing", F.array_join("missing", ","))


@query("""SELECT event_type AS op, count(*)::BIGINT AS calls, (count(*) FILTER (value > 20))::BIGINT AS ok, (count(*) FILTER (NOT value > 20))::BIGINT AS errors, round(avg(value), 6) AS avg_ms, arg_max(value, event_id) AS last_ms FROM events GROUP BY 1""")
def usage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, errors and milliseconds by operation."""
    calls = read(spark, sf_dir, "events").select(F.col("event_type").alias("op"), (F.col("value") > 20).alias("ok"), F.col("value").alias("ms"), F.col("event_id").alias("at"))
    return telemetry.usage_counters(calls).withColumn("avg_ms", F.round("avg_ms", 6))


@query("""SELECT p_brand AS package, bool_and(p_size > 3) AS is_compliant, coalesce(string_agg(DISTINCT p_type, ',' ORDER BY p_type) FILTER (p_size <= 3), '') AS failed FROM part GROUP BY 1""")
def compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages whose checks all pass, and what failed."""
    checks = read(spark, sf_dir, "part").select(F.col("p_brand").alias("package"), F.col("p_type").alias("check"), (F.col("p_size") > 3).alias("passed"))
    return telemetry.compliance(checks).withColumn("failed", F.array_join("failed", ","))


def _stores(spark: SparkSession, sf_dir: str, later: bool = False) -> DataFrame:
    """A profile store as JSON for each nation: three configurations, later others."""
    key = F.col("n_nationkey")
    config = lambda i, rest: F.concat(F.lit('{"id": "'), F.col("n_name"), F.lit(f'-{i}", '), F.lit(rest), F.lit("}"))
    configs = [config(1, '"path": "conf/app.ini", "tags": [" prod ", "prod", ""]'), config(2, '"path_glob": "conf/*.json", "metadata": {"ignore_review_flags": "true"}'), config(3, '"application": "web"')]
    if later:
        configs = [F.when(key % 3 == 0, configs[0]), F.when(key % 3 != 1, configs[1]), configs[2], F.when(key % 3 == 2, config(4, '"branch": "x"'))]
    text = F.concat(F.lit('{"profiles": [{"name": "'), F.col("n_name"), F.lit('", "tags": ["b", "a"], "configs": ['), F.concat_ws(", ", *configs), F.lit("]}]}"))
    rows = read(spark, sf_dir, "nation")
    rows = rows.where(key % 5 != 4) if later else rows.where(key % 5 != 3)
    return stores.parse_profiles(rows.select(text.alias("value")))


@query("""SELECT n_name AS profile, 'a,b' AS tags, n_name || '-' || i AS config_id, CASE i WHEN 1 THEN 'conf/app.ini' END AS path, CASE i WHEN 2 THEN 'conf/*.json' END AS path_glob, CASE i WHEN 1 THEN 'prod' ELSE '' END AS config_tags, i = 2 AS ignores FROM nation, range(1, 4) t(i) WHERE n_nationkey % 5 <> 3""")
def profile_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations of profile stores in JSON."""
    rows = profiles.configs(_stores(spark, sf_dir))
    return rows.select("profile", F.array_join("profile_tags", ",").alias("tags"), F.col("id").alias("config_id"), "path", "path_glob", F.array_join("tags", ",").alias("config_tags"), F.col("ignore_review_flags").alias("ignores"))


@query("""SELECT n_name AS name, 3::BIGINT AS config_count, n_name || '-1,' || n_name || '-2,' || n_name || '-3' AS config_ids FROM nation WHERE n_nationkey % 5 <> 3""")
def store_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with their configurations in declared order."""
    return profiles.store_summary(_stores(spark, sf_dir)).withColumn("config_ids", F.array_join("config_ids", ","))


@query("""SELECT n_name AS name, CASE n_nationkey % 5 WHEN 3 THEN 'added' WHEN 4 THEN 'removed' ELSE CASE WHEN n_nationkey % 3 = 0 THEN 'same' ELSE 'changed' END END AS status,
  CASE n_nationkey % 5 WHEN 4 THEN '' WHEN 3 THEN array_to_string(list_transform(CASE n_nationkey % 3 WHEN 0 THEN [1, 2, 3] WHEN 1 THEN [3] ELSE [2, 3, 4] END, lambda i: n_name || '-' || i), ',') ELSE CASE WHEN n_nationkey % 3 = 2 THEN n_name || '-4' ELSE '' END END AS added_ids,
  CASE n_nationkey % 5 WHEN 3 THEN '' WHEN 4 THEN n_name || '-1,' || n_name || '-2,' || n_name || '-3' ELSE CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN n_name || '-1,' || n_name || '-2' ELSE n_name || '-1' END END AS removed_ids FROM nation""")
def store_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two stores."""
    found = profiles.store_diff(profiles.store_summary(_stores(spark, sf_dir)), profiles.store_summary(_stores(spark, sf_dir, later=True)))
    return found.select("name", "status", F.array_join("added_ids", ",").alias("added_ids"), F.array_join("removed_ids", ",").alias("removed_ids"))


@query("""SELECT 'profile' AS kind, n_name AS name FROM nation WHERE n_nationkey % 5 NOT IN (3, 4) UNION ALL
SELECT 'config', n_name || '-' || i FROM nation, range(1, 4) t(i) WHERE n_nationkey % 5 NOT IN (3, 4) AND (i = 3 OR (i = 1 AND n_nationkey % 3 = 0) OR (i = 2 AND n_nationkey % 3 <> 1))""")
def store_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and ids that two stores repeat."""
    return profiles.store_problems(_stores(spark, sf_dir).unionByName(_stores(spark, sf_dir, later=True)))


_REVIEWED = ("conf/app.ini", "conf/a.json", "conf/deep/b.json", "other.json")


@query(f"""WITH d AS (SELECT p_partkey, {list(_REVIEWED)!r}[1 + p_partkey % 4] AS relative_path, (p_partkey // 4) % 2 = 1 AS flagged FROM part)
SELECT p_partkey, relative_path, flagged AND p_partkey % 4 NOT IN (1, 2) AS needs_review, flagged AND p_partkey % 4 IN (1, 2) AS review_ignored FROM d""")
def review_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose review a profile's configuration ignores."""
    path = F.element_at(F.array(*map(F.lit, _REVIEWED)), (digit(1, 4) + 1).cast("int"))
    rows = read(spark, sf_dir, "part").select("p_partkey", path.alias("relative_path"), on(4).alias("needs_review"))
    matched = profiles.matching(rows.select("relative_path").distinct(), _stores(spark, sf_dir), profiles.provided(["a", "b"]))
    return profiles.suppress_review(rows, matched)


@query(f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN c ELSE CASE p_partkey % 4 WHEN 2 THEN c ELSE 0 END END::BIGINT AS matched FROM part, (SELECT count(*) AS c FROM nation WHERE n_nationkey % 5 <> 3)""")
def profile_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many configurations apply to the path of each hit; hits without any stay."""
    path = F.element_at(F.array(*map(F.lit, _REVIEWED)), (digit(1, 4) + 1).cast("int"))
    hits = read(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    found = profiles.bridge(hits, _stores(spark, sf_dir), profiles.provided(["a", "b"]))
    return found.select("p_partkey", F.size("profiles").cast("bigint").alias("matched"))


@query("""SELECT n_name AS profile, n_name || '-2' AS id, 'conf/*.json' AS path_glob FROM nation WHERE n_nationkey = 7""")
def profile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configuration of an id."""
    name = read(spark, sf_dir, "nation").where("n_nationkey = 7").first().n_name
    return profiles.find_config(_stores(spark, sf_dir), f"{name}-2").select("profile", "id", "path_glob")


def _approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approvals of suppliers as JSON lists of two, the second for the next supplier's token."""
    key = F.col("s_suppkey")
    one = lambda k, by: F.concat(F.lit('{"token_name": "t'), (k % 7).cast("string"), F.lit('", "placeholder": "p", "approved_by": "'), by, F.lit('"}'))
    text = F.concat(F.lit("["), one(key, F.col("s_name")), F.lit(", "), one(key + 1, F.lit("second")), F.lit("]"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", text.alias("value"))


@query("""SELECT (n - 1)::INTEGER AS position, 't' || ((s_suppkey + n - 1) % 7) AS token_name, 'p' AS placeholder, CASE n WHEN 1 THEN s_name ELSE 'second' END AS approved_by FROM supplier, range(1, 3) t(n)""")
def approvals_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approvals of JSON lists."""
    return stores.parse_approvals(_approvals(spark, sf_dir)).select("position", "token_name", "placeholder", "approved_by")


@query("""SELECT 't' || s_suppkey % 7 AS token, 'p' AS placeholder, CASE WHEN s_suppkey % 7 = 3 THEN 'new' ELSE arg_max(s_name, s_suppkey) END AS approved_by FROM supplier GROUP BY 1, s_suppkey % 7""")
def approvals_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after new approvals, the last of each key."""
    old = read(spark, sf_dir, "supplier").select(F.concat(F.lit("t"), (F.col("s_suppkey") % 7).cast("string")).alias("token"), F.lit("p").alias("placeholder"), F.lit(None).cast("string").alias("excerpt_hash"), F.col("s_name").alias("approved_by"), F.col("s_suppkey").alias("position"))
    new = old.where("token = 't3'").withColumn("approved_by", F.lit("new"))
    return approvals.upsert(old, new).select("token", "placeholder", "approved_by")


@query("""SELECT '{"payload":{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '},"type":"nation"}' AS value FROM nation UNION ALL SELECT '{"payload":{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '},"type":"region"}' FROM region""")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed JSON lines of several tables, keys sorted."""
    return sinks.json_records(region=read(spark, sf_dir, "region"), nation=read(spark, sf_dir, "nation"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'my-app' WHEN 1 THEN '.env' ELSE 'a.b' END || '--' || p_brand || '.patch' AS patch FROM part""")
def patch_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of files of differences."""
    before = F.element_at(F.array(*map(F.lit, ("x/my app.ini", "x/.env", "a.b.txt"))), (digit(1, 3) + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", sinks.patch_name(before, F.concat("p_brand", F.lit(".ini"))).alias("patch"))


@query("""WITH w AS (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 + CASE WHEN n_regionkey < 2 THEN 2 ELSE 0 END AS i FROM nation)
SELECT n_nationkey, 'r' || n_regionkey || CASE WHEN i = 0 THEN '' ELSE '-' || i END AS free_name FROM w""")
def free_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that overwrite nothing."""
    wanted = read(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("name"), F.col("n_nationkey").alias("rank"))
    taken = spark.createDataFrame([("r0",), ("r0-1",), ("r1",), ("r1-1",)], "name string")
    return sinks.free_names(wanted, taken).select("n_nationkey", "free_name")


@query("""SELECT page_id || '/x.html' AS source, 'pkg/h-' || (page_id % 3) || '/' || page_id || '/x.html' AS destination, strlen(html)::BIGINT AS size, sha256(html) AS sha256, sum(strlen(html)) OVER ()::BIGINT AS total_size FROM pages""")
def package_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where collected files go, with sizes and digests."""
    files = read(spark, sf_dir, "pages").select(F.concat(F.lit(" h/"), (F.col("page_id") % 3).cast("string")).alias("host_id"), F.concat(F.col("page_id").cast("string"), F.lit("/x.html")).alias("relative_path"), F.col("html").cast("binary").alias("content"))
    return package.manifest(files, "pkg")


@query("""SELECT page_id, sha256(html) AS sha256, TRUE AS hidden, 32::BIGINT AS mac_size FROM pages""")
def sealed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents sealed and opened again."""
    keys = b"k" * 32, b"m" * 32
    pages = read(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    sealed = package.seal(pages, *keys).withColumn("closed", F.col("content")).withColumn("mac_size", F.octet_length("mac").cast("bigint"))
    opened = package.unseal(sealed, *keys)
    return opened.select("page_id", F.sha2("content", 256).alias("sha256"), (F.sha2("closed", 256) != F.sha2("content", 256)).alias("hidden"), "mac_size")


@query("""SELECT doc_id FROM (SELECT doc_id, n_chars, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before + 2 * n_chars > 500000""")
def package_exceeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files at which a package grows beyond its limit."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars", (2 * F.col("n_chars")).alias("original"))
    return budget.exceeds(docs, "doc_id", "original", "n_chars", 500_000, 100).select("doc_id")


@query("""WITH t AS (SELECT doc_id, least(n_chars, 2000) AS taken, coalesce(sum(least(n_chars, 2000)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT doc_id, greatest(0, 1000000 - before - taken)::BIGINT AS budget_remaining, before + taken >= 1000000 AS budget_exhausted FROM t WHERE before < 1000000""")
def budget_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file leaves of a budget."""
    return budget.within_budget(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 2000, 1_000_000).select("doc_id", F.col("budget_remaining").cast("bigint").alias("budget_remaining"), "budget_exhausted")


@query("""WITH m AS (SELECT p_partkey, p_partkey % 4 AS k FROM part) SELECT p_partkey, CASE k WHEN 0 THEN 'structured-config-xml/web-config/web-config' WHEN 1 THEN 'json/generic/object' WHEN 2 THEN 'ini/conf/my-app-ini' ELSE 'xml#' || substr(sha1(''), 1, 12) END AS config_id FROM m""")
def config_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of configurations across hosts."""
    pick = lambda *xs: F.element_at(F.array(*(F.lit(x).cast("string") for x in xs)), (digit(1, 4) + 1).cast("int"))
    fields = {"config_original_filename": pick(" Web.config ", None, None, None), "config_role": pick("web", "", None, None), "msbuild_kind": pick(None, None, None, None), "top_level_type": pick(None, "object", None, None)}
    rows = read(spark, sf_dir, "part").select("p_partkey", pick("structured-config-xml", "json", "ini", "xml").alias("format"), pick("web-config", "generic", None, None).alias("variant"), pick("a", "b", "Conf/My App.ini", "").alias("relative_path"), F.struct(*(c.alias(n) for n, c in fields.items())).alias("metadata"))
    return rows.select("p_partkey", hosts.config_id().alias("config_id"))


_RECORDS = """r AS (SELECT s_nationkey::VARCHAR AS host_id, 'c' || s_suppkey % 5 AS config_id, s_suppkey AS scan_order, s_name AS canonical FROM supplier),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY host_id, config_id ORDER BY scan_order DESC) = 1)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("host_id"), F.concat(F.lit("c"), (F.col("s_suppkey") % 5).cast("string")).alias("config_id"), F.col("s_suppkey").alias("scan_order"), F.col("s_name").alias("canonical"))
    return hosts.last_scanned(rows)


@query(f"""WITH {_RECORDS} SELECT host_id, config_id, scan_order, sha256(host_id || ':' || config_id || ':root:' || sha256(canonical)) AS signature FROM l""")
def record_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each host and configuration with what its cached comparison is valid for."""
    rows = _records(spark, sf_dir).withColumn("root_fingerprint", F.lit("root")).withColumn("file_hash", F.sha2(F.col("canonical").cast("binary"), 256))
    return rows.select("host_id", "config_id", "scan_order", hosts.signature().alias("signature"))


@query(f"""WITH {_RECORDS} SELECT host_id, config_id, scan_order % 2 = 0 AS is_cached FROM l""")
def cached_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose comparison the cache still holds, and others."""
    rows = _records(spark, sf_dir).withColumn("signature", F.concat(F.lit("s"), F.col("scan_order").cast("string")))
    cache = rows.select("host_id", "config_id", F.when(F.col("scan_order") % 2 == 0, F.col("signature")).otherwise("old").alias("signature"), F.lit("d").alias("diff"))
    held = hosts.cached(rows, cache).select("host_id", "config_id", F.lit(True).alias("is_cached"))
    return held.unionByName(hosts.changed_only(rows, cache).select("host_id", "config_id", F.lit(False).alias("is_cached")))


@query(f"""WITH {_RECORDS} SELECT config_id, first(host_id ORDER BY host_id <> '7', host_id) AS host_id, first(canonical ORDER BY host_id <> '7', host_id) AS diff FROM l GROUP BY 1""")
def drilldowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference that each configuration's page shows."""
    return hosts.drilldown(_records(spark, sf_dir).withColumnRenamed("canonical", "diff"), "7").select("config_id", "host_id", "diff")


@query("""SELECT min(c_mktsegment) AS host_id, count(*)::BIGINT AS missing_configs FROM customer WHERE c_acctbal < 0 GROUP BY lower(c_mktsegment)""")
def hosts_to_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that lack a configuration, whatever the case of their names."""
    name = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    rows = read(spark, sf_dir, "customer").select(name.alias("host_id"), if_(F.col("c_acctbal") < 0, "missing", "match").alias("status"))
    return hosts.hosts_to_rescan(rows).withColumn("host_id", F.upper("host_id"))


@query("""SELECT n_nationkey::VARCHAR AS host_id, CASE n_nationkey % 4 WHEN 0 THEN 'not_found' WHEN 1 THEN 'permission_denied' WHEN 2 THEN 'offline' ELSE 'ok' END AS availability FROM nation""")
def host_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether hosts could be read, by the class of their errors."""
    key, host = F.col("n_nationkey") % 4, F.col("n_nationkey").cast("string").alias("host_id")
    nations = read(spark, sf_dir, "nation")
    errors = F.when(key == 1, F.array(F.lit(None), F.lit("PermissionError"))).when(key == 2, F.array(F.lit("OSError"))).otherwise(F.array(F.lit(None), F.lit("OSError")))
    found = nations.where(key != 0).select(host, F.explode(errors).alias("error"))
    return hosts.availability(found, nations.select(host, (key != 0).alias("exists")))


@query("""SELECT page_id, regexp_matches(url, '(^|/)[a-z]{2}/[^/]*$') AS right_two, regexp_matches(url, '^http:/[^/]*/([^/]+/)*fr/[^/]*$') AS below_fr FROM (SELECT page_id, replace(url, '//', '/') AS url FROM pages)""")
def glob_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Globs matched from the right, and from a root with folders of any depth."""
    path = F.replace(F.col("url"), F.lit("//"), F.lit("/"))
    return read(spark, sf_dir, "pages").select("page_id", path.rlike(glob_from_right("[a-z][a-z]/*")).alias("right_two"), path.rlike(glob_from_root("http:/*/**/fr/*")).alias("below_fr"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'xml' ELSE 'text' END AS content_type FROM part""")
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How pairs of files are compared, by their suffixes."""
    after = F.element_at(F.array(*map(F.lit, ("a/b.CSPROJ", "b.json", ".xml", "xml"))), (digit(1, 4) + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", diffs.guess_content_type(F.lit("a.ini"), after).alias("content_type"))


@query("""SELECT p_partkey, '{"secret": ["a [X] b", {"k": "[X]"}], "n": ' || p_size || ', "t": "' || replace(p_name, 'e', '[X]') || '"}' AS redacted FROM part""")
def nested_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON whose strings are redacted at any depth; keys stay."""
    text = F.concat(F.lit('{"secret": ["a secret b", {"k": "secret"}], "n": '), F.col("p_size").cast("string"), F.lit(', "t": "'), F.col("p_name"), F.lit('"}'))
    return read(spark, sf_dir, "part").select("p_partkey", redact_json(text, ["secret", "e"], "[X]").alias("redacted"))


@query("""SELECT p_partkey, 'safe line' || chr(10) || CASE WHEN p_partkey % 2 = 1 THEN 'x [SECRET] y' ELSE 'x password = none y' END || chr(10) || 'keep me' AS text, p_partkey % 3 = 0 AS is_binary FROM part""")
def sanitised_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with what secret rules find replaced, and which contents are binary."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("safe line\nx password = "), if_(on(1), "SUPERSECRET123", "none"), F.lit(" y\nkeep me")).alias("text"))
    clean = secrets.sanitise(rows)
    return clean.select("p_partkey", "text", secrets.is_binary(F.when(digit(1, 3) == 0, F.unhex(F.lit("4100"))).otherwise(F.unhex(F.lit("41100A40")))).alias("is_binary"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 90 WHEN 1 THEN 900 WHEN 2 THEN 5400 WHEN 3 THEN 2700 ELSE -1 END::BIGINT AS seconds FROM events""")
def schedule_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of intervals in several notations; -1 for what is none."""
    text = F.element_at(F.array(*map(F.lit, ("90", "15m", "1h30m", "PT45M", "0m", "often"))), (F.col("event_id") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", F.coalesce(schedule.interval(text), F.lit(-1).cast("bigint")).alias("seconds"))


def _schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schedule as JSON for each nation."""
    key = F.col("n_nationkey")
    window = F.when(key % 2 == 0, ', "window": {"start": "22:00", "end": "02:00:30"}').otherwise("")
    text = F.concat(F.lit('{"schedules": [{"name": "'), F.col("n_name"), F.lit('", "profile": "p", "every": "'), (key + 1).cast("string"), F.lit('h", "start_at": "2024-01-01T00:00:00Z"'), window, F.lit("}]}"))
    return stores.parse_schedules(read(spark, sf_dir, "nation").select(text.alias("value")))


@query("""SELECT n_name AS name, ((n_nationkey + 1) * 3600)::BIGINT AS every_seconds, (CASE WHEN n_nationkey % 2 = 0 THEN 79200 ELSE -1 END)::INTEGER AS window_start, (CASE WHEN n_nationkey % 2 = 0 THEN 7230 ELSE -1 END)::INTEGER AS window_end FROM nation""")
def schedules_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules of JSON."""
    return _schedules(spark, sf_dir).select("name", "every_seconds", F.coalesce("window_start", F.lit(-1)).alias("window_start"), F.coalesce("window_end", F.lit(-1)).alias("window_end"))


@query("""SELECT n_name AS name, n_nationkey % 3 <> 0 AS pending, TIMESTAMP '2024-01-01' + CASE WHEN n_nationkey % 3 = 0 THEN INTERVAL 12 HOUR + (n_nationkey + 1) * INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS next_run FROM nation WHERE n_nationkey % 2 = 1""")
def schedules_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules that were due, some of them completed since."""
    rows = _schedules(spark, sf_dir).where("window_start IS NULL").withColumn("next_run", F.col("start_at")).withColumn("pending", F.lit(False))
    waiting = schedule.due(rows, F.lit("2024-01-02").cast("timestamp"))
    done = read(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select(F.col("n_name").alias("name"), F.lit("2024-01-01 12:00:00").cast("timestamp").alias("completed_at"))
    return schedule.complete(waiting, done).select("name", "pending", F.col("next_run").cast("timestamp_ntz").alias("next_run"))


@query("""SELECT n_name AS name, n_nationkey::BIGINT AS total_runs, 0::BIGINT AS failures, 'PASS' AS last_status, TIMESTAMP '2024-05-01 10:00:00' AS last_updated FROM nation""")
def telemetry_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios of telemetry in JSON."""
    text = F.concat(F.lit('{"generatedAt": "2024-05-02T00:00:00Z", "scenarios": [{"name": "'), F.col("n_name"), F.lit('", "totalRuns": '), F.col("n_nationkey").cast("string"), F.lit(', "failures": 0, "lastStatus": "PASS", "lastUpdated": "2024-05-01T12:00:00+02:00"}]}'))
    rows = stores.parse_telemetry(read(spark, sf_dir, "nation").select(text.alias("value")))
    return rows.select("name", "total_runs", "failures", "last_status", F.col("last_updated").cast("timestamp_ntz").alias("last_updated"))


@query("""SELECT n_nationkey, '{"from":"old","to":"new","metadata":{"content_type":"text","context_lines":3,"baseline_name":"base","comparison_name":null},"summary":{"before_digest":"' || sha256(n_name) || '","after_digest":"' || sha256(n_name || chr(10) || 'x') || '","diff_digest":"' || sha256(n_name || chr(10) || '---' || chr(10) || n_name || chr(10) || 'x') || '","before_lines":1,"after_lines":2,"added_lines":1,"removed_lines":0,"changed_lines":0}}' AS payload, 0::BIGINT AS redactions FROM nation""")
def diff_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons by a plan, as JSON."""
    plan = diffs.DiffPlan(from_label="old", to_label="new", baseline_name="base", mask_tokens=("absent",))
    pairs = read(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit("  \r\n")).alias("before"), F.concat("n_name", F.lit("\nx")).alias("after"))
    pairs = pairs.withColumn("before", F.regexp_replace("before", r"\s+\z", ""))
    return diffs.comparisons(diffs.execute(plan, pairs), plan).select("n_nationkey", "payload", F.col("before_redactions")["absent"].alias("redactions"))


@query("""SELECT p_partkey, 'Q' || p_size AS plain FROM part""")
def hits_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of JSON lists."""
    text = F.concat(F.lit('[{"rule": {"name": "r", "token_name": "t"}, "path": "/x", "line_number": '), F.col("p_partkey").cast("string"), F.lit(', "excerpt": "Q'), F.col("p_size").cast("string"), F.lit('"}]'))
    return stores.parse_hits(read(spark, sf_dir, "part").select(text.alias("value"))).select(F.col("line_number").alias("p_partkey"), F.col("excerpt").alias("plain"))
