"""Queries of operators that go on from step to step: walks of registries, schedules, caches, names and cut texts, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import Tables
from ..operators import archive, classify, failures, fuzz, registry, sinks, structure, xml_scopes
from ..operators.cache import CacheLog
from ..sources import decode
from ..streaming import schedules
from .config_files import digit, files_of, if_, on, sql_digit
from .registry import query, read

_ROOTS = [(0, "HKLM", "64", "Software\\EUROPE"), (1, "HKLM", None, "software\\asia"), (2, "HKLM", "64", "Software\\Asia\\Japan"), (3, "HKCU", "64", "Software\\AFRICA"), (4, "HKLM", "64", "Software\\None")]


def _key_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Keys of regions, nations, customers and their orders, without those of some nations that can't be opened, and the values of the last two."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    at = F.concat_ws("\\", F.lit("Software"), "r_name", "n_name")
    places = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", at.alias("place"), F.concat_ws("\\", F.lit("Software"), "r_name").alias("area"))
    customers = read(spark, sf_dir, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "c_name", F.concat("place", F.lit("\\c"), F.col("c_custkey").cast("string")).alias("key_path"))
    orders = read(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.concat("key_path", F.lit("\\o"), F.col("o_orderkey").cast("string")).alias("key_path"), "o_orderstatus")
    keys = places.select("area").distinct().union(places.where("n_nationkey % 5 <> 2").select("place")).union(customers.select("key_path")).union(orders.select("key_path"))
    value = lambda name, data: F.struct(F.lit(name).alias("value_name"), F.col(data).alias("data"))
    values = customers.select("key_path", F.inline(F.array(value("Segment", "c_mktsegment"), value("Name", "c_name")))).union(orders.select("key_path", F.lit("Status"), "o_orderstatus"))
    held = lambda df: df.select(F.lit("HKLM").alias("hive"), F.lit("64").alias("view"), "*")
    return held(keys.withColumnRenamed("area", "key_path")), held(values)


_TREE_SQL = r"""places AS (SELECT n_nationkey, 'Software\' || r_name || '\' || n_name AS place, 'Software\' || r_name AS area FROM nation JOIN region ON n_regionkey = r_regionkey),
customers AS (SELECT c_custkey, c_mktsegment, c_name, place || '\c' || c_custkey AS key_path FROM customer JOIN places ON c_nationkey = n_nationkey),
ords AS (SELECT key_path || '\o' || o_orderkey AS key_path, o_orderstatus FROM orders JOIN customers ON o_custkey = c_custkey),
keys AS (SELECT DISTINCT area AS key_path FROM places UNION ALL SELECT place FROM places WHERE n_nationkey % 5 <> 2 UNION ALL SELECT key_path FROM customers UNION ALL SELECT key_path FROM ords),
vals AS (SELECT key_path, 'Segment' AS value_name, c_mktsegment AS data FROM customers UNION ALL SELECT key_path, 'Name', c_name FROM customers UNION ALL SELECT key_path, 'Status', o_orderstatus FROM ords),
named AS (SELECT key_path, lower(key_path) AS k, regexp_replace(lower(key_path), '\\[^\\]*$', '') AS above FROM keys),
roots AS (SELECT unnest([0, 1, 2]) AS root_order, unnest(['software\europe', 'software\asia', 'software\asia\japan']) AS k),
walk AS (SELECT root_order, 0 AS depth, k, key_path FROM roots JOIN named USING (k) UNION ALL SELECT root_order, depth + 1, n.k, n.key_path FROM walk JOIN named n ON n.above = walk.k WHERE depth < {depth}),
met AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY depth, root_order) AS visit FROM walk)"""


@query("WITH RECURSIVE " + _TREE_SQL.format(depth=3) + " SELECT m.key_path, value_name, data AS preview, depth, root_order FROM met m JOIN vals USING (key_path) WHERE visit = 1 AND (data = 'MACHINERY' OR data = 'P')")
def registry_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that a walk of several roots meets; what is below a key that can't be opened is never met."""
    keys, values = _key_tree(spark, sf_dir)
    roots = spark.createDataFrame(_ROOTS, "root_order int, hive string, view string, key_path string")
    found = registry.traverse(keys, values, roots, patterns=["^MACHINERY$", "^P$"], max_depth=3, max_hits=1 << 30)
    return found.select("key_path", "value_name", "preview", "depth", "root_order")


@query("WITH RECURSIVE " + _TREE_SQL.format(depth=12) + r""" SELECT m.key_path, value_name, data AS preview, depth, root_order FROM met m JOIN vals USING (key_path) WHERE visit = 1 AND contains(lower(value_name || ' ' || data), 'segment') AND contains(lower(data), 'build')
ORDER BY depth, root_order, string_split(m.k, '\') LIMIT 40""")
def registry_first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first values of the same walk that hold all keywords: the limit is the feature, and ends the walk."""
    keys, values = _key_tree(spark, sf_dir)
    roots = spark.createDataFrame(_ROOTS, "root_order int, hive string, view string, key_path string")
    return registry.traverse(keys, values, roots, keywords=["SEGMENT", "build"], max_hits=40).select("key_path", "value_name", "preview", "depth", "root_order")


_UNTIL = 915148800  # 1999-01-01


def schedule_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schedule for each customer, whose orders are its commands."""
    second = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    key = F.col("o_orderkey")
    kind = F.when(key % 11 == 0, "cancel").when(key % 11 == 1, "register").when(key % 11 == 2, "snapshot").when(key % 11 < 5, "skip").otherwise("complete")
    name = lambda c: F.concat(F.lit("c"), F.col(c).cast("string")).alias("name")
    every, none = lambda c: (F.col(c) % 90 + 20) * 86400 + 3600, F.lit(None).cast("bigint")
    edges = lambda c: (F.when(F.col(c) % 3 > 0, F.lit(79200).cast("bigint")), F.when(F.col(c) % 3 == 1, F.lit(7200).cast("bigint")).when(F.col(c) % 3 == 2, F.lit(82800).cast("bigint")))
    first = read(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(name("c_custkey"), F.lit(694224000).cast("bigint").alias("at"), F.lit(-1).cast("bigint").alias("seq"), F.lit("register").alias("command"), none.alias("until"), every("c_custkey").cast("bigint").alias("every_seconds"), edges("c_custkey")[0].alias("window_start"), edges("c_custkey")[1].alias("window_end"))
    at = second("o_orderdate") + key % 86400
    then = read(spark, sf_dir, "orders").select(name("o_custkey"), at.alias("at"), key.alias("seq"), kind.alias("command"), F.when(kind == "skip", at + 86400 * 60 + 5).alias("until"), F.when(kind == "register", every("o_custkey").cast("bigint")).alias("every_seconds"), F.when(kind == "register", edges("o_custkey")[0]).alias("window_start"), F.when(kind == "register", edges("o_custkey")[1]).alias("window_end"))
    return first.unionByName(then)


_ALIGNED = "CASE WHEN {s} IS NULL OR (CASE WHEN {s} <= {e} THEN {t} % 86400 BETWEEN {s} AND {e} ELSE {t} % 86400 >= {s} OR {t} % 86400 <= {e} END) THEN {t} ELSE {t} - {t} % 86400 + {s} + CASE WHEN {t} % 86400 < {s} THEN 0 ELSE 86400 END END"
_EVERY = "({c} % 90 + 20) * 86400 + 3600"


@query(f"""WITH RECURSIVE commands AS (
  SELECT 'c' || c_custkey AS name, 694224000::BIGINT AS "at", -1::BIGINT AS seq, 'register' AS command, NULL::BIGINT AS until, ({_EVERY.format(c="c_custkey")})::BIGINT AS every, c_custkey % 3 AS w FROM customer WHERE c_custkey % 7 <> 0
  UNION ALL SELECT 'c' || o_custkey, (epoch(o_orderdate::TIMESTAMP)::BIGINT + o_orderkey % 86400), o_orderkey, CASE o_orderkey % 11 WHEN 0 THEN 'cancel' WHEN 1 THEN 'register' WHEN 2 THEN 'snapshot' WHEN 3 THEN 'skip' WHEN 4 THEN 'skip' ELSE 'complete' END,
    epoch(o_orderdate::TIMESTAMP)::BIGINT + o_orderkey % 86400 + 5184005, {_EVERY.format(c="o_custkey")}, o_custkey % 3 FROM orders),
numbered AS (SELECT *, CASE WHEN w > 0 THEN 79200 END::BIGINT AS ws, CASE w WHEN 1 THEN 7200 WHEN 2 THEN 82800 END::BIGINT AS we, row_number() OVER (PARTITION BY name ORDER BY "at", seq) AS n FROM commands),
steps AS (SELECT name, 0::BIGINT AS n, NULL::BIGINT AS "at", NULL::BIGINT AS seq, NULL::VARCHAR AS event, NULL::BIGINT AS due_at, FALSE AS live, NULL::BIGINT AS next_run, NULL::BIGINT AS pending FROM (SELECT DISTINCT name FROM commands)
  UNION ALL SELECT name, n, "at", seq, event, due_at, event = 'registered' OR (live AND event <> 'cancelled') AS live,
    CASE WHEN event = 'registered' THEN {_ALIGNED.format(t='"at"', s="ws", e="we")} WHEN event = 'cancelled' THEN NULL WHEN event = 'completed' THEN {_ALIGNED.format(t='("at" + every)', s="ws", e="we")} WHEN event = 'skipped' THEN {_ALIGNED.format(t="until", s="ws", e="we")} ELSE next_run END AS next_run,
    CASE WHEN event IN ('registered', 'cancelled', 'completed', 'skipped') THEN NULL ELSE waiting END AS pending
  FROM (SELECT s.name, c.n, c."at", c.seq, c.until, c.every, c.ws, c.we, s.live, s.next_run, CASE WHEN s.live AND s.pending IS NULL AND s.next_run <= c."at" THEN s.next_run END AS due_at,
      coalesce(s.pending, CASE WHEN s.live AND s.next_run <= c."at" THEN s.next_run END) AS waiting,
      CASE WHEN c.command = 'register' AND NOT s.live THEN 'registered' WHEN NOT s.live OR c.command = 'register' THEN 'rejected'
        WHEN c.command = 'complete' AND coalesce(s.pending, CASE WHEN s.next_run <= c."at" THEN s.next_run END) IS NULL THEN 'rejected'
        ELSE CASE c.command WHEN 'complete' THEN 'completed' WHEN 'skip' THEN 'skipped' WHEN 'cancel' THEN 'cancelled' ELSE 'state' END END AS event
    FROM steps s JOIN numbered c ON c.name = s.name AND c.n = s.n + 1)),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC) AS back FROM steps) WHERE back = 1)
SELECT name, coalesce("at"::VARCHAR, '-') AS "at", coalesce(seq::VARCHAR, '-') AS seq, event, coalesce(next_run::VARCHAR, '-') AS next_run, coalesce(pending::VARCHAR, '-') AS pending FROM (
SELECT name, "at", seq, event, next_run, pending FROM steps WHERE n > 0
UNION ALL SELECT name, due_at, NULL, 'due', due_at, due_at FROM steps WHERE due_at IS NOT NULL
UNION ALL SELECT name, next_run, NULL, 'due', next_run, next_run FROM last WHERE live AND pending IS NULL AND next_run <= {_UNTIL})""")
def schedule_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of every schedule: registered, due, completed, skipped, cancelled, asked for its state, rejected."""
    steps = schedules.replay(schedule_commands(spark, sf_dir), _UNTIL)
    return steps.select("name", "event", *(F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in ("at", "seq", "next_run", "pending")))


def _scans(spark: SparkSession, sf_dir: str, number: int) -> DataFrame:
    """The records of one of three scans of orders as configurations: some appear later, some change."""
    found = read(spark, sf_dir, "orders").select(F.concat(F.lit("h"), (F.col("o_custkey") % 10).cast("string")).alias("host_id"), F.col("o_orderkey").cast("string").alias("config_id"), "o_orderkey", "o_orderstatus")
    seen = [F.col("o_orderkey") % 5 != 1, F.col("o_orderkey") % 5 != 2, F.col("o_orderkey") % 5 != 3][number]
    turn = F.when(F.col("o_orderkey") % 7 < number, number).otherwise(0)
    return found.where(seen).select("host_id", "config_id", F.sha1(F.concat_ws(":", "o_orderstatus", turn.cast("string")).cast("binary")).alias("signature"), turn.cast("int").alias("turn"))


_ORDERS = "SELECT 'h' || (o_custkey % 10) AS host_id, o_orderkey::VARCHAR AS config_id, o_orderkey AS k, o_orderstatus AS q FROM orders"
_TURNS = f"""SELECT host_id, config_id, k, sha1(q || ':' || turn) AS signature, turn, scan FROM (SELECT *, CASE WHEN k % 7 < scan THEN scan ELSE 0 END AS turn FROM ({_ORDERS}), range(0, 3) t(scan)) WHERE k % 5 <> scan + 1"""


@query(f"""WITH s AS ({_TURNS}), o AS (SELECT *, lag(signature) OVER (PARTITION BY host_id, config_id ORDER BY scan) AS old FROM s) SELECT scan::BIGINT AS batch, host_id, config_id, signature, turn FROM o WHERE old IS NULL OR old <> signature""")
def cache_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three scans of hosts have to compare anew, each beside what the cache holds by then."""
    cache = CacheLog(spark, Tables(spark, "cache").root)
    parts = [cache.merge(_scans(spark, sf_dir, k), k) for k in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("batch", "host_id", "config_id", "signature", "turn")


@query(f"""WITH s AS ({_TURNS}), o AS (SELECT *, lag(signature) OVER (PARTITION BY host_id, config_id ORDER BY scan) AS old FROM s), c AS (SELECT * FROM o WHERE old IS NULL OR old <> signature)
SELECT host_id, config_id, signature, turn, scan::BIGINT AS batch FROM (SELECT *, row_number() OVER (PARTITION BY host_id, config_id ORDER BY scan DESC) AS n FROM c) WHERE n = 1""")
def cache_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after three scans, one of them merged twice as after a failure, put together in between."""
    cache = CacheLog(spark, Tables(spark, "cache").root)
    for k in (0, 1, 1):
        cache.merge(_scans(spark, sf_dir, k), k)
    cache.compact()
    cache.merge(_scans(spark, sf_dir, 2), 2)
    return cache.state().select("host_id", "config_id", "signature", "turn", "batch")


@query(f"""SELECT p_partkey, trim(CASE WHEN {sql_digit(2)} = 1 THEN ']}} ' ELSE '' END || CASE WHEN {sql_digit(1)} = 1 THEN '{{"k": "}}\\"{{\\\\", "n": [1, [2]], "é": "[' || p_name || '"}}' ELSE '' END) AS kept FROM part""")
def json_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of JSON cut in an object, in a list or in a string, back to where all brackets are closed."""
    whole = F.when(on(1), F.concat(F.lit('{"k": "}\\"{\\\\", "n": [1, [2]], "é": "['), "p_name", F.lit('"}'))).otherwise("")
    tails = F.element_at(F.array(*map(F.lit, ('{"p": {"q": 1}', '[[], {}', '{"s": "open } ]', '"never closed } ', '{"a": "\\\\"', '{"x": "\\"}'))), (digit(4, 6) + 1).cast("int"))
    files = files_of(spark, sf_dir, F.lit("cut.json"), F.concat(if_(on(2), "]} "), whole, F.lit(" "), tails))
    return files.select("p_partkey", structure.cut_at_balance(F.col("text")).alias("kept"))


@query("""WITH w AS (SELECT o_orderkey, 'n' || (o_orderkey % 50) || CASE WHEN o_orderkey % 50 < 5 AND o_orderkey % 2 = 0 THEN '-2' ELSE '' END AS name FROM orders),
stems AS (SELECT DISTINCT name FROM w), taken AS (SELECT 'n' || (i % 50) || CASE WHEN i < 50 THEN '' ELSE '-' || (i // 50) END AS name FROM range(0, 1000) t(i) WHERE i % 3 <> 0),
given AS (SELECT s.name, s.name || CASE WHEN k = 0 THEN '' ELSE '-' || k END AS free_name, k FROM stems s, (SELECT unnest(range(0, (SELECT max(n) + 60 FROM (SELECT count(*) AS n FROM w GROUP BY name)))) AS k)),
free AS (SELECT name, free_name, k FROM given g WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.name = g.free_name) AND (k = 0 OR NOT EXISTS (SELECT 1 FROM stems t WHERE t.name = g.free_name))),
f AS (SELECT name, free_name, row_number() OVER (PARTITION BY name ORDER BY k) AS i FROM free), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY o_orderkey) AS i FROM w)
SELECT o_orderkey, free_name FROM r JOIN f USING (name, i)""")
def free_names_in_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that fill the gaps between taken ones, some wanted with a number of their own."""
    key = F.col("o_orderkey")
    wanted = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("n"), (key % 50).cast("string"), F.when((key % 50 < 5) & (key % 2 == 0), "-2").otherwise("")).alias("name"), key.alias("rank"))
    number = F.floor(F.col("id") / 50)
    taken = spark.range(1000).where("id % 3 <> 0").select(F.concat(F.lit("n"), (F.col("id") % 50).cast("string"), F.when(number > 0, F.concat(F.lit("-"), number.cast("string"))).otherwise("")).alias("name"))
    return sinks.free_names(wanted, taken).select("o_orderkey", "free_name")


_HEADS = [  # name, text before {x}, root namespace, variant
    ("a.xml", "<?xml version='1.0'?><!-- <assembly xmlns='urn:no'> --><asm:assembly xmlns:asm='urn:schemas-microsoft-com:asm.v1' manifestVersion='1.0'{x}><q xmlns='urn:inner'/></asm:assembly>", "urn:schemas-microsoft-com:asm.v1", "app-manifest-xml", 1, 55, "manifestVersion=1.0"),
    ("b.config", "<!DOCTYPE nlog [<!ELEMENT x (y)>]>\n<nlog{x} autoReload=\"a>b\"\n  throw='no'><t xmlns='urn:schemas-microsoft-com:asm.v1'/></nlog>", None, "nlog-config", 2, 6, 'autoReload=a>b|throw=no'),
    ("c.props", "<Project xmlns='http://schemas.microsoft.com/developer/msbuild/2003'{x}><Import Project='d'/></Project>", "http://schemas.microsoft.com/developer/msbuild/2003", "msbuild-props", 1, 10, ""),
    ("d.resx", "\n\n <w:Window xmlns='urn:other'\n xmlns:w='http://schemas.microsoft.com/winfx/2006/xaml'{x}/>", "http://schemas.microsoft.com/winfx/2006/xaml", "interface-xml", 3, 12, ""),
    ("e.manifest", "<plain{x}><s xmlns='http://www.w3.org/1999/XSL/Transform'/></plain>", None, None, 1, 1, ""),
    ("f.txt", "<z:stylesheet version=\"1\" xmlns:z = 'http://www.w3.org/1999/XSL/Transform'{x}>\n<z:template/></z:stylesheet>", "http://www.w3.org/1999/XSL/Transform", "xslt-xml", 1, 15, "version=1"),
]


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda f: F.element_at(F.array(*(F.lit(f(x)) for x in _HEADS)), (digit(1, 6) + 1).cast("int"))
    added = F.when(digit(6) == 1, F.concat(F.lit(" size='"), F.col("p_size").cast("string"), F.lit("'"))).otherwise("")
    text = F.concat(pick(lambda x: x[1].split("{x}")[0]), added, pick(lambda x: x[1].split("{x}")[1]))
    return files_of(spark, sf_dir, pick(lambda x: x[0]), text).withColumn("path", F.col("p_partkey"))


def _quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


_SIZED = f"CASE WHEN {sql_digit(6)} = 1 THEN 'size=' || p_size END"


@query(f"""WITH heads(k, root_namespace, variant, line, given) AS (VALUES {", ".join(f"({k}, {_quoted(x[2])}, {_quoted(x[3])}, {2 if k == 1 else 3 if k == 3 else 1}, {_quoted(x[6] or None)})" for k, x in enumerate(_HEADS))})
SELECT p_partkey, coalesce(root_namespace, '-') AS root_namespace, coalesce(variant, '-') AS variant, line::INTEGER AS line, array_to_string(list_sort(list_filter(string_split(coalesce(given, ''), '|') || [{_SIZED}], lambda x: x <> '')), '|') AS attributes
FROM part JOIN heads ON k = {sql_digit(1, 6)}""")
def xml_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of documents with their attributes, and the variants that their namespaces say whatever the suffix and whatever is declared below."""
    rows = xml_scopes.roots(_heads(spark, sf_dir))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", e["key"], e["value"]))), "|")
    return rows.select(F.col("path").alias("p_partkey"), F.coalesce("root_namespace", F.lit("-")).alias("root_namespace"), F.coalesce("variant", F.lit("-")).alias("variant"), "line", shown.alias("attributes"))


_DECLARED = [(0, "asm", "urn:schemas-microsoft-com:asm.v1", "asm:assembly", 0), (0, None, "urn:inner", "q", 1), (1, None, "urn:schemas-microsoft-com:asm.v1", "t", 1), (2, None, "http://schemas.microsoft.com/developer/msbuild/2003", "Project", 0), (3, None, "urn:other", "w:Window", 0), (3, "w", "http://schemas.microsoft.com/winfx/2006/xaml", "w:Window", 0), (4, None, "http://www.w3.org/1999/XSL/Transform", "s", 1), (5, "z", "http://www.w3.org/1999/XSL/Transform", "z:stylesheet", 0)]


@query(f"""WITH d(k, prefix, uri, element, depth) AS (VALUES {", ".join(f"({k}, {_quoted(p)}, {_quoted(u)}, {_quoted(e)}, {n})" for k, p, u, e, n in _DECLARED)})
SELECT p_partkey, coalesce(prefix, '-') AS prefix, uri, element, depth::INTEGER AS depth, substr(sha1('xmlns' || coalesce(':' || prefix, '') || '|' || uri), 1, 12) AS fingerprint FROM part JOIN d ON k = {sql_digit(1, 6)}""")
def xml_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each namespace is declared: in which element, how deep, with its fingerprint."""
    rows = xml_scopes.namespaces(_heads(spark, sf_dir))
    return rows.select(F.col("path").alias("p_partkey"), F.coalesce("prefix", F.lit("-")).alias("prefix"), "uri", "element", "depth", "fingerprint")


def _failing(path: str, sample: bytes, text: str | None) -> dict | None:
    key = int(path.split("/")[0])
    if key % 4 == 1:
        raise OSError(f"broken {key}")
    return {"format": "note", "variant": 7 if key % 8 == 6 else "kept", "confidence": 0.6} if key % 4 == 2 else None


def _odd(path: str, sample: bytes, text: str | None) -> dict | None:
    return {"confidence": 1} if int(path.split("/")[0]) % 3 == 0 else None  # without a format


@query("""WITH p AS (SELECT p_partkey AS k FROM part), c AS (SELECT k, CASE WHEN k % 5 = 0 AND k % 4 <> 2 THEN '-' WHEN k % 4 = 2 THEN 'note' ELSE 'ini' END AS format FROM p)
SELECT c.k AS p_partkey, format, stage, error, message FROM c JOIN (SELECT k, 'failing' AS stage, 'OSError' AS error, 'broken ' || k AS message FROM p WHERE k % 4 = 1 UNION ALL SELECT k, 'odd', 'KeyError', '''format''' FROM p WHERE k % 3 = 0 UNION ALL SELECT k, 'read', 'PermissionError', '-' FROM p WHERE k % 5 = 0) e ON e.k = c.k
UNION ALL SELECT k, format, '-', '-', '-' FROM c WHERE k % 4 <> 1 AND k % 3 <> 0 AND k % 5 <> 0""")
def detector_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are classified although detectors fail on them, beside every failure; none is lost."""
    hidden = digit(1, 5) == 0
    files = files_of(spark, sf_dir, F.lit("a.ini"), F.lit("[a]\nk = 1\nl = 2\n"))
    files = files.withColumn("sample", F.when(~hidden, F.col("sample"))).withColumn("text", F.when(~hidden, F.col("text"))).withColumn("error", F.when(hidden, "PermissionError"))
    using = classify.with_plugins(classify.PythonDetector("failing", 5, _failing), classify.PythonDetector("odd", 6, _odd))
    found, errors = failures.classify_recorded(files, using)
    shown = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return found.select("p_partkey", "format", F.col("relative_path").alias("path")).join(errors, "path", "left").select("p_partkey", *map(shown, ("format", "stage", "error", "message")))


_DRAWN = "('0x' || substr(sha256('7:' || p_partkey || '/notes.cfg:' || t || ':{what}'), 1, 8))::BIGINT"


@query(f"""WITH r AS (SELECT p_partkey AS k, t, CASE WHEN p_partkey % 9 = 0 THEN 3 ELSE {_DRAWN.format(what="mutation")} % 5 END AS m, {_DRAWN.format(what="place")} % greatest(1, n) AS place, n, greatest(1, n // 10) AS tenth, {_DRAWN.format(what="byte")} AS b
  FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE 40 + p_partkey % 50 END AS n FROM part), range(0, 4) x(t))
SELECT k AS p_partkey, t::INTEGER AS trial, ['flip', 'drop', 'repeat', 'comment', 'cut'][m + 1] AS mutation, md5(CASE m WHEN 0 THEN repeat('k', place) || chr(((107 + 1 + b % 255) % 256)::INTEGER) || repeat('k', n - place - 1) WHEN 1 THEN repeat('k', place + greatest(0, n - place - tenth)) WHEN 2 THEN repeat('k', least(n, place + tenth) + n - place)
  WHEN 3 THEN '# note ' || (b % 10000) || chr(10) || repeat('k', n) ELSE repeat('k', greatest(place, n // 2)) END) AS damaged FROM r WHERE m <> 0 OR (107 + 1 + b % 255) % 256 < 128""")
def fuzz_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged samples; flips to bytes beyond ASCII are left to tests, since SQL has texts only."""
    n = F.when(digit(1, 9) == 0, 0).otherwise(digit(1, 50) + 40).cast("int")
    files = files_of(spark, sf_dir, F.lit("notes.cfg"), F.repeat(F.lit("k"), n)).select("p_partkey", "relative_path", "sample")
    rows = fuzz.mutated(files, 4, 7)
    readable = F.expr("mutation <> 'flip' OR NOT hex(sample) RLIKE '^(?:..)*?[89A-F]'")
    return rows.where(readable).select("p_partkey", "trial", "mutation", F.md5("sample").alias("damaged"))


@query(f"""WITH r AS (SELECT p_partkey, t, {_DRAWN.replace("notes.cfg", "sample.db").format(what="mutation")} % 2 AS m FROM part, range(0, 3) x(t))
SELECT CASE WHEN p_partkey % 2 = 1 THEN 'binary-hybrid' ELSE 'unmatched' END AS plugin, count(*) AS trials, count(*) FILTER (m = 1 OR p_partkey % 2 = 0) AS kept, 0::BIGINT AS moved, count(*) FILTER (m = 0 AND p_partkey % 2 = 1) AS lost, round(count(*) FILTER (m = 1 OR p_partkey % 2 = 0) / count(*), 6) AS score FROM r GROUP BY 1""")
def fuzz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a detector keeps its files when a line is put before them or they are cut: marks at the top of a file are lost by the first."""
    magic = F.when(on(1), F.concat(F.lit(b"SQLite format 3\x00"), F.repeat(F.lit("\x01"), 80).cast("binary"))).otherwise(F.repeat(F.lit("\x01"), 80).cast("binary"))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.lit("sample.db").alias("name"), F.lit(".db").alias("extension"), F.concat_ws("/", F.col("p_partkey").cast("string"), F.lit("sample.db")).alias("relative_path"), magic.alias("sample"))
    before = Tables(spark, "fuzz").write(classify.classify(decode.with_text(rows)).select("relative_path", "plugin", "format"))
    return fuzz.robustness(before, classify.classify(decode.with_text(fuzz.mutated(rows, 3, 7, ("comment", "cut")))))


_LIMIT, _VOLUME = 60_000, 30_000


def _page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.concat(F.lit(" h/"), F.floor(F.col("page_id") / 20).cast("string"))
    return read(spark, sf_dir, "pages").select(host.alias("host_id"), F.concat(F.lpad((F.col("page_id") % 100).cast("string"), 2, "0"), F.lit("/p"), F.col("page_id").cast("string")).alias("relative_path"), F.col("html").cast("binary").alias("content"))


_ENTRIES = f"""f AS (SELECT 'h-' || (page_id // 20) AS package, lpad((page_id % 100)::VARCHAR, 2, '0') || '/p' || page_id AS entry, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS size FROM pages),
s AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY package ORDER BY string_split(entry, '/') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM f),
w AS (SELECT *, bool_and(before + size <= {_LIMIT}) OVER (PARTITION BY package ORDER BY before, string_split(entry, '/') ROWS UNBOUNDED PRECEDING) AS written FROM s)"""


@query(f"WITH {_ENTRIES} SELECT package, before // {_VOLUME} AS volume, entry, size, sha256(html) AS sha256 FROM w")
def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of hosts' pages hold, in volumes, as read back from them."""
    folder = _archive_folder(spark)
    archive.write_archives(_page_files(spark, sf_dir), folder, volume=_VOLUME)
    return archive.read_archives(spark, folder)


@query(f"WITH {_ENTRIES} SELECT package, count(*) FILTER (written) AS entries, coalesce(sum(size) FILTER (written), 0)::BIGINT AS bytes, count(DISTINCT before // {_VOLUME}) FILTER (written) AS volumes, count(*) FILTER (NOT written) AS refused, CASE WHEN bool_and(written) THEN 'complete' ELSE 'aborted' END AS status FROM w GROUP BY package")
def archive_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each package under a limit of bytes."""
    return archive.write_archives(_page_files(spark, sf_dir), _archive_folder(spark), _LIMIT, _VOLUME)[1]


def _archive_folder(spark: SparkSession) -> str:
    return re.sub("^file:/*", "/", Tables(spark, "archives").root)
