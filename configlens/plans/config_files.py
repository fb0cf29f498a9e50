"""Queries that classify, decode and canonicalise configuration files, and their SQL.

The tables hold no such files, so parts stand for them: the digits of a part's key
say which signals its file has. The SQL never looks at a text; it says from the
same digits what has to be found.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise_text
from ..operators import classify, diffs, metadata, sinks, summary
from ..sources import decode
from .registry import query, read


def digit(divisor: int, base: int = 2) -> Column:
    """A digit of a part's key."""
    return F.expr(f"(p_partkey DIV {divisor}) % {base}")


def sql_digit(divisor: int, base: int = 2) -> str:
    return f"((p_partkey // {divisor}) % {base})"


def on(divisor: int) -> Column:
    return digit(divisor) == 1


def if_(condition: Column, then: str, otherwise: str = "") -> Column:
    return F.when(condition, F.lit(then)).otherwise(F.lit(otherwise))


def files_of(spark: SparkSession, sf_dir: str, name: Column, text: Column | Sequence[Column]) -> DataFrame:
    """p_partkey, name, extension, relative_path, sample and decoded text of one file for each part."""
    body = text if isinstance(text, Column) else F.concat(*text)
    rows = read(spark, sf_dir, "part").select("p_partkey", name.alias("name"), body.cast("binary").alias("sample"))
    extension = F.lower(F.coalesce(F.nullif(F.regexp_extract("name", r"(?<=.)(\.[^.]*)\z", 1), F.lit("")), F.lit("")))
    return decode.with_text(rows.withColumn("extension", extension).withColumn("relative_path", F.concat_ws("/", F.col("p_partkey").cast("string"), "name")))


def _detected(spark: SparkSession, sf_dir: str, plugin: str | None, name: Column, text: Sequence[Column] | Column) -> DataFrame:
    using = [d for d in classify.detectors() if d.plugin == plugin] if plugin else None
    rows = classify.classify(files_of(spark, sf_dir, name, text), using)
    return rows.select("p_partkey", "plugin", "format", "variant", F.round("confidence", 4).alias("confidence"), F.size(F.coalesce("reasons", F.array().cast("array<string>"))).cast("bigint").alias("n_reasons"), "needs_review")


def _expected(plugin: str, gate: str, format: str, variant: str, confidence: str, reasons: str, review: str = "FALSE", top: float = 0.95, given: str = "SELECT * FROM part") -> str:
    """SQL of the rows that a detector has to give."""
    return f"""WITH given AS ({given}) SELECT p_partkey, CASE WHEN {gate} THEN '{plugin}' END AS plugin, CASE WHEN {gate} THEN {format} END AS format, CASE WHEN {gate} THEN {variant} END AS variant,
  CASE WHEN {gate} THEN round(least({top}, {confidence}), 4)::DOUBLE END AS confidence, CASE WHEN {gate} THEN ({reasons})::BIGINT ELSE 0 END AS n_reasons, ({gate}) AND ({review}) AS needs_review FROM given"""


def _bits(**of: str) -> str:
    return "SELECT p_partkey, " + ", ".join(f"{expression} AS {name}" for name, expression in of.items()) + " FROM part"


@query(_expected("dockerfile", "a + b + c >= 2", "'dockerfile'", "'generic'", "0.6 + 0.1 * a + 0.15 * b + 0.1 * c", "a + b + c", given=_bits(a=sql_digit(1), b=sql_digit(2), c=sql_digit(4))))
def classify_dockerfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of a name, a first FROM and instructions make a Dockerfile."""
    text = [if_(on(2), "# syntax\n\nFROM base:1\n", "# none\n"), if_(on(4), "RUN make all\n", "made by hand\n")]
    return _detected(spark, sf_dir, "dockerfile", if_(on(1), "Dockerfile.dev", "build.txt"), text)


@query(_expected("hcl", "x + least(b, 1) + c >= 2", "'hcl'", "CASE b WHEN 1 THEN 'hashicorp-nomad' WHEN 2 THEN 'hashicorp-vault' WHEN 3 THEN 'hashicorp-consul' ELSE 'generic' END", "0.55 + 0.2 * x + 0.15 * least(b, 1) + 0.05 * c", "x + least(b, 1) + c", given=_bits(b=sql_digit(1, 5), c=sql_digit(5), x=sql_digit(10))))
def classify_hcl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of a suffix, blocks and assignments; the block's name tells the product."""
    block = F.element_at(F.array(*map(F.lit, ("nothing here\n", 'job "web" {\n}\n', 'seal "x" {\n}\n', "server {\n}\n", "client {\n}\n"))), (digit(1, 5) + 1).cast("int"))
    return _detected(spark, sf_dir, "hcl", if_(on(10), "main.hcl", "main.txt"), [block, if_(on(5), "count = 3\n")])


@query(_expected("conf", "b >= 1", "'unix-conf'", "'logstash-pipeline'", "0.72 + CASE WHEN b >= 2 THEN 0.08 ELSE 0 END", "1", given=_bits(b=sql_digit(1, 4))))
def classify_log_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a log pipeline, surer from two on."""
    text = [if_(digit(1, 4) > k, f"{name} {{\n  plugin => {k}\n}}\n", "# no block\n") for k, name in enumerate(("input", "filter", "output"))]
    return _detected(spark, sf_dir, "conf", F.lit("pipeline.conf"), text)


@query(_expected("registry-live", "k < 2", "'registry-live'", "'scan-definition'", "0.65 + 0.05 * (a + b + c)", "1 + a + b + c", top=0.9, given=_bits(k=sql_digit(1, 4), a=sql_digit(4), b=sql_digit(8), c=sql_digit(16))))
def classify_registry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of registry scans in JSON and YAML."""
    parts = [if_(on(2 ** (2 + i)), f'"{word}": 1, ') for i, word in enumerate(("token", "keywords", "patterns"))]
    lines = [if_(on(2 ** (2 + i)), f"  {word}: 1\n") for i, word in enumerate(("token", "keywords", "patterns"))]
    json = F.concat(F.lit('{"registry_scan": {'), *parts, F.lit('"z": 0}}'))
    yaml = F.concat(F.lit("# scan\nregistry_scan:\n  z: 0\n"), *lines)
    kind = digit(1, 4)
    text = F.when(kind == 0, json).when(kind < 3, yaml).otherwise(F.concat(F.lit('{"scan": {'), *parts, F.lit('"z": 0}}')))
    return _detected(spark, sf_dir, "registry-live", F.when(kind == 1, "scan.yml").when(kind == 2, "scan.txt").otherwise("scan.json"), text)


@query(_expected("binary-hybrid", "k IN (0, 1) OR (k = 2 AND m = 1)", "CASE k WHEN 0 THEN 'embedded-sql-db' WHEN 1 THEN 'plist' ELSE 'markdown-config' END", "CASE k WHEN 0 THEN 'generic' WHEN 1 THEN 'binary-plist' ELSE 'embedded-yaml-frontmatter' END", "CASE k WHEN 0 THEN 0.98 WHEN 1 THEN 0.92 ELSE 0.8 END", "1", top=0.98, given=_bits(k=sql_digit(1, 4), m=sql_digit(4))))
def classify_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of databases and property lists, and front matter of Markdown files."""
    kind = digit(1, 4)
    text = F.when(kind == 0, F.unhex(F.lit(b"SQLite format 3\x00".hex() + "00" * 84))).when(kind == 1, F.unhex(F.lit(b"bplist00\xd1".hex()))).when(kind == 2, F.lit("---\ntitle: x\n---\nbody\n").cast("binary")).otherwise(F.lit("-- nothing\n").cast("binary"))
    return _detected(spark, sf_dir, "binary-hybrid", if_(on(4), "file.md", "file.dat"), text)


_YAML = "(nested = 1 OR n >= 3 OR (n > 0 AND items = 1))"


@query(_expected("yaml", f"({_YAML} OR (x = 1 AND (n > 0 OR items = 1 OR started = 1)))", "'yaml'", "CASE WHEN kube = 1 THEN 'kubernetes-manifest' ELSE 'generic' END", "0.5 + 0.15 * x + CASE WHEN n > 0 THEN 0.1 ELSE 0 END + 0.1 * nested + 0.05 * items + 0.05 * started + 0.05 * kube", "x + (n > 0)::INT + nested + items + started + kube", review="tabs = 1", given=f"SELECT *, keys + 2 * nested + 2 * kube + tabs AS n FROM ({_bits(x=sql_digit(1), keys=sql_digit(2, 4), nested=sql_digit(8), items=sql_digit(16), started=sql_digit(32), kube=sql_digit(64), tabs=sql_digit(128))})"))
def classify_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, nesting, items, markers; Kubernetes by two keys; tabs need review."""
    text = [if_(on(32), "---\n"), *(if_(digit(2, 4) > k, f"key{k}: {k}\n") for k in range(3)), if_(on(8), "top:\n  inner: 1\n"), if_(on(16), "- item\n"), if_(on(64), "apiVersion: v1\nkind: Pod\n"), if_(on(128), "tab:\t1\n"), F.lit("plain\n")]
    return _detected(spark, sf_dir, "yaml", if_(on(1), "a.yaml", "a.txt"), text)


@query(_expected("toml", "arrays + tables + greatest(quoted, plain) + quoted >= 2 AND (x = 1 OR arrays = 1 OR quoted = 1)", "'toml'", "CASE WHEN arrays = 1 THEN 'array-of-tables' ELSE 'generic' END", "0.5 + 0.12 * x + 0.15 * arrays + 0.1 * tables + 0.05 * greatest(quoted, plain) + 0.05 * quoted", "x + arrays + tables + greatest(quoted, plain) + quoted", given=_bits(x=sql_digit(1), arrays=sql_digit(2), tables=sql_digit(4), quoted=sql_digit(8), plain=sql_digit(16))))
def classify_toml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables, arrays of tables and values that only TOML writes."""
    text = [if_(on(2), "[[server]]\n"), if_(on(4), "[owner]\n"), if_(on(8), 'name = "x"\n'), if_(on(16), "count = 1\n"), F.lit("# end\n")]
    return _detected(spark, sf_dir, "toml", if_(on(1), "a.toml", "a.txt"), text)


@query(_expected("json", "TRUE", "'json'", "CASE WHEN settings = 1 THEN 'structured-settings-json' WHEN noted = 1 THEN 'jsonc' ELSE 'generic' END", "0.7 + 0.1 * greatest(x, settings) + 0.2 * valid + 0.07 * settings + 0.03 * noted", "2 + greatest(x, settings) + 2 * valid + settings + noted", review="valid = 0 AND noted = 0", given=_bits(x=sql_digit(1), noted=sql_digit(2), valid=sql_digit(4), settings=sql_digit(8))))
def classify_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON with and without comments, whole and broken, and application settings."""
    text = [if_(on(2), "// a note\n"), if_(on(4), '{"a": [1, "//no"]}', '{"a": [1, "//no"}')]
    return _detected(spark, sf_dir, "json", F.when(on(8), "appsettings.Test.json").otherwise(if_(on(1), "a.json", "a.txt")), text)


@query(_expected("ini", "n > 0", "'ini'", "CASE WHEN e = 1 THEN 'dotenv' WHEN s = 1 THEN 'sectioned-ini' ELSE 'sectionless-ini' END", "0.55 + 0.2 * s + CASE WHEN n >= 6 THEN 0.05 ELSE 0 END + 0.1 * x + 0.08 * e + 0.05 * c", "1 + s + (n >= 6)::INT + x + e + c", review="m = 1", given=f"SELECT *, keys + e AS n FROM ({_bits(s=sql_digit(1), keys=sql_digit(2, 8), x=sql_digit(16), c=sql_digit(32), e=sql_digit(64), m=sql_digit(128))})"))
def classify_ini(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections, assignments, exports and comments; a bracket that stays open needs review."""
    text = [if_(on(32), "; note\n"), if_(on(1), "[main]\n"), *(if_(digit(2, 8) > k, f"key{k} = {k}\n") for k in range(7)), if_(on(64), "export MODE=test\n"), if_(on(128), "[open\n"), F.lit("\n")]
    return _detected(spark, sf_dir, "ini", if_(on(16), "a.ini", "a.txt"), text)


_XML = [  # name, root, format, variant, with the weights of a configuration root and of a transform
    ("web.config", "configuration", "structured-config-xml", "web-config", 0.1),
    ("web.Release.config", "configuration", "structured-config-xml", "web-config-transform", 0.15),
    ("a.csproj", "Project", "xml", "msbuild-project", 0.0),
    ("a.resx", "root", "xml", "resource-xml", 0.0),
    ("a.xaml", "Page", "xml", "interface-xml", 0.0),
    ("a.xsl", "style", "xml", "xslt-xml", 0.0),
    ("a.xml", "a", "xml", "generic", 0.0),
    ("app.config", "configuration", "structured-config-xml", "app-config", 0.1),
]


def _of_xml(k: int) -> str:
    return "CASE k " + " ".join(f"WHEN {i} THEN {x[k]!r}" for i, x in enumerate(_XML)) + " END"


@query(_expected("xml", "TRUE", _of_xml(2), _of_xml(3), f"0.8 + 0.1 * d + 0.05 * s + ({_of_xml(4)})", "2 + d + s + CASE k WHEN 1 THEN 2 WHEN 0 THEN 1 WHEN 7 THEN 1 ELSE 0 END", given=_bits(k=sql_digit(1, 8), d=sql_digit(8), s=sql_digit(16))))
def classify_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of XML by name, suffix and root."""
    pick = lambda i: F.element_at(F.array(*(F.lit(x[i]) for x in _XML)), (digit(1, 8) + 1).cast("int"))
    text = [if_(on(8), '<?xml version="1.0"?>\n'), F.lit("<"), pick(1), if_(on(16), ' xmlns="urn:x"'), F.lit(">\n</"), pick(1), F.lit(">\n")]
    return _detected(spark, sf_dir, "xml", pick(0), text)


@query(_expected("text", "d >= 4 AND a <= 1", "'unix-conf'", "'generic-directive-text'", "0.68", "1 + c", top=0.9, given=_bits(d=sql_digit(1, 7), a=sql_digit(7, 3), c=sql_digit(21))))
def classify_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of directives with hardly any assignment."""
    text = [if_(on(21), "# note\n"), *(if_(digit(1, 7) > k, f"Option{k} value\n") for k in range(6)), *(if_(digit(7, 3) > k, f"k{k}=1\n") for k in range(2)), F.lit("\n")]
    return _detected(spark, sf_dir, "text", F.lit("daemon.rules"), text)


_KINDS = [  # name, text, plugin, format, variant, catalog format, severity
    ("Dockerfile", "FROM x:1\nRUN y\n", "dockerfile", "dockerfile", "generic", "script-config", "high"),
    ("job.hcl", 'job "a" {\n  count = 1\n}\n', "hcl", "hcl", "hashicorp-nomad", "ini", "medium"),
    ("pod.yaml", "apiVersion: v1\nkind: Pod\n", "yaml", "yaml", "kubernetes-manifest", "yaml", "medium"),
    ("s.toml", '[tool]\nname = "x"\n', "toml", "toml", "generic", "toml", "medium"),
    (".env", "export MODE=prod\nKEY=1\n", "ini", "ini", "dotenv", "ini", "high"),
    ("a.json", '{"a": [1, 2]}', "json", "json", "generic", "json", "medium"),
    ("app.config", "<configuration>\n</configuration>", "xml", "structured-config-xml", "app-config", "structured-config-xml", "high"),
    ("sshd_config", "Port 22\nUsePAM yes\nSubsystem sftp internal\nPermitRootLogin no\n", "text", "unix-conf", "openssh-conf", "unix-conf", "high"),
    ("notes.txt", "just a sentence, nothing else.", None, None, None, None, None),
    ("data.db", "SQLite format 3\x00", "binary-hybrid", "embedded-sql-db", "generic", "embedded-sql-db", "high"),
]


def _kind(i: int) -> str:
    word = lambda x: "NULL" if x is None else f"'{x}'"
    return f"CASE p_partkey % {len(_KINDS)} " + " ".join(f"WHEN {k} THEN {word(x[i])}" for k, x in enumerate(_KINDS)) + " END"


def _all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (digit(1, len(_KINDS)) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*(F.lit(x[i]) for x in _KINDS)), at)
    return classify.with_catalog(classify.classify(files_of(spark, sf_dir, pick(0), pick(1))))


_ALL_KINDS = f"WITH kinds AS (SELECT p_partkey, p_partkey || '/' || {_kind(0)} AS relative_path, {_kind(2)} AS plugin, {_kind(3)} AS format, {_kind(4)} AS variant, {_kind(5)} AS catalog_format, {_kind(6)} AS catalog_severity FROM part)"


@query(f"{_ALL_KINDS} SELECT p_partkey, plugin, format, variant, catalog_format, catalog_severity FROM kinds")
def classify_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all kinds, by all detectors in their order, with catalog names and severities."""
    return _all_kinds(spark, sf_dir).select("p_partkey", "plugin", "format", "variant", "catalog_format", "catalog_severity")


@query(f"{_ALL_KINDS} SELECT coalesce(plugin, 'unmatched') AS plugin, count(*)::BIGINT AS files FROM kinds GROUP BY 1")
def detector_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the detector that claims them."""
    return classify.coverage(_all_kinds(spark, sf_dir))


@query(f"{_ALL_KINDS} SELECT catalog_severity, count(*)::BIGINT AS detections FROM kinds GROUP BY 1")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the catalog's severity."""
    return summary.severity_counts(_all_kinds(spark, sf_dir))


@query(f"""{_ALL_KINDS} SELECT relative_path AS "Path", coalesce(format, '\u2014') AS "Format", coalesce(variant, '\u2014') AS "Variant", coalesce(catalog_severity, '\u2014') AS "Severity", '\u2014' AS "Severity hint", '\u2014' AS "Metadata keys", plugin IS NULL AS nothing FROM kinds""")
def scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the table that a scan prints, but for confidences."""
    table = sinks.scan_table(_all_kinds(spark, sf_dir))
    return table.withColumn("nothing", F.col("Confidence") == sinks.NOTHING).drop("Confidence")


@query(f"""{_ALL_KINDS} SELECT p_partkey, CASE WHEN plugin IS NULL THEN '{{"detected":false,"path":"' || relative_path || '"}}' ELSE '"detected":true,"format":"' || format || '","path":"' || relative_path || '","severity":"' || catalog_severity || '","variant":"' || variant || '"}}' END AS tail FROM kinds""")
def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON object that a scan prints for each file, undetected ones too; without the confidence at its head."""
    rows = _all_kinds(spark, sf_dir)
    printed = sinks.scan_json(rows)
    key = F.regexp_extract("value", r'"path":"(\d+)/', 1).cast("bigint")
    return printed.select(key.alias("p_partkey"), F.regexp_replace("value", r'\A\{"confidence":[0-9.]+,', "").alias("tail"))


@query("""SELECT p_partkey, CASE WHEN k = 5 THEN NULL ELSE CASE k WHEN 1 THEN 'utf-8-sig' WHEN 2 THEN 'utf-16-le' WHEN 3 THEN 'utf-16-be' WHEN 4 THEN 'latin-1' ELSE 'utf-8' END END AS encoding,
  CASE k WHEN 5 THEN NULL WHEN 4 THEN t || CASE WHEN length(t) % 2 = 0 THEN '!' ELSE '' END || 'caf\u00e9 and more text after it.' WHEN 6 THEN '' ELSE t END AS text FROM (SELECT p_partkey, p_name || ' of part ' || p_partkey || '.' AS t, p_partkey % 7 AS k FROM part)""")
def decoded_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in several encodings, with and without marks, binary and empty ones."""
    text = F.concat("p_name", F.lit(" of part "), F.col("p_partkey").cast("string"), F.lit("."))
    k, hex_ = digit(1, 7), lambda x: F.unhex(F.lit(x))
    sample = (
        F.when(k == 1, F.concat(hex_("EFBBBF"), text.cast("binary")))
        .when(k == 2, F.concat(hex_("FFFE"), F.encode(text, "UTF-16LE")))
        .when(k == 3, F.concat(hex_("FEFF"), F.encode(text, "UTF-16BE")))
        .when(k == 4, F.concat(text.cast("binary"), F.when(F.length(text) % 2 == 0, F.lit("!")).otherwise("").cast("binary"), hex_("caf\u00e9 and more text after it.".encode("latin-1").hex())))
        .when(k == 5, F.concat(hex_("00010203FF" * 9), text.cast("binary")))
        .when(k == 6, F.lit("").cast("binary"))
        .otherwise(text.cast("binary"))
    )
    rows = decode.with_text(read(spark, sf_dir, "part").select("p_partkey", sample.alias("sample")))
    return rows.select("p_partkey", "encoding", "text")


@query(r"""SELECT doc_id, sha256(array_to_string(list_transform(string_split(regexp_replace(replace(text, ' the ', chr(32) || chr(32) || chr(13) || chr(10)), chr(13) || chr(10) || '?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '[\s\x1c-\x1f\x{85}\x{a0}]+$', '')), chr(10))) AS canonical_sha256 FROM documents""")
def canonical_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with other line ends and blanks at line ends in canonical form."""
    text = F.replace(F.col("text"), F.lit(" the "), F.lit("  \r\n"))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(normalise_text(text).cast("binary"), 256).alias("canonical_sha256"))


@query(r"""SELECT p_partkey, '{' || chr(10) || '  "a": [' || chr(10) || '    ' || p_size || ',' || chr(10) || '    null' || chr(10) || '  ],' || chr(10) || '  "b": "' || p_name || chr(233) || '",' || chr(10) || '  "z": 1.0' || chr(10) || '}' AS canonical,
  '{"a":[' || p_size || ',null],"b":"' || p_name || chr(233) || '","z":1.0}' AS compact FROM part""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON with sorted keys, indented and compact; of a repeated key the last value stays."""
    text = F.concat(F.lit('{"z": 1.0, "b": "x", "a": [ '), F.col("p_size").cast("string"), F.lit(', null], "b": "'), "p_name", F.lit('\\u00e9"}'))
    return read(spark, sf_dir, "part").select("p_partkey", diffs.canonical(text, "json").alias("canonical"), diffs.canonical(text, "json", compact=True).alias("compact"))


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN '<a><b>open</a>' ELSE (CASE WHEN p_partkey % 3 = 1 THEN '<?xml version="1.0"?>' || chr(10) || '<!DOCTYPE a>' || chr(10) ELSE '' END) || '<a k="' || p_size || '" z="1">' || chr(10) || '  <b>' || p_name || '</b>' || chr(10) || '  <c />' || chr(10) || '</a>' END AS canonical FROM part""")
def canonical_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML with sorted attributes and its head; what isn't well-formed stays text."""
    head = if_(digit(1, 3) == 1, '<?xml version="1.0"?>\r\n<!DOCTYPE a>')
    text = F.concat(head, F.lit('<a z="1"   k="'), F.col("p_size").cast("string"), F.lit('">\n\n<b>'), "p_name", F.lit("</b>   <c/></a>"))
    text = F.when(digit(1, 3) == 2, "<a><b>open</a>  ").otherwise(text)
    return read(spark, sf_dir, "part").select("p_partkey", diffs.canonical(text, "xml").alias("canonical"))


@query("""SELECT p_partkey, (p_partkey % 2)::BIGINT AS removed, (CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END)::BIGINT AS added, (CASE WHEN p_partkey % 5 = 0 THEN 3 ELSE 0 END)::BIGINT AS changed,
  (p_partkey % 2 + CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN 3 ELSE 0 END)::BIGINT AS drift_lines, FALSE AS truncated FROM part""")
def line_diff_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines removed, added and changed by edits at known places."""
    at = F.sequence(F.lit(1), F.lit(20) + F.col("p_size"))
    line = lambda i: F.concat(F.col("p_partkey").cast("string"), F.lit(" "), i.cast("string"))
    three, five, odd = (F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 5 == 0, F.col("p_partkey") % 2 == 1)
    kept = F.filter(at, lambda i: ~(odd & (i == 2)))
    edited = F.transform(kept, lambda i: F.when(five & i.between(9, 11), F.concat(line(i), F.lit(" new"))).when(three & (i == 17), F.concat(line(i), F.lit("\ninserted\ntwice"))).otherwise(line(i)))
    pairs = read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(at, line), "\n").alias("before"), F.array_join(edited, "\n").alias("after"))
    return diffs.line_diff(pairs).select("p_partkey", "removed", "added", "changed", "drift_lines", "truncated")


@query("""WITH t AS (SELECT n_nationkey, repeat('ab', (n_nationkey * 20000)::BIGINT) AS x FROM nation) SELECT n_nationkey, sha256(CASE WHEN strlen(x) <= 262144 THEN x ELSE substr(x, 1, 262144) || chr(10) || '[cut: ' || strlen(x) || ' bytes, sha256 ' || sha256(x) || ']' END) AS shown_sha256 FROM t""")
def clamped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical texts as they are shown: those beyond the bound are cut, with a digest of the whole."""
    text = F.expr("repeat('ab', CAST(n_nationkey * 20000 AS INT))")
    return read(spark, sf_dir, "nation").select("n_nationkey", F.sha2(diffs.clamped(text).cast("binary"), 256).alias("shown_sha256"))


@query("""SELECT p_partkey, prefix, uri, line::BIGINT AS line, "column"::BIGINT AS "column", substr(sha1(uri), 1, 12) AS fingerprint FROM (
  SELECT p_partkey, NULL AS prefix, 'urn:' || p_size AS uri, 1 AS line, 4 AS "column" FROM part WHERE p_partkey % 2 = 1
  UNION ALL SELECT p_partkey, 'x', 'urn:brand', 2, 3 FROM part WHERE p_partkey % 3 = 0)""")
def xml_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespaces with their places and fingerprints."""
    text = [F.lit("<a"), F.when(on(1), F.concat(F.lit(' xmlns="urn:'), F.col("p_size").cast("string"), F.lit('"'))).otherwise(""), F.lit("\n "), if_(digit(1, 3) == 0, "\txmlns:x='urn:brand'", " k='1'"), F.lit("/>")]
    rows = metadata.xml_namespaces(files_of(spark, sf_dir, F.lit("a.xml"), text).withColumn("path", F.col("p_partkey")))
    return rows.withColumnRenamed("path", "p_partkey")


@query("""SELECT p_partkey, 'urn:' || i AS namespace, 'f' || i || '.xsd' AS location FROM part, range(0, 3) t(i) WHERE i < p_partkey % 4""")
def xml_schema_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of schemaLocation."""
    pairs = [if_(digit(1, 4) > i, f"urn:{i}\n  f{i}.xsd ") for i in range(3)]
    rows = metadata.schema_locations(files_of(spark, sf_dir, F.lit("a.xml"), [F.lit('<a xsi:schemaLocation=" '), *pairs, F.lit('"/>')]).withColumn("path", F.col("p_partkey")))
    return rows.withColumnRenamed("path", "p_partkey")


@query("""SELECT p_partkey, p_size::BIGINT AS key_count, array_to_string(list_transform(range(1, least(p_size, 10) + 1), lambda i: 'K' || i), ',') AS keys FROM part""")
def resource_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys resource files have, and the first ten."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: F.concat(F.lit('<data name="K'), i.cast("string"), F.lit('"><value>v</value></data>\n'))), "")
    rows = metadata.resource_keys(files_of(spark, sf_dir, F.lit("a.resx"), text).withColumn("path", F.col("p_partkey")))
    return rows.select(F.col("path").alias("p_partkey"), "key_count", F.array_join("keys", ",").alias("keys"))


@query("""SELECT p_partkey, kind, sha256(value) AS value_sha256 FROM (SELECT p_partkey, 'connection-string' AS kind, 'Server=' || p_brand AS value FROM part
  UNION ALL SELECT p_partkey, 'endpoint', 'https://h' || p_size || '/api' FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT p_partkey, 'feature-flag', 'on' FROM part WHERE p_partkey % 3 = 0)""")
def attribute_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of connection strings, addresses and switches, each once."""
    one = F.concat(F.lit('<add connectionString="Server='), "p_brand", F.lit('"/>\n'))
    text = [one, one, F.when(on(1), F.concat(F.lit("<client address='https://h"), F.col("p_size").cast("string"), F.lit("/api'/>\n"))).otherwise("<client address='none'/>\n"), if_(digit(1, 3) == 0, '<add key="NewFeature" value="on"/>\n', '<add key="Other" value="on"/>\n')]
    rows = metadata.attribute_hints(files_of(spark, sf_dir, F.lit("a.config"), text).withColumn("path", F.col("p_partkey")))
    return rows.withColumnRenamed("path", "p_partkey")


@query("""SELECT p_partkey, 'Build,T' || p_size AS targets, sha256('common.props') AS imports FROM part""")
def build_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets and digests of imports of build files."""
    text = [F.lit('<Project><Import Project="common.props"/><Target Name="Build"/><Target Name="T'), F.col("p_size").cast("string"), F.lit('"/><Import Project="common.props"/></Project>')]
    rows = metadata.build_imports(files_of(spark, sf_dir, F.lit("a.targets"), text).withColumn("path", F.col("p_partkey")))
    return rows.select(F.col("path").alias("p_partkey"), F.array_join("targets", ",").alias("targets"), F.array_join("import_sha256", ",").alias("imports"))


@query("""SELECT p_partkey, 'spaces' AS style, (2 + p_partkey % 3)::BIGINT AS width, CASE WHEN p_partkey % 2 = 1 THEN '5' ELSE '' END AS outlier_lines FROM part""")
def indentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step of indentation, and lines that don't fit it."""
    step = F.expr("repeat(' ', CAST(2 + p_partkey % 3 AS INT))")
    text = [F.lit("a:\n"), step, F.lit("b: 1\n"), step, step, F.lit("c: 1\n"), step, F.lit("d: 1\n"), step, if_(on(1), " "), F.lit("e: 1\n"), F.lit("f:\n"), step, F.lit("g: 1\n")]
    rows = metadata.indentation(files_of(spark, sf_dir, F.lit("a.yaml"), text).withColumn("path", F.col("p_partkey")))
    return rows.select(F.col("path").alias("p_partkey"), "style", "width", F.array_join("outlier_lines", ",").alias("outlier_lines"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '1=1' WHEN 1 THEN '0=0' ELSE '2=0' END AS spacing, CASE WHEN p_partkey % 2 = 1 THEN '3' ELSE '' END AS tab_lines FROM part""")
def assignment_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent blanks around equals signs, and lines with tabs there."""
    sign = F.element_at(F.array(*map(F.lit, (" = ", "=", "  ="))), (digit(1, 3) + 1).cast("int"))
    text = [F.lit("a"), sign, F.lit("1\nb"), sign, F.lit("2\nc"), if_(on(1), "\t=\t", "   =   "), F.lit("3\n")]
    rows = metadata.assignment_spacing(files_of(spark, sf_dir, F.lit("a.toml"), text).withColumn("path", F.col("p_partkey")))
    return rows.select(F.col("path").alias("p_partkey"), "spacing", F.array_join("tab_lines", ",").alias("tab_lines"))


@query("""SELECT p_partkey, category, n AS "count", keys FROM (SELECT p_partkey, 'credentials' AS category, 2::BIGINT AS n, 'db_password,secret' AS keys FROM part
  UNION ALL SELECT p_partkey, 'tokens', 1, 'Api_Key' FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT p_partkey, 'connection', 1, 'DSN' FROM part WHERE p_partkey % 3 = 0)""")
def sensitive_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of settings that hold secrets, by category."""
    text = [F.lit("db_password=1\nUser=2\n"), if_(on(1), "Api_Key: 3\n"), F.lit("secret = 4\n"), if_(digit(1, 3) == 0, "export DSN=5\n")]
    rows = classify.sensitive_keys(files_of(spark, sf_dir, F.lit("a.ini"), text).withColumn("path", F.col("p_partkey")))
    return rows.select(F.col("path").alias("p_partkey"), "category", "count", F.array_join("keys", ",").alias("keys"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Found-It:Here Two|4Th' WHEN 1 THEN 'Same' WHEN 2 THEN '' ELSE 'DoN''T-Touch' END AS reasons FROM part""")
def normalised_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons with single blanks and capitals, each once."""
    given = F.when(digit(1, 4) == 0, F.array(F.lit(" found-it:here \t two"), F.lit("4th"))).when(digit(1, 4) == 1, F.array(F.lit("same"), F.lit(" Same "))).when(digit(1, 4) == 2, F.array(F.lit(" \n"))).otherwise(F.array(F.lit("doN'T-touch")))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(classify.normalised_reasons(given), "|").alias("reasons"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'empty' WHEN 1 THEN NULL WHEN 2 THEN 'not a slug' ELSE NULL END AS issue FROM part""")
def name_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of formats and variants that are no slugs."""
    name = F.element_at(F.array(*map(F.lit, (" \t", " Web-Config_2", "a b", "7zip"))), (digit(1, 4) + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", classify.name_issue(name).alias("issue"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Release' WHEN 2 THEN 'Release,Prod' ELSE '' END AS stages FROM part""")
def transform_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages in names of transforms."""
    name = F.element_at(F.array(*map(F.lit, ("web.config", "Web.Release.config", "app.Release.Prod.config", "other.Release.config"))), (digit(1, 4) + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(classify.transform_stages(name), ",").alias("stages"))
