"""Scanning, decoding and classifying real trees."""

import hashlib
import sqlite3

import pytest

from configlens import engine
from configlens.operators import classify
from configlens.sources import decode, files, sqlite

CASES = {
    "web/web.config": ('<?xml version="1.0"?>\n<configuration>\n  <system.web><compilation debug="true"/></system.web>\n</configuration>\n', "structured-config-xml", "web-config"),
    "web/web.Release.config": ('<configuration xmlns:xdt="http://schemas.microsoft.com/XML-Document-Transform">\n <a xdt:Transform="Remove"/>\n</configuration>', "structured-config-xml", "web-config-transform"),
    "app/appsettings.json": ('{"Server": "a", "Logging": {"LogLevel": {"Default": "Info"}}}', "json", "structured-settings-json"),
    "app/plain.json": ('{"a": [1, 2]}', "json", "generic"),
    "app/commented.jsonc": ('// c\n{"a": "http://x" /* y */}', "json", "jsonc"),
    "app/app.ini": ("; first\n[Main]\nTelemetryEnabled=1\nApiBase=x\n", "ini", "sectioned-ini"),
    ".env": ("API_KEY=abc\nexport MODE=prod\n", "ini", "dotenv"),
    "deploy/pod.yaml": ("apiVersion: v1\nkind: Pod\nmetadata:\n  name: x\n", "yaml", "kubernetes-manifest"),
    "deploy/list.yml": ("---\n- a\n- b\n...\n", "yaml", "generic"),
    "conf/settings.toml": ('[tool]\nname = "x"\nlist = [1]\n', "toml", "generic"),
    "conf/pipeline.conf": ("input {\n  beats { port => 1 }\n}\noutput {\n stdout {}\n}\n", "unix-conf", "logstash-pipeline"),
    "conf/job.hcl": ('job "a" {\n  count = 1\n}\n', "hcl", "hashicorp-nomad"),
    "Dockerfile": ("# c\nFROM x:1\nRUN y\n", "dockerfile", "generic"),
    "ssh/sshd_config": ("Port 22\nPermitRootLogin no\nSubsystem sftp internal\nUsePAM yes\n", "unix-conf", "openssh-conf"),
    "msbuild/Project.csproj": ("<Project Sdk=\"x\"><PropertyGroup><TargetFramework>n</TargetFramework></PropertyGroup></Project>", "xml", "msbuild-project"),
    "loc/Strings.resx": ('<root><data name="A"><value>b</value></data></root>', "xml", "resource-xml"),
    "scan/r.json": ('{"registry_scan": {"token": "x", "keywords": []}}', "registry-live", "scan-definition"),
    "notes.txt": ("just a sentence, nothing else.", None, None),
    "empty.cfg": ("", None, None),
    "_hidden.cfg": ("[a]\nb=1\n", "ini", "sectioned-ini"),
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, (content, *_) in CASES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)
    (root / "data.db").write_bytes(b"SQLite format 3\x00" + bytes(84))
    (root / "utf16.ini").write_bytes("[a]\nb=1\nc=2\n".encode("utf-16"))
    return root


def test_lists_hidden_and_empty_files(spark, tree):
    rows = files.scan(spark, str(tree), files_per_task=3, sample_size=4).collect()
    assert {r.relative_path for r in rows} == {*CASES, "data.db", "utf16.ini"}
    assert all(len(r.sample) <= 4 for r in rows)
    assert next(r for r in rows if r.name == "empty.cfg").length == 0


def test_glob_limits_the_listing(spark, tree):
    found = {r.relative_path for r in files.scan(spark, str(tree), glob="app/*.json").collect()}
    assert found == {"app/appsettings.json", "app/plain.json"}


def test_classifies(spark, tree):
    rows = {r.relative_path: r for r in engine.scan(spark, str(tree)).collect()}
    got = {p: (rows[p].format, rows[p].variant) for p in CASES}
    assert got == {p: (f, v) for p, (_, f, v) in CASES.items()}
    assert rows["data.db"].format == "embedded-sql-db"
    assert rows["utf16.ini"].format == "ini"
    assert rows["conf/job.hcl"].catalog_format == "ini"
    assert all(0 < r.confidence <= 0.98 for r in rows.values() if r.format)


def test_classification_does_not_depend_on_partitions(spark, tree):
    few, many = (classify.classify(decode.with_text(files.scan(spark, str(tree), files_per_task=k))).select("relative_path", "format", "variant", "confidence") for k in (1000, 1))
    assert few.exceptAll(many).isEmpty() and many.exceptAll(few).isEmpty()


def test_decodes(spark):
    samples = [b"", b"\xef\xbb\xbfab", "ab".encode("utf-16"), b"a\x00b\x00c\x00d\x00", b"\xe9t\xe9 et plus de texte", b"\x00\x01\x02\x03\xff" * 9, "é".encode()[:1], None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, sample binary")
    got = {r.i: (r.text, r.encoding) for r in decode.with_text(rows).collect()}
    assert got[0] == ("", "utf-8") and got[1] == ("ab", "utf-8-sig") and got[2] == ("ab", "utf-16-le")
    assert got[3] == ("a\0b\0c\0d\0", "utf-8") and got[5] == (None, None) and got[7] == (None, None)


def test_sensitive_keys(spark):
    rows = spark.createDataFrame([("p", "db_password=1\nUser=2\nApi_Key: 3\nsecret = 4\n")], "path string, text string")
    got = {r.category: (r["count"], r["keys"]) for r in classify.sensitive_keys(rows).collect()}
    assert got == {"credentials": (2, ["db_password", "secret"]), "tokens": (1, ["Api_Key"])}


def test_compares_hosts(spark, tmp_path):
    for host, debug in (("a", "true"), ("b", "false"), ("c", "true")):
        (tmp_path / host).mkdir()
        (tmp_path / host / "web.config").write_text(f'<configuration>\n<system.web debug="{debug}"   x="1"/>\n</configuration>')
        (tmp_path / host / "app.ini").write_text("[a]\nk=1\n" if host != "c" else "[a]\nk=1  \r\n")
    roots = {h: [str(tmp_path / h)] for h in ("a", "b", "c", "gone")}
    (tmp_path / "gone").mkdir()
    catalog, status, _ = engine.compare_hosts(spark, roots)
    rows = {r.config_id: r for r in catalog.collect()}
    web, ini = rows["structured-config-xml/web-config/web-config"], rows["ini/sectioned-ini/app-ini"]
    assert (web.drift_count, web.coverage, ini.drift_count) == (1, "partial", 0)
    got = {(r.host_id, r.config_id): r.status for r in status.collect()}
    assert got[("b", web.config_id)] == "drift" and got[("a", web.config_id)] == "match" and got[("gone", ini.config_id)] == "missing"


def test_reads_sqlite(spark, tmp_path):
    path = str(tmp_path / "s.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE accounts (id INTEGER PRIMARY KEY, email TEXT, secret TEXT, balance REAL)")
        c.executemany("INSERT INTO accounts (email, secret, balance) VALUES (?, ?, ?)", [("alice@example.com", "token-1", 42.5), ("bob@example.com", "token-2", 13.75)])
    assert sqlite.tables(path) == ["accounts"]
    from configlens.operators import snapshots

    table = sqlite.read_table(spark, path, "accounts")
    assert table.dtypes == [("id", "bigint"), ("email", "string"), ("secret", "string"), ("balance", "double")]
    rows = snapshots.snapshot(table, "accounts", ["secret"], ["email"], "pepper", "[MASK]").orderBy("id").collect()
    assert [r.secret for r in rows] == ["[MASK]"] * 2
    assert rows[0].email == "sha256:50f3e4e3818005ad5fb413ff436c7043c05e0b9d89df4229cd588d13f2ae9bb7"
    assert rows[1].email == "sha256:" + hashlib.sha256(b'accounts.email:pepper"bob@example.com"').hexdigest()
