"""Commands over real trees, plugins, stores, packages and loaders."""

import base64
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from configlens import __main__ as command
from configlens import engine
from configlens.operators import classify, diffs, package, profiles, sinks
from configlens.sources import files, sqlite, stores


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "b").mkdir()
    (root / "a.ini").write_text("[main]\nhost = server1.corp.local\npassword = SUPERSECRET123456\n")
    (root / "b" / "c.json").write_text('{"Server": "x", "n": 1}')
    (root / "b" / "notes.txt").write_text("nothing of note here.")
    (root / "link.ini").symlink_to(root / "a.ini")
    return root


def test_budget_limits_what_is_read(spark, tree):
    every = [(r.relative_path, r.length) for r in engine.scan(spark, str(tree), budget=None).orderBy("file_order").collect()]
    assert [p for p, _ in every] == ["a.ini", "b/c.json", "b/notes.txt", "link.ini"]
    limit = every[0][1] + 3
    rows = engine.scan(spark, str(tree), budget=limit).orderBy("file_order").collect()
    assert [(r.relative_path, len(r.sample)) for r in rows] == [("a.ini", every[0][1]), ("b/c.json", 3)]
    assert rows[1].budget_exhausted and rows[1].budget_remaining == 0


def test_links_are_left_out_on_demand(spark, tree):
    assert "link.ini" not in set(files.listed(str(tree), links=False))
    assert {r.relative_path for r in files.scan(spark, str(tree), links="false").collect()} == {"a.ini", "b/c.json", "b/notes.txt"}


def test_python_detectors(spark, tree):
    def notes(path, sample, text):
        if path.endswith("c.json"):
            raise OSError("broken")
        return {"format": "note", "confidence": 0.7, "reasons": ["named so"]} if "notes" in path else None

    plugin = classify.PythonDetector("notes", 10, notes)
    found = {r.relative_path: (r.plugin, r.format) for r in engine.scan(spark, str(tree), using=classify.with_plugins(plugin, plugin)).collect()}
    assert found["b/notes.txt"] == ("notes", "note") and found["b/c.json"] == ("json", "json")
    with pytest.raises(ValueError):
        classify.with_plugins(classify.PythonDetector("json", 1, notes))
    names = classify.detector_summary(spark).orderBy("place").collect()
    assert [r.priority for r in names] == sorted(r.priority for r in names)


def test_commands(spark, tree, tmp_path):
    printed = command.main(["scan", str(tree), "--json"]).splitlines()
    assert [json.loads(x)["detected"] for x in printed] == [True, True, False, True]
    assert "sectioned-ini" in command.main(["scan", str(tree)]).splitlines()[2]
    assert json.loads(command.main(["secrets", str(tree)]).splitlines()[0])["payload"]["rule"] == "PasswordAssignment"
    (tmp_path / "x.txt").write_text("one\ntoken\n")
    (tmp_path / "y.txt").write_text("one\ntwo\n")
    shown = command.main(["diff", str(tmp_path / "x.txt"), str(tmp_path / "y.txt"), "--mask-token", "token"])
    assert "-[REDACTED]" in shown and "+two" in shown


def test_snapshots_are_not_overwritten(spark, tmp_path):
    path = str(tmp_path / "s.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, secret TEXT)")
        c.execute("CREATE TABLE w (k TEXT PRIMARY KEY) WITHOUT ROWID")
        c.execute("CREATE VIEW v AS SELECT secret FROM t")
        c.executemany("INSERT INTO t VALUES (?, ?)", [(1, "a"), (10**12, "b")])
        c.execute("INSERT INTO w VALUES ('x')")
    for _ in range(2):
        manifest = {r.table: r.row_count for r in engine.export_snapshot(spark, path, str(tmp_path / "out"), masked=["t.secret"]).collect()}
    assert manifest == {"t": 2, "w": 1} and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["s", "s-1"]
    assert {r.secret for r in spark.read.json(str(tmp_path / "out" / "s-1" / "t")).collect()} == {"[REDACTED]"}
    assert sqlite.read_table(spark, path, "t", rows_per_task=1).rdd.getNumPartitions() == 2
    assert sqlite.read_table(spark, path, "v").count() == 2 and sqlite.read_table(spark, path, "t", limit=1).count() == 1
    assert sqlite.table_count(path) == 2 and sqlite.table_count(__file__) is None


def test_run_profiles_replace_secrets(spark, tree, tmp_path):
    copied, findings = engine.run_profile(spark, "my profile", [str(tree / "b"), str(tree / "*.ini")][1:], str(tmp_path), "20240101T000000Z")
    rows = copied.collect()
    assert len(rows) == 2 and findings.count() == 2
    text = (tmp_path / "my-profile" / "20240101T000000Z" / rows[0].destination).read_text()
    assert "SUPERSECRET" not in text and "[SECRET]" in text and "host = server1" in text


def test_captures_compare(spark, tree, tmp_path):
    who = {"operator": "o", "environment": "e", "reason": "r"}
    first = engine.capture(spark, str(tree), str(tmp_path), who | {"id": "one"}, tokens=["corp"]).first()
    assert (first.detections, first.mask_token_count, first.retention_days) == (3, 1, 30) and first.total_redactions >= first.hunt_hits > 0
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "a.ini").write_text("[main]\nk = 1\n")
    engine.capture(spark, str(tmp_path / "tree"), str(tmp_path), who | {"id": "two"})
    status = {r.relative_path: r.status for r in engine.compare_captures(*(engine.read_capture(spark, str(tmp_path / n)) for n in ("one", "two"))).collect()}
    assert status["b/c.json"] == "removed" and status["a.ini"] in ("same", "changed")
    with pytest.raises(ValueError):
        engine.capture(spark, str(tree), str(tmp_path), {"id": "x"})


def test_requests_name_the_baseline(spark, tmp_path):
    for host, value in (("a", 1), ("b", 2)):
        (tmp_path / host).mkdir()
        (tmp_path / host / "app.ini").write_text(f"[m]\nk = {value}\n")
    plans = [{"host_id": h, "roots": [str(tmp_path / h)], "baseline": {"is_preferred": h == "b", "priority": 0}} for h in "ab"]
    catalog, status, compared = engine.run_hosts(spark, json.dumps({"schema_version": "multi-server.v1", "plans": plans}))
    assert catalog.first().drift_count == 1 and {r.host_id: r.status for r in status.collect()} == {"a": "drift", "b": "match"}
    assert {r.baseline_host for r in compared.collect()} == {"b"}
    with pytest.raises(ValueError):
        engine.run_hosts(spark, json.dumps({"schema_version": "v9", "plans": plans}))


def test_stores_change_by_copies(spark):
    one = lambda name, *ids: json.dumps({"profiles": [{"name": name, "configs": [{"id": i} for i in ids]}]})
    store = stores.parse_profiles(spark.createDataFrame([(one("p", "a", "b"),), (one("q", "c"),), ("no json",)], "value string"))
    smaller = profiles.remove_config(store, "p", "a")
    ids = lambda s: {r.name: [c.id for c in r.configs] for r in s.collect()}
    assert ids(smaller) == {"p": ["b"], "q": ["c"]} and ids(profiles.remove_profile(store, "q")) == {"p": ["a", "b"]}
    changed = profiles.update_profile(store, "q", lambda row: row.withColumn("description", F.lit("d")))
    assert {r.name: r.description for r in changed.collect()} == {"p": None, "q": "d"}
    with pytest.raises(ValueError):
        profiles.add_profile(store, store.where("name = 'q'"))
    with pytest.raises(KeyError):
        profiles.update_profile(store, "none", lambda row: row)


def test_approvals_go_to_files_and_back(spark, tmp_path):
    rows = stores.parse_approvals(spark.createDataFrame([('[{"token_name": "t", "placeholder": "p", "notes": "n"}]',)], "value string")).drop("position")
    stores.write_approvals_sqlite(rows, str(tmp_path / "a.db"))
    stores.write_approvals_sqlite(rows, str(tmp_path / "a.db"))
    assert stores.read_approvals(spark, str(tmp_path / "a.db")).select("token_name", "notes").collect() == [("t", "n")]
    (tmp_path / "a.json").write_text('[{"token_name": "u", "placeholder": "p"}]')
    assert [r.token_name for r in stores.read_approvals(spark, str(tmp_path / "a.json")).collect()] == ["u"]


def test_keysets():
    aes, mac = bytes(32), bytes(range(40))
    text = json.dumps({"aes_key": {"value": aes.hex(), "encoding": "hex"}, "hmac": {"value": base64.b64encode(mac).decode()}})
    assert package.load_keys(text) == (aes, mac)
    for broken in ("[]", "{}", text.replace("hex", "dpapi"), json.dumps({"aes": {"value": "AA=="}, "mac_key": {"value": "AA=="}})):
        with pytest.raises(ValueError):
            package.load_keys(broken)


def test_collected_folders_are_not_walked_again(spark):
    paths = spark.createDataFrame([("/a/b/c",), ("/a/bc",), ("/x",)], "path string")
    kept = package.outside(paths, spark.createDataFrame([("/a/b/",)], "folder string"))
    assert {r.path for r in kept.collect()} == {"/a/bc", "/x"}


def test_all_messages_are_sent(spark):
    sent = []
    sinks.notify(sent.append, sinks.slack_payload)(spark.range(250).selectExpr("CAST(id AS STRING) AS title", "'b' AS body", "'v' AS k"), 0)
    assert len(sent) == 250 and json.loads(sent[0])["text"].endswith("k: v")
    mail = sinks.mail_payload({"title": "t", "body": "b", "k": "v"}, "a@example.com", ["b@example.com"])
    assert "Subject: t" in mail and "k: v" in mail
    assert json.loads(sinks.teams_payload({"title": "t", "body": "b", "k": "v"}))["sections"][0]["facts"] == [{"name": "k", "value": "v"}]


def test_diffs_are_written_by_name(spark, tmp_path):
    rows = spark.createDataFrame([("x/a b.ini", "y/c.ini", "-1\n+2")], "before_path string, after_path string, diff string")
    sinks.write_patches(rows, str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").iterdir() if p.is_dir()] == ["patch=a-b--c.patch"]


def test_profiles_meet_scans(spark, tree):
    store = stores.parse_profiles(spark.createDataFrame([('{"profiles": [{"name": "p", "tags": ["t"], "configs": [{"id": "i", "path_glob": "*.ini"}, {"id": "j", "path": "b/c.json"}]}]}',)], "value string"))
    rows = {r.relative_path: [c.config_id for c in r.profiles or ()] for r in engine.scan_with_profiles(engine.scan(spark, str(tree)), store, ["t"]).collect()}
    assert rows == {"a.ini": ["i"], "link.ini": ["i"], "b/c.json": ["j"], "b/notes.txt": []}


def test_plans_are_checked():
    for wrong in ({"content_type": "yaml"}, {"context_lines": -1}):
        with pytest.raises(ValueError):
            diffs.DiffPlan(**wrong)
