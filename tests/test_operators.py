"""Operators on small inputs whose results are written out."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from configlens.functions import text as tx
from configlens.operators import approvals, budget, compare, diffs, hosts, hunt, profiles, registry, schedule, secrets, sinks, snapshots, telemetry
from configlens.streaming import events


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize("value", ["", "a", "a\n", "a\r\nb\rc\x0bd\x85e f", "\n\n", "a\n\nb\n", " x \n"])
def test_lines_are_those_of_python(spark, value):
    assert one(spark, value, tx.lines) == value.splitlines()
    assert one(spark, value, tx.line_count) == len(value.splitlines())


def test_normalises_text(spark):
    assert one(spark, "﻿a  \r\n\r\n b\t\rc\xa0", tx.normalise_text) == "a\n\n b\nc"


@pytest.mark.parametrize(
    ("make", "glob", "path", "fits"),
    [
        (tx.glob_anywhere, "*.config", "a/b.config", True),
        (tx.glob_anywhere, "a/?.x", "a/b.x", True),
        (tx.glob_anywhere, "[!a]*", "abc", False),
        (tx.glob_from_right, "*.txt", "a/b.txt", True),
        (tx.glob_from_right, "b/*.txt", "a/b/c.txt", True),
        (tx.glob_from_right, "a/*.txt", "a/b/c.txt", False),
        (tx.glob_from_root, "*.txt", "a/b.txt", False),
        (tx.glob_from_root, "**/*.txt", "a/b.txt", True),
        (tx.glob_from_root, "**/*.txt", "b.txt", True),
        (tx.glob_from_root, "**", "a/.env", True),
    ],
)
def test_globs(spark, make, glob, path, fits):
    assert one(spark, path, lambda c: c.rlike(make(glob))) is fits


def test_redaction_is_progressive(spark):
    row = spark.createDataFrame([("aab aa b",)], "v string")
    text, counts = tx.redact(F.col("v"), ["a", "aa"], "[X]")
    assert row.select(text, counts["aa"], counts["a"]).first()[:] == ("[X]b [X] b", 2, 0)


@pytest.mark.parametrize("value", ["plain", 'q"\\/\n\t', "é😀x", "", None])
def test_hash_is_of_json_text(spark, value):
    assert one(spark, value, tx.json_text) == json.dumps(value)


def test_default_rules_and_exclude(spark):
    files = spark.createDataFrame([("a.conf", "Server host: api.corp.local\nother"), ("b.txt", "server host x.local"), ("c.xml", '<add key="FeatureFlag" value="on"/>\n<x connectionString="Server=1"/>\n<endpoint address="http://h"/>')], "path string, text string")
    hits = hunt.hunt(files, exclude=["*.txt"]).collect()
    assert {(h.path, h.rule, h.line_number) for h in hits} == {("a.conf", "server-name", 1), ("c.xml", "feature-flag", 1), ("c.xml", "connection-string", 2), ("c.xml", "service-endpoint", 3)}
    first = next(h for h in hits if h.rule == "server-name")
    assert first.matches == ["corp", "api.corp"]


def test_transforms_prefer_addresses(spark):
    hits = spark.createDataFrame([("r", "t", "p", 1, "e", ["x", "a.b"]), ("r", "t", "p", 2, "only", []), ("r", None, "p", 3, "e", ["x"])], "rule string, token string, path string, line_number bigint, excerpt string, matches array<string>")
    assert {(r.value, r.placeholder) for r in hunt.plan_transforms(hits).collect()} == {("a.b", "{{ t }}"), ("only", "{{ t }}")}


def test_approvals_match_nulls(spark):
    candidates = spark.createDataFrame([("t", "p", None, 1), ("t", "p", "h", 2)], "token string, placeholder string, excerpt_hash string, n int")
    known = spark.createDataFrame([("t", "p", None, "me", 1), ("t", "p", None, "me", 2)], "token string, placeholder string, excerpt_hash string, by string, position int")
    assert [r.n for r in approvals.approved(candidates, known).collect()] == [1]
    assert [r.n for r in approvals.pending(candidates, known).collect()] == [2]
    assert [r.position for r in approvals.upsert(known.limit(0), known).collect()] == [2]


def test_profiles(spark):
    config = lambda i, path=None, glob=None, app=None: (i, path, glob, app, None, None, [], None, None, False)
    store = spark.createDataFrame([("p", ["prod"], [config("web", "configs/web.config", None, "web"), config("any", None, "*.ini")]), ("q", [], [config("all")])], f"name string, tags array<string>, configs array<{profiles.CONFIG_TYPE}>")
    files = spark.createDataFrame([("./configs//web.config",), ("a/b.ini",), (None,)], "relative_path string")
    given = profiles.provided(["prod", " application:web "])
    got = {(r.relative_path, r.config_id) for r in profiles.matching(files, store, given, ["*.ini"]).collect()}
    assert got == {("./configs//web.config", "web"), ("a/b.ini", "any"), ("./configs//web.config", "all"), ("a/b.ini", "all"), (None, "all")}
    assert {r.config_id for r in profiles.matching(files, store, profiles.provided([]), ["*.ini"]).collect()} == {"all"}
    assert profiles.store_problems(store.union(store)).count() == 5
    diff = profiles.store_diff(profiles.store_summary(store), profiles.store_summary(store.where("name = 'q'")))
    assert {(r.name, r.status) for r in diff.collect()} == {("p", "removed"), ("q", "same")}
    hits = spark.createDataFrame([("a/b.ini", 1), ("x", 2)], "path string, n int")
    nested = {r.n: [x.config_id for x in r.profiles] for r in profiles.bridge(hits, store, given, ["*.ini"]).collect()}
    assert nested == {1: ["any", "all"], 2: ["all"]}


def test_budget_equals_a_sequential_reader(spark):
    sizes = [(i * 37) % 101 + (500 if i % 9 == 0 else 0) for i in range(60)]
    for total in (1, 700, 10**9):
        left, expected = total, {}
        for i, n in enumerate(sizes):
            if left <= 0:
                break
            expected[i] = min(n, 128, left)
            left -= expected[i]
        rows = budget.within_budget(spark.createDataFrame(list(enumerate(sizes)), "i bigint, n bigint"), "i", "n", 128, total, chunk_width=7)
        assert {r.i: r.sample_bytes for r in rows.collect()} == expected


def test_diffs(spark):
    rows = spark.createDataFrame([(1, "a\nb\nc", "a\nX\nc\nd"), (2, "same", "same"), (3, None, "x")], "i int, before string, after string")
    got = {r.i: (r.added, r.removed, r.changed, r.drift_lines) for r in diffs.line_diff(rows).collect()}
    assert got == {1: (1, 0, 1, 2), 2: (0, 0, 0, 0), 3: (1, 0, 0, 1)}
    assert one(spark, '{"b": 1.0, "a": "é", "a": 2}', lambda c: diffs.canonical(c, "json")) == json.dumps({"a": 2, "b": 1.0}, indent=2)
    assert one(spark, "<r b='2' a='1'> <c/> </r>", lambda c: diffs.canonical(c, "xml")) == one(spark, "<r a='1' b='2'>\n<c></c></r>", lambda c: diffs.canonical(c, "xml"))
    assert one(spark, "<!DOCTYPE x []><r/>", lambda c: diffs.canonical(c, "xml")) == "<!DOCTYPE x []><r/>"


def test_secrets(spark):
    files = spark.createDataFrame([("p", "safe line\npassword = SUPERSECRET123456\nkeep me\npassword = skipped12345 skip")], "path string, text string")
    assert [(r.line_number, r.rule, r.snippet) for r in secrets.scan(files, ignore_patterns=["skip$"]).collect()] == [(2, "PasswordAssignment", "[SECRET]")]
    assert secrets.sanitise(files, ignore_patterns=["skip$"]).first().text == "safe line\n[SECRET]\nkeep me\npassword = skipped12345 skip"
    assert secrets.scan(files, [secrets.SecretRule("empty", "^")]).isEmpty()
    assert secrets.compile_rules([{"name": "a", "pattern": "("}, {"name": "b", "pattern": "x", "flags": "i"}, {"pattern": "y"}]) == (secrets.SecretRule("b", "(?i)x"),)
    assert secrets.compile_rules("no") is None and secrets.option_list("a, b;c") == ("a", "b", "c") and secrets.option_list([" a ", None]) == ("a",)
    embedded = {"version": "e", "rules": [{"name": "E", "pattern": "e"}]}
    assert secrets.settings() == secrets.SecretSettings(secrets.SAMPLE_RULES, version=secrets.SAMPLE_VERSION)
    assert secrets.settings(None, {"ruleset": {"rules": "no"}}, embedded) == secrets.SecretSettings((secrets.SecretRule("E", "e"),), version="e")
    inline = secrets.settings({"secret_ignore_rules": "b, a", "secret_ignore_patterns": ["p"]}, {"ruleset": {"rules": []}, "ignore_rules": ["a", "c"], "ignore_patterns": ["(", "p", "q"]}, embedded)
    assert inline == secrets.SecretSettings((), ("b", "a", "c"), ("p", "q")) and secrets.scan(files, inline.rules).isEmpty()
    binary = spark.createDataFrame([(b"a\x00b",), (b"\x10\x01",)], "b binary")
    assert [r[0] for r in binary.select(secrets.is_binary(F.col("b"))).collect()] == [True, False]


def test_intervals_and_windows(spark):
    assert [schedule.interval_seconds(x) for x in ("90", "15m", "1h30m", "PT45M", 5)] == [90, 900, 5400, 2700, 5]
    for bad in ("0m", "x", ""):
        with pytest.raises(ValueError):
            schedule.interval_seconds(bad)
    start, end = F.lit(schedule.seconds_of_day("22:00")), F.lit(schedule.seconds_of_day("02:00"))
    at = lambda t: spark.createDataFrame([(datetime.datetime.fromisoformat(t),)], "t timestamp_ntz").select(schedule.align(F.col("t"), start, end)).first()[0].isoformat()
    assert at("2024-01-01T23:00:00") == "2024-01-01T23:00:00" and at("2024-01-01T01:00:00") == "2024-01-01T01:00:00"
    assert at("2024-01-01T12:00:00") == "2024-01-01T22:00:00"


def test_schedules_stay_due_until_completed(spark):
    t = datetime.datetime(2024, 1, 1, 10)
    rows = spark.createDataFrame([("a", t, False, 3600, None, None), ("b", t + datetime.timedelta(hours=5), False, 3600, None, None)], "name string, next_run timestamp_ntz, pending boolean, every_seconds int, window_start int, window_end int")
    now = F.lit(t + datetime.timedelta(hours=1)).cast("timestamp_ntz")
    assert [(r.name, r.pending) for r in schedule.due(rows, now).collect()] == [("a", True)]
    done = spark.createDataFrame([("a", t + datetime.timedelta(hours=2))], "name string, completed_at timestamp_ntz")
    after = {r.name: (r.next_run.hour, r.pending) for r in schedule.complete(schedule.due(rows, now), done).collect()}
    assert after == {"a": (13, False)}
    later = schedule.skip_until(rows, "a", F.lit(t + datetime.timedelta(hours=9)).cast("timestamp_ntz"))
    assert {r.name: r.next_run.hour for r in later.collect()} == {"a": 19, "b": 15}


def test_registry(spark):
    base = "SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Uninstall\\"
    rows = [("HKLM", "64", base + "A", "DisplayName", "Tool A"), ("HKLM", "64", base + "A", "Publisher", "Acme"), ("HKLM", "32", base + "A", "DisplayName", "Tool A"), ("HKLM", "64", base + "B", "DisplayName", " "), ("HKLM", "64", "SOFTWARE\\Acme\\Tool A\\x", "Endpoint", "http://h")]
    values = spark.createDataFrame(rows, "hive string, view string, key_path string, value_name string, data string")
    apps = registry.installed_apps(values)
    assert [(r.display_name, r.publisher) for r in apps.collect()] == [("Tool A", None)] or [(r.display_name, r.publisher) for r in apps.collect()] == [("Tool A", "Acme")]
    found = registry.search(values, [("HKLM", "SOFTWARE\\Acme")], ["endpoint"]).collect()
    assert [(r.value_name, r.depth) for r in found] == [("Endpoint", 2)]
    assert registry.search(values, [("HKLM", "SOFTWARE\\Acme")], ["endpoint"], max_depth=1).isEmpty()
    tokens = spark.createDataFrame([("tool",)], "token string")
    assert {r.hive for r in registry.suggest_roots(tokens, apps).collect()} == {"HKLM", "HKCU"}


def test_installed_apps_deal_keys_before_they_sort(spark):
    """Texts are aggregated by sorting, so no task that reads values may do that with all it has read."""
    key = "SOFTWARE\\WOW6432Node\\Microsoft\\Windows\\CurrentVersion\\Uninstall\\A"
    rows = [("HKLM", v, key, n, x) for v, n, x in (("32", "displayname", "old"), ("64", "DisplayName", "new"), ("64", "Publisher", "p"), ("x", "DisplayName", " "), (None, "DisplayName", "none"), ("64", "Icon", "i"))]
    rows += [("HKCU", None, key, "DisplayName", "only"), ("HKCU", None, key, "DisplayVersion", "2")]
    apps = registry.installed_apps(spark.createDataFrame(rows, "hive string, view string, key_path string, value_name string, data string"))
    assert [r[:] for r in apps.select("hive", "view", "display_name", "publisher", "version").collect()] == [("HKLM", "64", "new", "p", None), ("HKCU", None, "only", None, "2")]
    plan = apps._jdf.queryExecution().sparkPlan().toString()
    read = apps._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "SortAggregate" in plan
    steps = [line.strip(" +-:").split("(")[0].split(" ")[0] for line in read.splitlines() if line.strip()]
    deal = max(k for k, step in enumerate(steps) if step == "Exchange")  # nearest to what is read
    assert not {"Sort", "SortAggregate", "Window"} & set(steps[deal:]) and steps.count("Exchange") == 2


def test_telemetry_and_logs(spark):
    sections = telemetry.transcript_sections(spark.createDataFrame([("t", "# T\nx\n## One\nHello World\n## Two\n")], "path string, text string"))
    assert {(r.title, r.section, r.body) for r in sections.collect()} >= {("T", "One", "Hello World")}
    wanted = spark.createDataFrame([("t", "One", ["hello", "moon"]), ("t", "Three", ["a"])], "path string, section string, keywords array<string>")
    assert {(r.section, r.found, tuple(r.missing)) for r in telemetry.missing_keywords(wanted, sections).collect()} == {("One", True, ("moon",)), ("Three", False, ("a",))}
    logs = telemetry.log_entries(spark.createDataFrame([("l", "junk\n[2024-01-01T00:00:00Z] boom\n at x\n at y\n[2024-01-01T00:00:01Z] again")], "path string, text string"))
    assert {(r.header, len(r.stack)) for r in logs.collect()} == {("boom", 2), ("again", 0)}
    checks = spark.createDataFrame([("p", "a", True), ("p", "b", False)], "package string, check string, passed boolean")
    assert telemetry.compliance(checks).first()[:] == ("p", False, ["b"])


def test_compare_and_dedupe(spark):
    a, b = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "x"), (2, None), (3, "y")], [(1, "x"), (2, "z"), (4, "q")]))
    assert {r.k: r.status for r in compare.compare(a, b, ["k"], F.col("v")).collect()} == {1: "same", 2: "changed", 3: "removed", 4: "added"}
    cached = spark.createDataFrame([("h", "c", "s")], "host_id string, config_id string, signature string")
    assert hosts.changed_only(cached, cached).isEmpty()


def test_snapshot_options():
    assert snapshots.column_map(["a.b", "a.c", "x"]) == {"a": ["b", "c"]} and snapshots.column_map({"a": "b"}) == {"a": ["b"]}
    assert snapshots.chosen_tables(["b", "a", "c"], exclude=["c"]) == ["a", "b"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("é", 1)], "z string, a int")
    assert sinks.json_records(hit=rows).first().value == '{"payload":{"a":1,"z":"é"},"type":"hit"}'
    assert "<td>é</td>" in sinks.html_report(rows, rows)
    assert sinks.snapshot_manifest(rows, "me", "test", "because").first().retention_days == 30
    message = {"title": "t", "body": "b", "host": "h"}
    assert json.loads(sinks.slack_payload(message))["text"] == "*t*\nb\n• host: h"
    assert json.loads(sinks.teams_payload(message))["sections"][0]["facts"] == [{"name": "host", "value": "h"}]


def test_throttle_of_a_hot_host_passes_in_batches(spark):
    rows = [(h, f"s{(t // 40) % 3}", "m", t * 7) for t in range(700) for h in ("a", "hot", None) if h == "hot" or t % 5 == 0]
    batch = spark.createDataFrame(rows, "host_id string, status string, message string, at_ms bigint").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        found = events.throttle(batch)
        got = sorted((str(r.host_id), r.at_ms) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted, last = [], {}
    for host, status, _, at in sorted(rows, key=lambda r: r[3]):
        if host not in last or last[host][0] != status or at - last[host][1] >= 50:
            last[host] = (status, at)
            wanted.append((str(host), at))
    assert got == sorted(wanted)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()  # would hold a host in one frame


def test_throttle_is_the_same_in_a_stream(spark, tmp_path):
    rows = [("h", "s", "m", t) for t in (0, 30, 60, 90, 120)] + [("h", "s", "other", 130), ("g", "s", "m", 10)]
    schema = "host_id string, status string, message string, at_ms bigint"
    batch = spark.createDataFrame(rows, schema)
    expected = {(r.host_id, r.at_ms) for r in events.throttle(batch).collect()}
    assert expected == {("h", 0), ("h", 60), ("h", 120), ("h", 130), ("g", 10)}
    batch.coalesce(1).write.json(str(tmp_path / "in"))
    got = []
    stream = events.throttle(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    query = stream.writeStream.foreachBatch(lambda df, i: got.extend((r.host_id, r.at_ms) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert set(got) == expected
