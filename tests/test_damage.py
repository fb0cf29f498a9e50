"""Heads of XML, failing detectors and damaged samples."""

import pytest

from configlens.operators import classify, failures, fuzz, xml_scopes
from configlens.sources import decode


def test_tags_and_their_scopes():
    head = "<?xml version='1.0'?>\n<!-- <a xmlns='no'> -->\n<p:a xmlns:p='one' b=\"x>y\">\n  <p:b xmlns:p='two'/><p:c/><![CDATA[<d e='f'>]]><q xmlns='three'><r></q><s>"
    rows = [(d, e, n, a) for d, e, n, a, *_ in xml_scopes.tags(head)]
    assert rows == [(0, "p:a", "one", "xmlns:p"), (0, "p:a", "one", "b"), (1, "p:b", "two", "xmlns:p"), (1, "p:c", "one", None), (1, "q", "three", "xmlns"), (2, "r", "three", None), (1, "s", None, None)]
    places = {(e, a): (line, column) for _, e, _, a, _, line, column in xml_scopes.tags(head)}
    assert places["p:a", "b"] == (3, 20) and places["p:b", "xmlns:p"] == (4, 8)


@pytest.mark.parametrize("head", ["", "<", "<a", "<!--", "<a b='", "</x>", "<a b=c>", "text", "<!DOCTYPE a [", "<" * 3000, "<a " * 1500, "<a b='x" * 500, "<!DOCTYPE " + "['\"" * 300])
def test_broken_heads(head):
    assert len(list(xml_scopes.tags(head))) <= len(head)


def test_roots_of_a_table(spark):
    rows = spark.createDataFrame([("a", ".xml", "<b/>"), ("c", ".xml", None), ("d", ".x", "plain"), ("e", ".config", "<x:NLog xmlns:x='u' a='1' a='1'></x:NLog><second/>")], "path string, extension string, text string")
    found = {r.path: r for r in xml_scopes.roots(rows).collect()}
    assert set(found) == {"a", "e"} and found["a"].variant is None and found["a"].attributes == {}
    assert (found["e"].root, found["e"].root_prefix, found["e"].root_namespace, found["e"].variant, found["e"].attributes) == ("x:NLog", "x", "u", "nlog-config", {"a": "1"})


FILES = "relative_path string, name string, extension string, sample binary"


def test_detectors_that_fail_lose_no_file(spark):
    calls = spark.sparkContext.accumulator(0)

    def broken(path, sample, text):
        calls.add(1)
        raise ValueError("x" * 5000)

    files = decode.with_text(spark.createDataFrame([(f"{k}.ini", f"{k}.ini", ".ini", b"[a]\nb=1\nc=2\n") for k in range(20)] + [("e", "e", "", b""), ("n", "n", "", None)], FILES))
    found, errors = failures.classify_recorded(files, classify.with_plugins(classify.PythonDetector("broken", 1, broken)))
    rows = {r.relative_path: r.format for r in found.collect()}
    assert len(rows) == 22 and rows["3.ini"] == "ini" and rows["e"] is None
    failed = errors.collect()
    assert {(r.stage, r.error) for r in failed} == {("broken", "ValueError")} and len(failed) == 22 and all(len(r.message) == failures.MESSAGE for r in failed)
    assert calls.value == 22
    assert failures.classify_recorded(files)[1].isEmpty()


def test_mutations_are_what_they_say(spark):
    samples = [bytes(range(256)), b"ab" * 50, b"x", b"", None]
    rows = spark.createDataFrame([(str(k), s) for k, s in enumerate(samples)], "relative_path string, sample binary")
    one, other = (sorted((r.relative_path, r.trial, r.mutation, r.sample) for r in fuzz.mutated(rows, 40, seed).collect() if r.sample is not None) for seed in (3, 4))
    assert one == sorted((r.relative_path, r.trial, r.mutation, r.sample) for r in fuzz.mutated(rows.repartition(5), 40, 3).collect() if r.sample is not None)
    assert one != other and {m for _, _, m, _ in one} == set(fuzz.MUTATIONS)
    for path, _, kind, got in one:
        was, got = samples[int(path)], bytes(got)
        tenth = max(1, len(was) // 10)
        if kind == "flip":
            assert len(got) == len(was) and sum(a != b for a, b in zip(was, got, strict=True)) == 1
        elif kind == "comment":
            assert got.startswith(b"# note ") and got.endswith(was)
        elif kind == "cut":
            assert was.startswith(got) and len(got) >= len(was) // 2
        else:
            at = range(len(was))
            assert got in ({was[:a] + was[a + tenth :] for a in at} if kind == "drop" else {was[: a + tenth] + was[a:] for a in at})
    assert fuzz.mutated(rows, 0).count() == 0
    assert {r.sample for r in fuzz.mutated(rows.where("sample IS NULL"), 3).collect()} == {None}
