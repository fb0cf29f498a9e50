"""Metadata of files and packages."""

import hashlib

import pytest

from configlens.operators import metadata, package


def files(spark, *texts):
    return spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "path string, text string")


def test_xml(spark):
    text = '<?xml version="1.0"?>\n<a xmlns="urn:d"\n   xmlns:x="urn:x" xsi:schemaLocation="urn:d d.xsd urn:x x.xsd">\n<add key="FeatureX" value="on"/><add connectionString="S=1"/><e address="http://h"/></a>'
    rows = files(spark, text)
    assert {(r.prefix, r.uri, r.line) for r in metadata.xml_namespaces(rows).collect()} == {(None, "urn:d", 2), ("x", "urn:x", 3)}
    assert {r.fingerprint for r in metadata.xml_namespaces(rows).where("prefix = 'x'").collect()} == {hashlib.sha1(b"urn:x").hexdigest()[:12]}
    assert {(r.namespace, r.location) for r in metadata.schema_locations(rows).collect()} == {("urn:d", "d.xsd"), ("urn:x", "x.xsd")}
    assert {(r.kind, r.value_sha256) for r in metadata.attribute_hints(rows).collect()} == {(k, hashlib.sha256(v).hexdigest()) for k, v in (("feature-flag", b"on"), ("connection-string", b"S=1"), ("endpoint", b"http://h"))}


def test_keys_and_imports(spark):
    row = metadata.resource_keys(files(spark, '<root><data name="A"/><data xml:space="p" name="B"/></root>')).first()
    assert (row.key_count, row["keys"]) == (2, ["A", "B"])
    row = metadata.build_imports(files(spark, '<Project><Target Name="T"/><Import Project="x.props"/></Project>')).first()
    assert row.targets == ["T"] and row.import_sha256 == [hashlib.sha256(b"x.props").hexdigest()]


def test_indentation_and_spacing(spark):
    rows = files(spark, "a:\n  b: 1\n  c:\n    d: 1\n   e: 2\n", "a:\n\tb: 1\n  c: 2\n", "flat: 1")
    got = {r.path: (r.style, r.width, r.outlier_lines) for r in metadata.indentation(rows).collect()}
    assert got["p0"] == ("spaces", 2, [5]) and got["p1"][0] == "mixed" and set(got) == {"p0", "p1"}
    row = metadata.assignment_spacing(files(spark, "a = 1\nb=2\nc = 3\nd\t= 4\n")).first()
    assert (row.spacing, row.tab_lines) == ("1=1", [4])


def test_sources(tmp_path):
    for name in ("a/x.ini", "a/b/y.ini", "z.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("1")
    assert package.glob_base("a/b/*.x") == "a/b" and package.glob_base("/*.x") == "/" and package.glob_base("*.x") == "."
    found = package.expand_sources(["a/**/*.ini", "z.txt"], baseline="z.txt", base_dir=str(tmp_path))
    assert [f.rsplit("/", 1)[1] for f in found] == ["z.txt", "y.ini", "x.ini"]
    with pytest.raises(FileNotFoundError):
        package.expand_sources(["nothing*"], base_dir=str(tmp_path))


def test_packages(spark):
    rows = spark.createDataFrame([("h 1", "b/x", b"abc"), ("h 1", "a", b"")], "host_id string, relative_path string, content binary")
    got = package.manifest(rows, "pack", limit=3).collect()
    assert [(r.source, r.destination, r.size, r.total_size) for r in got] == [("a", "pack/h-1/a", 0, 3), ("b/x", "pack/h-1/b/x", 3, 3)]
    assert got[1].sha256 == hashlib.sha256(b"abc").hexdigest()
    with pytest.raises(Exception, match="larger than"):
        package.manifest(rows, "pack", limit=2).collect()
    keys = (b"k" * 32, b"m" * 32)
    sealed = package.seal(rows, *keys)
    assert {bytes(r.content) for r in package.unseal(sealed, *keys).collect()} == {b"abc", b""}
    assert {r.content for r in package.unseal(sealed, keys[0], b"n" * 32).collect()} == {None}
    with pytest.raises(ValueError):
        package.seal(rows, b"short", keys[1])
