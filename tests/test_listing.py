"""Listing in tasks, and a budget that bounds what is opened."""

import os

from configlens import engine
from configlens.sources import files, listing


def make(root, names):
    for k, name in enumerate(names):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"k=1\n" * (k + 1))


NAMES = ["a-b/x.ini", "a/b/c/d/e/deep.ini", "a/b.ini", ".hidden/.env", "_under.ini", "z.ini", "a.ini", "é/ü.ini", "with\nbreak.ini", "no.dot/.cfg", "empty/sub/.keep"]


def test_listing_equals_the_driver_s(spark, tmp_path):
    make(tmp_path, NAMES)
    (tmp_path / "hollow").mkdir()
    (tmp_path / "link.ini").symlink_to(tmp_path / "a.ini")
    (tmp_path / "loop").symlink_to(tmp_path)
    for links in (True, False):
        ours = listing.listing(spark, {"local": [str(tmp_path)]}, links=links).orderBy("file_order").collect()
        theirs = files.scan(spark, str(tmp_path), links=str(links).lower()).orderBy("file_order").collect()
        for column in ("file_order", "relative_path", "path", "name", "extension", "length", "host_id", "root", "path_parts", "error"):
            assert [r[column] for r in ours] == [r[column] for r in theirs], column
    assert [r.relative_path for r in ours] == sorted(NAMES, key=lambda p: p.split("/"))


def test_globs_files_as_roots_and_missing_roots(spark, tmp_path):
    make(tmp_path, NAMES)
    by_glob = {r.relative_path for r in listing.listing(spark, {"h": [str(tmp_path)]}, glob="a/**/*.ini").collect()}
    assert by_glob == {"a/b/c/d/e/deep.ini", "a/b.ini"}
    rows = listing.listing(spark, {"h": [str(tmp_path / "z.ini"), str(tmp_path / "none")], "empty": []}).collect()
    assert [(r.relative_path, r.root_order, r.path) for r in rows] == [("z.ini", 0, str(tmp_path / "z.ini"))]
    assert listing.listing(spark, {}).count() == 0


def test_order_over_hosts_and_many_folders(spark, tmp_path, monkeypatch):
    names = [f"{k % 13}/{k % 7}/f{k}" for k in range(300)]
    make(tmp_path / "one", names)
    make(tmp_path / "two", names[:40])
    monkeypatch.setattr(listing, "FOLDERS_PER_TASK", 1)
    rows = listing.listing(spark, {"h": [str(tmp_path / "two"), str(tmp_path / "one")], "g": [str(tmp_path / "one")]}).orderBy("file_order").collect()
    assert [r.file_order for r in rows] == list(range(640))
    order = lambda r: (r.host_id, r.root_order, r.relative_path.split("/"))
    assert [order(r) for r in rows] == sorted(map(order, rows))


def test_files_beyond_the_budget_are_not_opened(spark, tmp_path):
    make(tmp_path, [f"f{k:02d}.ini" for k in range(40)])
    lengths = [4 * (k + 1) for k in range(40)]
    for limit, within in ((sum(lengths[:5]), 5), (sum(lengths[:5]) + 1, 6), (1, 1), (10**9, 40)):
        opened = spark.sparkContext.accumulator(0)
        rows = sorted(engine.scan(spark, str(tmp_path), budget=limit, opened=opened).collect(), key=lambda r: r.file_order)  # a sort by Spark would read twice
        assert [len(r.sample) for r in rows] == [min(x, limit - sum(lengths[:k])) for k, x in enumerate(lengths[:within])]
        assert opened.value == within


def test_each_host_has_its_budget(spark, tmp_path):
    for host in ("a", "b"):
        make(tmp_path / host, [f"f{k}.ini" for k in range(6)])
    opened = spark.sparkContext.accumulator(0)
    listed = listing.listing(spark, {h: [str(tmp_path / h)] for h in ("a", "b")})
    rows = engine.samples(listed, 4 + 8 + 2, by=["host_id"], opened=opened).collect()
    assert sorted((r.host_id, r.name, len(r.sample)) for r in rows) == [(h, f"f{k}.ini", n) for h in "ab" for k, n in enumerate((4, 8, 2))]
    assert opened.value == 6


def test_files_that_vanish_or_hide_have_errors(spark, tmp_path):
    make(tmp_path, ["a.ini", "b.ini"])
    listed = listing.listing(spark, {"h": [str(tmp_path)]})
    os.remove(tmp_path / "a.ini")
    (tmp_path / "dangling").symlink_to(tmp_path / "nowhere")
    rows = {r.name: r for r in listing.read_samples(listed).collect()}
    assert rows["a.ini"].error == "FileNotFoundError" and rows["a.ini"].sample is None and rows["b.ini"].sample == b"k=1\n" * 2
    assert "dangling" not in {r.name for r in listing.listing(spark, {"h": [str(tmp_path)]}).collect()}
