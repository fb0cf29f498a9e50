"""Archives in volumes, their limit, and what is read back."""

import os
import zipfile

from configlens.operators import archive

FILES = "host_id string, relative_path string, content binary, package string"


def test_volumes_limit_and_log(spark, tmp_path):
    rows = [("h/1", f"d/{k:03d}", bytes([k % 256]) * (k * 7 % 50), "clash") for k in range(200)] + [("b", "big", b"x" * 900, ""), ("b", "a/small", b"y", ""), ("b", "z", b"", ""), (None, "n", None, ""), (None, "n", b"again", ""), ("b", None, b"lost", "")]
    files = spark.createDataFrame(rows, FILES).repartition(5)
    entries, log = archive.write_archives(files, str(tmp_path), limit=901, volume=100)
    written = sorted(map(tuple, entries.collect()))
    assert written == sorted(map(tuple, archive.read_archives(spark, str(tmp_path)).collect()))
    found = {r.package: (r.entries, r.bytes, r.refused, r.status) for r in log.collect()}
    total, fits = 0, 0
    for k in range(200):
        if total + k * 7 % 50 > 901:
            break
        total, fits = total + k * 7 % 50, fits + 1
    assert found["h-1"] == (fits, total, 200 - fits, "aborted")
    assert found["b"] == (3, 901, 0, "complete") and found["item"] == (2, 5, 0, "complete")
    assert {r[2] for r in written if r[0] == "item"} == {"n", "n.1"}
    for package, volume in {r[:2] for r in written}:
        sizes = [r[3] for r in written if r[:2] == (package, volume)]
        assert sum(sizes) - max(sizes) < 100 + max(sizes)
    names = sorted(os.listdir(tmp_path))
    assert all(n.endswith(".zip") for n in names) and len(names) == len({r[:2] for r in written})
    # Written again, archives are the same to the byte.
    before = {n: (tmp_path / n).read_bytes() for n in names}
    archive.write_archives(files, str(tmp_path), limit=901, volume=100)
    assert {n: (tmp_path / n).read_bytes() for n in sorted(os.listdir(tmp_path)) if "item" not in n} == {n: b for n, b in before.items() if "item" not in n}
    assert zipfile.ZipFile(tmp_path / names[0]).testzip() is None


def test_nothing_to_write(spark, tmp_path):
    entries, log = archive.write_archives(spark.createDataFrame([], FILES), str(tmp_path / "new"))
    assert entries.count() == log.count() == 0 and archive.read_archives(spark, str(tmp_path / "new")).count() == 0
