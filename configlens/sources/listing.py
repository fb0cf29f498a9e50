"""Listing of trees and reading of samples as two steps, both in tasks.

Folders are listed level by level: the folders of a level are a table whose rows
tasks list with one scandir each, so no list of paths is ever on the driver. What
a level finds is written; files get their order by a range sort and numbered
chunks. Contents come in a second step, for the rows that are left by then: files
beyond a budget are never opened.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import Tables
from ..functions.text import glob_from_root
from ..operators.budget import DEFAULT_SAMPLE, clamp_sample

_FOUND = "host_id string, root string, root_order int, relative_path string, folder boolean, length bigint, error string"
#: Folders of a level that a task lists at least.
FOLDERS_PER_TASK = 64


def _entries(root: str, below: str, links: bool) -> Iterator[tuple[str, bool, int | None, str | None]]:
    """Path, whether it is a folder, length and error of each entry of a folder; links to folders aren't followed."""
    with os.scandir(os.path.join(root, below)) as entries:
        for entry in entries:
            try:
                if entry.is_dir(follow_symlinks=False):
                    yield below + entry.name, True, None, None
                elif entry.is_file() and (links or not entry.is_symlink()):
                    readable = os.access(entry.path, os.R_OK)
                    yield below + entry.name, False, entry.stat().st_size if readable else None, None if readable else "PermissionError"
            except OSError as e:
                yield below + entry.name, False, None, type(e).__name__


def _list_folders(links: bool, pattern: str):
    fits = re.compile(pattern).match

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, root, order, below in zip(*(batch.column(c).to_pylist() for c in ("host_id", "root", "root_order", "relative_path")), strict=True):
                rows: list[tuple] = []
                try:
                    if not below and os.path.isfile(root):  # a root that is a file is its only one
                        head, name = os.path.split(root)
                        rows.append((host, head, order, name, False, os.path.getsize(root), None))
                    else:
                        for path, folder, length, error in _entries(root, f"{below}/" if below else "", links):
                            if folder or fits(path):
                                rows.append((host, root, order, path, folder, length, error))
                            if len(rows) >= 10_000:
                                yield _batch(rows)
                                rows = []
                except OSError:
                    pass  # a folder that can't be listed has no files
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.string())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _FOUND.split(", ")])


def listing(spark: SparkSession, roots: Mapping[str, Sequence[str]], glob: str = "**", links: bool = True) -> DataFrame:
    """The files below the roots of each host: where they are, their length or the error that hides it, and file_order.

    file_order counts all files by host, root and path components (`a/b` before
    `a-b`, as components compare), from 0. A file that can't be read has no length
    and an error, a folder that can't be listed no files, a root that isn't there
    none either.
    """
    tables = Tables(spark, "listing")
    start = [(host, os.path.abspath(root), k, "") for host, paths in roots.items() for k, root in enumerate(paths)]
    level = spark.createDataFrame(start, "host_id string, root string, root_order int, relative_path string")
    step = _list_folders(links, glob_from_root(glob).replace("\\z", "\\Z"))
    columns = ["host_id", "root", "root_order", "relative_path"]
    found, here = None, len(start)
    while here:
        tasks = max(1, min(spark.sparkContext.defaultParallelism * 4, here // FOLDERS_PER_TASK))
        entries = tables.write(level.select(columns).repartition(tasks).mapInArrow(step, _FOUND))
        files = entries.where("NOT folder")
        found = files if found is None else found.unionByName(files)
        level = entries.where("folder")
        here = level.count()
    if found is None:
        found = spark.createDataFrame([], _FOUND)
    return numbered(_described(found.drop("folder")), ["host_id", "root_order", "path_parts"], tables)


def _described(found: DataFrame) -> DataFrame:
    name = F.element_at("path_parts", -1)
    extension = F.lower(F.regexp_extract("name", r"(?s)(?<=.)(\.[^.]*)\z", 1))
    rows = found.withColumn("path_parts", F.split("relative_path", "/")).withColumn("name", name)
    path = F.concat(F.when(F.col("root") == "/", "/").otherwise(F.concat("root", F.lit("/"))), "relative_path")
    return rows.withColumn("extension", extension).withColumn("path", path)


def numbered(rows: DataFrame, by: Sequence[str], tables: Tables, name: str = "file_order") -> DataFrame:
    """rows with their place in an order, from 0: sorted by ranges, numbered in each range, and the ranges' sizes added up before."""
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    kept = tables.write(ordered.withColumn("_chunk", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    starts, at = [], 0
    for chunk, size in kept.groupBy("_chunk").count().orderBy("_chunk").collect():  # a row for each task
        starts.append((chunk, at))
        at += size
    first = rows.sparkSession.createDataFrame(starts or [(0, 0)], "_chunk int, _first bigint")
    return kept.join(F.broadcast(first), "_chunk").withColumn(name, F.col("_first") + F.col("_place")).drop("_chunk", "_place", "_first")


def read_samples(rows: DataFrame, size: str | int = DEFAULT_SAMPLE, opened: Accumulator | None = None) -> DataFrame:
    """rows (path, error) with the first bytes of each file: so many, or as many as the column says. `opened` counts the files opened.

    Rows with an error are not opened; a file that can't be read gets one.
    """
    take = F.col(size) if isinstance(size, str) else F.lit(clamp_sample(size))
    schema = rows.withColumn("sample", F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # 64 samples of 512 KiB at most
                part = batch.slice(at, 64)
                samples, errors = [], []
                for path, error, most in zip(*(part.column(c).to_pylist() for c in ("path", "error", "_take")), strict=True):
                    sample = None
                    if error is None:
                        try:
                            with open(path, "rb") as file:
                                sample = file.read(most)
                            if opened is not None:
                                opened.add(1)
                        except OSError as e:
                            error = type(e).__name__
                    samples.append(sample)
                    errors.append(error)
                columns = {n: part.column(n) for n in part.schema.names if n != "_take"}
                columns |= {"error": pa.array(errors, pa.string()), "sample": pa.array(samples, pa.binary())}
                yield pa.record_batch([columns[f.name] for f in schema], [f.name for f in schema])

    return rows.withColumn("_take", take.cast("bigint")).mapInArrow(run, schema)
