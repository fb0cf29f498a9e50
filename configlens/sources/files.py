"""The `configfiles` data source: files of a tree with a bounded sample of each.

The built-in binaryFile source leaves out dot-files, `_`-files and empty files
and reads whole contents. This one lists the tree once, on the driver, with no call
for a single file, and reads at most `sample_size` bytes of each file in the tasks. A file that can't be read
becomes a row with an error.

    spark.dataSource.register(ConfigFiles)
    spark.read.format("configfiles").option("path", root).load()
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import glob_from_root
from ..operators.budget import DEFAULT_SAMPLE, clamp_sample

SCHEMA = "host_id string, root string, path string, relative_path string, path_parts array<string>, name string, extension string, length bigint, sample binary, error string, file_order bigint"


@dataclass
class FileBatch(InputPartition):
    """Some files of one task: paths relative to the root."""

    host: str
    root: str
    names: list[str]
    first: int = 0


def listed(root: str, links: bool = True) -> Iterator[str]:
    """Paths of files below a root, relative to it; links to folders aren't followed, those to files count unless links is false."""
    folders = [""]
    while folders:
        below = folders.pop()
        try:
            with os.scandir(os.path.join(root, below)) as entries:
                for entry in entries:
                    if entry.is_dir(follow_symlinks=False):
                        folders.append(f"{below}{entry.name}/")
                    elif entry.is_file() and (links or not entry.is_symlink()):
                        yield below + entry.name
        except OSError:
            continue  # a folder that can't be read has no files


class ConfigFilesReader(DataSourceReader):
    """Lists on the driver, reads in tasks."""

    def __init__(self, options: dict[str, str]):
        self.root = os.path.abspath(options["path"])
        self.host = options.get("host_id", "local")
        glob = options.get("glob", "**")
        self.pattern = re.compile(glob_from_root(glob).replace("\\z", "\\Z"))
        self.sample = clamp_sample(int(options.get("sample_size", DEFAULT_SAMPLE)))
        self.per_task = int(options.get("files_per_task", 256))
        self.links = options.get("links", "true").lower() == "true"

    def partitions(self) -> list[FileBatch]:
        if os.path.isfile(self.root):
            return [FileBatch(self.host, os.path.dirname(self.root), [os.path.basename(self.root)])]
        found = sorted((f for f in listed(self.root, self.links) if self.pattern.match(f)), key=lambda f: f.split("/"))
        return [FileBatch(self.host, self.root, found[i : i + self.per_task], i) for i in range(0, len(found), self.per_task)] or [FileBatch(self.host, self.root, [])]

    def read(self, partition: FileBatch) -> Iterator[tuple]:
        for order, relative in enumerate(partition.names, partition.first):
            path = os.path.join(partition.root, relative)
            length, sample, error = None, None, None
            try:
                length = os.path.getsize(path)
                with open(path, "rb") as file:
                    sample = file.read(self.sample)
            except OSError as e:
                error = type(e).__name__
            name = relative.rsplit("/", 1)[-1]
            extension = "." + name.rsplit(".", 1)[1].lower() if "." in name[1:] else ""
            yield partition.host, partition.root, path, relative, relative.split("/"), name, extension, length, sample, error, order


class ConfigFiles(DataSource):
    """Options: path, host_id, glob (`**` any folders), sample_size, files_per_task, links (false: symbolic links are left out)."""

    @classmethod
    def name(cls) -> str:
        return "configfiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ConfigFilesReader:
        return ConfigFilesReader(self.options)


def scan(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """The files below a root."""
    spark.dataSource.register(ConfigFiles)
    return spark.read.format("configfiles").options(path=root, **{k: str(v) for k, v in options.items()}).load()


def exists(root: str) -> bool:
    """Whether there is such a folder or file."""
    return os.path.exists(root)


def scan_hosts(spark: SparkSession, roots: dict[str, list[str]], **options: object) -> DataFrame:
    """The files of several hosts' roots, with root_order."""
    parts = [scan(spark, root, host_id=host, **options).withColumn("root_order", F.lit(k)) for host, paths in roots.items() for k, root in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
