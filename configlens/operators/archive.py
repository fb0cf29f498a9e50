"""Archives of packages, written by tasks volume by volume under a guard of their size.

A package is a host's files in path order. Running sizes, taken over chunks'
totals, say beforehand which volume a file goes to and where a package reaches its
limit, so that no task has to see a whole package: a task writes whole volumes,
one zip file each, and only the files of its own. What is beyond the limit is not
written, and the log says so.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shared import Tables
from ..sources.listing import numbered
from .package import safe_name

#: Bytes of content in a volume, unless a single file has more.
VOLUME = 256 << 20
_TIME = (1980, 1, 1, 0, 0, 0)  # the same in every run
_WRITTEN = "package string, volume bigint, entry string, size bigint, sha256 string"


def planned(files: DataFrame, limit: int | None = None, volume: int = VOLUME) -> DataFrame:
    """files (host_id, relative_path, content) with package, entry, size, place, before (bytes of the package's files before), volume and written.

    The first file at which a package would grow beyond the limit and all later
    ones are not written. Files without a host belong to the package named item; a
    null content counts as empty.
    """
    package = safe_name(F.coalesce("host_id", F.lit("")))
    rows = files.select(package.alias("package"), F.col("relative_path").alias("entry"), F.coalesce("content", F.lit(b"")).alias("content")).where("entry IS NOT NULL")
    rows = rows.withColumn("size", F.octet_length("content").cast("bigint")).withColumn("_parts", F.split("entry", "/"))
    tables = Tables(files.sparkSession, "archive")
    # Contents are sorted once and written; sums are taken over their sizes alone.
    kept = numbered(rows, ["package", "_parts"], tables, "place").drop("_parts").withColumn("_chunk", F.floor(F.col("place") / 10_000))
    totals = kept.groupBy("package", "_chunk").agg(F.sum("size").alias("_total"))
    earlier = Window.partitionBy("package").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("package", "_chunk", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))  # a row for each chunk
    inside = Window.partitionBy("package", "_chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sums = kept.select("package", "_chunk", "place", "size").join(starts, ["package", "_chunk"])
    sums = sums.select("place", (F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("before"))
    within = F.lit(True) if limit is None else F.col("before") + F.col("size") <= limit
    found = kept.drop("_chunk").join(sums, "place").withColumn("volume", F.floor(F.col("before") / volume).cast("bigint")).withColumn("written", within)
    if limit is None:
        return found
    # A smaller file after one that didn't fit isn't written either.
    first = found.where(~F.col("written")).groupBy("package").agg(F.min("place").alias("_first"))
    return found.join(first, "package", "left").withColumn("written", F.coalesce(F.col("place") < F.col("_first"), F.lit(True))).drop("_first")


def write_archives(files: DataFrame, folder: str, limit: int | None = None, volume: int = VOLUME) -> tuple[DataFrame, DataFrame]:
    """Entries (package, volume, entry, size, sha256) of the archives written below a folder that all executors share, and the log.

    The log has for each package its entries, bytes, volumes, refused files and
    status: complete, or aborted at the limit. A volume is written beside its place
    and moved there, so a task that runs again leaves a whole one; entries of one
    name in a package get numbers.
    """

    def close(archive: zipfile.ZipFile, part: str, path: str) -> None:
        archive.close()
        os.replace(part, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, archive, part, path, names = None, None, "", "", {}
        for batch in batches:
            rows = []
            for package, number, entry, content in zip(*(batch.column(c).to_pylist() for c in ("package", "volume", "entry", "content")), strict=True):
                if (package, number) != now:
                    if archive is not None:
                        close(archive, part, path)
                    now, names = (package, number), {}
                    path = os.path.join(folder, f"{package}.{number:05d}.zip")
                    part = f"{path}.{uuid.uuid4().hex}"
                    archive = zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED)
                names[entry] = again = names.get(entry, -1) + 1
                name = f"{entry}.{again}" if again else entry
                archive.writestr(zipfile.ZipInfo(name, _TIME), content, zipfile.ZIP_DEFLATED)
                rows.append((package, number, name, len(content), hashlib.sha256(content).hexdigest()))
            yield _rows(rows)
        if archive is not None:
            close(archive, part, path)

    os.makedirs(folder, exist_ok=True)
    plan = Tables(files.sparkSession, "plan").write(planned(files, limit, volume))
    dealt = plan.where("written").select("package", "volume", "place", "entry", "content").repartition("package", "volume").sortWithinPartitions("package", "volume", "place")
    entries = Tables(files.sparkSession, "entries").write(dealt.drop("place").mapInArrow(run, _WRITTEN))
    summed = plan.groupBy("package").agg(F.count_if("written").alias("entries"), F.coalesce(F.sum(F.when(F.col("written"), F.col("size"))), F.lit(0)).alias("bytes"), F.countDistinct(F.when(F.col("written"), F.col("volume"))).alias("volumes"), F.count_if(~F.col("written")).alias("refused"))
    return entries, summed.withColumn("status", F.when(F.col("refused") > 0, "aborted").otherwise("complete"))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _WRITTEN.split(", ")])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """package, volume, entry, size and sha256 of what the archives below a shared folder hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                package, number, _ = os.path.basename(path).rsplit(".", 2)
                with zipfile.ZipFile(path) as archive:
                    for info in archive.infolist():
                        content = archive.read(info)
                        yield _rows([(package, int(number), info.filename, len(content), hashlib.sha256(content).hexdigest())])

    found = [(entry.path,) for entry in os.scandir(folder) if entry.name.endswith(".zip")]  # volumes, not files
    return spark.createDataFrame(found, "path string").repartition(max(1, min(len(found), 1000))).mapInArrow(run, _WRITTEN)
