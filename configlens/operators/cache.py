"""A cache of comparisons that scans update, as a log of batches.

Each batch adds a folder with the records that are new or have another signature
than before it, in buckets of their keys; the cache is each key's last record. A
batch that runs again after a failure writes its own folder anew, from what was
there before it, so nothing counts twice and a reader never sees a half-rewritten
table. compact() puts old batches together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sizes import small

KEY = ("host_id", "config_id")
BUCKETS = 64


class CacheLog:
    """A cache below a path that all executors share; keys are KEY, signature says whether a record has changed."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, key: Sequence[str] = KEY):
        self.spark, self.path, self.buckets, self.key = spark, path.rstrip("/"), buckets, list(key)

    def _folders(self, kind: str) -> list[int]:
        """Numbers of the finished batches or bases: those with a mark that their writing has ended."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        system = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        marks = system.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}-*/_SUCCESS"))
        return sorted(int(m.getPath().getParent().getName().split("-")[1]) for m in marks or ())

    def log(self, before: int | None = None) -> DataFrame | None:
        """Every record that batches before one have added, with batch and bucket; None if there is none."""
        bases = [b for b in self._folders("base") if before is None or b < before]
        first = bases[-1:]
        batches = [b for b in self._folders("batch") if (before is None or b < before) and (not first or b > first[0])]
        paths = [f"{self.path}/base-{b}" for b in first] + [f"{self.path}/batch-{b}" for b in batches]
        if not paths:
            return None
        parts = [self.spark.read.parquet(p) for p in paths]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out

    def state(self, before: int | None = None) -> DataFrame | None:
        """Each key's last record, with the batch that has brought it; None if there is none."""
        log = self.log(before)
        return None if log is None else self._last(log, F.col("batch"))

    def _last(self, rows: DataFrame, by) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.key]
        newest = rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), by).alias("_last"))
        return newest.select(*self.key, *(F.col("_last").getField(c).alias(c) for c in rest))

    def merge(self, records: DataFrame, batch: int, order: str | None = None) -> DataFrame:
        """Adds the records of a batch that are new or changed, and returns these.

        Of several records of one key the last by `order` counts (the largest
        signature without one). Records without a key are left out; a null
        signature equals a null one. Merging the same batch again gives the same
        rows. Row groups without a bucket of the batch are not read.
        """
        if any(b >= batch for b in self._folders("base")):
            raise ValueError(f"batch {batch} is within a base already")
        usable = records.where(" AND ".join(f"{k} IS NOT NULL" for k in self.key))
        given = self._last(usable, F.struct(F.col(order), F.col("signature")) if order else F.coalesce("signature", F.lit("")))
        given = given.withColumn("batch", F.lit(batch).cast("bigint")).withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))
        before = self.log(before=batch)
        if before is not None:
            touched = [r.bucket for r in given.select("bucket").distinct().collect()]  # self.buckets numbers at most
            old = self._last(before.where(F.col("bucket").isin(touched)).select(*self.key, "signature", "batch"), F.col("batch")).select(*self.key, F.col("signature").alias("_old"), F.lit(True).alias("_known"))
            given = given.join(small(old), self.key, "left").where("_known IS NULL OR NOT signature <=> _old").drop("_old", "_known")
        path = f"{self.path}/batch-{batch}"
        given.repartition("bucket").sortWithinPartitions("bucket").write.mode("overwrite").parquet(path)
        return self.spark.read.schema(given.schema).parquet(path)

    def compact(self) -> None:
        """Writes the present state as a base, which stands for all batches up to now."""
        batches = self._folders("batch")
        if batches:
            state = self.state()
            state.repartition("bucket").sortWithinPartitions("bucket").write.mode("overwrite").parquet(f"{self.path}/base-{batches[-1]}")

    def follow(self, scans: DataFrame, checkpoint: str, changed: Callable[[DataFrame, int], None] | None = None, order: str | None = None):
        """Starts a stream that merges each micro-batch of scanned records, and hands the changed ones on."""

        def step(records: DataFrame, batch: int) -> None:
            found = self.merge(records, batch, order)
            if changed is not None:
                changed(found, batch)

        return scans.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
