"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_folder

#: ASCII white space; words of the deduplication operators are what lies between.
WORD_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark from wherever sf_dir is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of this process where that is unset and all runs in it (tests)."""
    return shared_folder(spark)


class Workspace:
    """Intermediate tables of one operator call, written to the shared folder so that no lineage hangs on an executor.

    drop() frees a table as soon as nothing reads it any more. What an operator's
    lazy result still reads stays; released() frees it once that has been written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        for opened in _WATCHING:
            opened.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and return what was written."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table written by write()."""
        self._delete(f"{self.root}/{name}")

    def close(self) -> None:
        """Delete all tables."""
        self._delete(self.root)

    def _delete(self, where: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Lists of the workspaces that are made inside of released().
_WATCHING: list[list[Workspace]] = []


@contextmanager
def released() -> Iterator[None]:
    """Closes the workspaces made inside at the end; by then, results that read them have to be written elsewhere."""
    opened: list[Workspace] = []
    _WATCHING.append(opened)
    try:
        yield
    finally:
        _WATCHING.remove(opened)
        for work in opened:
            work.close()


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is one of those that nothing is learned from; null ids count as not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(doc_id: str = "doc_id") -> Column:
    """Whether labels of a document may be learned from; never with a null id."""
    return F.col(doc_id).isNotNull() & ~held_out(doc_id)


def texts_of(column: pa.Array) -> list[str]:
    """The strings of an Arrow column, empty for null."""
    return [x or "" for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """The strings of an Arrow column as UTF-8, empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about max_bytes of text at most, or one row, so that memory doesn't follow the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes + 64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def sorted_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each group of rows that come sorted by the columns `by`."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in by])
        starts = np.flatnonzero(np.any(np.diff(keys, axis=1) != 0, axis=0)) + 1
        for a, b in zip([0, *starts], [*starts, batch.num_rows], strict=True):
            now = tuple(keys[:, a])
            if now != key and held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, so that it clashes with no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of unsigned 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd multiplier of the polynomial hashes below, and enough of its powers for a piece of a word.
BASE = np.uint64(0x9E3779B97F4A7C15)
PIECE = 64
with np.errstate(over="ignore"):
    POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(PIECE - 1, BASE)]), dtype=np.uint64)


class Words:
    """The words of a batch of texts, as 64-bit hashes in one array.

    hashes[starts[d]:starts[d + 1]] are the words of text d. Words are maximal
    runs of bytes other than ASCII white space; fold lower-cases A-Z first.
    """

    def __init__(self, texts: list[bytes], fold: bool = False):
        joined = b"\n".join(texts) + b"\n"
        data = np.frombuffer(joined, dtype=np.uint8)
        value = _FOLDED[data] if fold else data
        inside = ~_SPACE[data]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        self.begin, self.end = edge[0::2], edge[1::2]
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
        self.offset = np.concatenate([[0], ends])
        self.starts = np.searchsorted(self.begin, self.offset)
        self.hashes = hash_runs(value, self.begin, self.end)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(WORD_SPACE)] = True
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64))


def hash_runs(value: np.ndarray, begin: np.ndarray, end: np.ndarray, of: np.ndarray = _BYTE_VALUE) -> np.ndarray:
    """A 64-bit hash of each run value[begin:end]; long runs are hashed in pieces whose place counts too."""
    if not len(begin):
        return np.zeros(0, dtype=np.uint64)
    length = end - begin
    with np.errstate(over="ignore"):
        place = np.arange(len(value), dtype=np.int64)
        owner_start = np.zeros(len(value), dtype=np.int64)
        owner_start[begin[0]] = begin[0]
        owner_start[begin[1:]] = begin[1:] - begin[:-1]
        place -= np.cumsum(owner_start)
        term = of[value] * POWERS[place & (PIECE - 1)]
        if int(length.max()) > PIECE:
            term *= mix64((place >> 6).astype(np.uint64)) | np.uint64(1)
        bounds = np.empty(2 * len(begin), dtype=np.int64)
        bounds[0::2], bounds[1::2] = begin, end
        total = np.add.reduceat(np.append(term, np.uint64(0)), bounds)[0::2]
        return mix64(total ^ length.astype(np.uint64))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            total *= BASE
            total += words[i : i + n]
        return mix64(total)


#: Rows of two or three numbers up to which a side of a join is broadcast; beyond that the join shuffles.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(written: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if a count shows that it has at most so many rows."""
    return F.broadcast(written) if written.limit(rows + 1).count() <= rows else written
