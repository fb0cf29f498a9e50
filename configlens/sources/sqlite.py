"""The `sqlitetable` data source: a table of a SQLite file, in row-number ranges, and the list of tables."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

_TYPES = {"INT": LongType(), "REAL": DoubleType(), "FLOA": DoubleType(), "DOUB": DoubleType(), "BLOB": BinaryType()}


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def tables(path: str) -> list[str]:
    """Names of a file's tables, sorted, without SQLite's own."""
    with _connect(path) as c:
        return [r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name")]


def table_count(path: str) -> int | None:
    """How many tables a file has, its own ones too; None if it is no database."""
    try:
        with _connect(path) as c:
            return c.execute("SELECT count(*) FROM sqlite_master WHERE type = 'table'").fetchone()[0]
    except sqlite3.Error:
        return None


@dataclass
class RowRange(InputPartition):
    """Row numbers low <= rowid < high (None: no bound); without row numbers the whole table."""

    low: int | None = None
    high: int | None = None
    numbered: bool = True


class SqliteReader(DataSourceReader):
    """Reads ranges of row numbers."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.table = options["path"], options["table"]
        self.rows = int(options.get("rows_per_task", 100_000))
        self.limit = int(options["limit"]) if "limit" in options else None
        self.schema = schema

    def partitions(self) -> list[RowRange]:
        """Ranges of as many rows each, however sparse their numbers are; a view or a table without row numbers is one range."""
        every = f"SELECT rowid AS id, row_number() OVER (ORDER BY rowid) AS n FROM {_quoted(self.table)}"
        with _connect(self.path) as c:
            try:
                starts = [r[0] for r in c.execute(f"SELECT id FROM ({every}) WHERE (n - 1) % ? = 0 ORDER BY n", (self.rows,))]
            except sqlite3.OperationalError:
                return [RowRange(numbered=False)]
        if self.limit is not None or not all(isinstance(x, int) for x in starts):
            return [RowRange(numbered=False)]
        return [RowRange(a, b) for a, b in zip(starts, [*starts[1:], None], strict=True)] or [RowRange(0, 0)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        casts = [{"long": int, "double": float, "string": lambda v: v if isinstance(v, str) else str(v), "binary": lambda v: v if isinstance(v, bytes) else str(v).encode()}[f.dataType.typeName()] for f in self.schema.fields]
        columns = ", ".join(_quoted(f.name) for f in self.schema.fields)
        query, bounds = f"SELECT {columns} FROM {_quoted(self.table)}", []
        if partition.numbered:
            query, bounds = f"{query} WHERE rowid >= ?", [partition.low]
            if partition.high is not None:
                query, bounds = f"{query} AND rowid < ?", [partition.low, partition.high]
        elif self.limit is not None:
            query, bounds = f"{query} LIMIT ?", [self.limit]
        with _connect(self.path) as c:
            for row in c.execute(query, bounds):
                yield tuple(None if v is None else cast(v) for cast, v in zip(casts, row, strict=True))


class SqliteTable(DataSource):
    """Options: path, table, rows_per_task, limit (rows read at most)."""

    @classmethod
    def name(cls) -> str:
        return "sqlitetable"

    def schema(self) -> StructType:
        with _connect(self.options["path"]) as c:
            columns = c.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        return StructType([StructField(name, next((t for k, t in _TYPES.items() if k in (kind or "").upper()), StringType())) for _, name, kind, *_ in columns])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(self.options, schema)


def read_table(spark: SparkSession, path: str, table: str, **options: object) -> DataFrame:
    """A table or view of a file that all executors can open."""
    spark.dataSource.register(SqliteTable)
    return spark.read.format("sqlitetable").options(path=path, table=table, **{k: str(v) for k, v in options.items()}).load()
