"""Snapshots of tables with masked and hashed columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import mask_hash

PLACEHOLDER = "[REDACTED]"


def column_map(entries: object) -> dict[str, list[str]]:
    """Columns by table, of `table.column` entries or of a mapping of tables to columns."""
    out: dict[str, list[str]] = {}
    if isinstance(entries, Mapping):
        pairs = [(t, c) for t, columns in entries.items() for c in ([columns] if isinstance(columns, str) else columns)]
    else:
        pairs = [tuple(e.split(".", 1)) for e in entries or () if "." in e]
    for table, column in pairs:
        if column not in out.setdefault(table.strip(), []):
            out[table.strip()].append(column.strip())
    return out


def chosen_tables(names: Sequence[str], include: Sequence[str] = (), exclude: Sequence[str] = ()) -> list[str]:
    """The tables of a snapshot, sorted."""
    return sorted(n for n in names if (not include or n in include) and n not in exclude)


def snapshot(table: DataFrame, name: str, masked: Sequence[str] = (), hashed: Sequence[str] = (), salt: str = "", placeholder: str = PLACEHOLDER, limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """table with masked columns replaced and hashed ones digested with a salt per column; masking goes before hashing."""
    if limit is not None:
        if limit < 1:
            raise ValueError("limit must be positive")
        table = table.orderBy(*(order or table.columns)).limit(limit)
    out = []
    for c, kind in table.dtypes:
        value = F.col(f"`{c}`")
        if c in masked:
            value = F.when(value.isNotNull(), F.lit(placeholder))
        elif c in hashed:
            value = mask_hash(value, f"{name}.{c}:{salt}", kind == "string")
        out.append(value.alias(c))
    return table.select(*out)


def manifest(tables: Mapping[str, DataFrame], masked: Mapping[str, Sequence[str]], hashed: Mapping[str, Sequence[str]]) -> DataFrame:
    """table, row_count of the whole table, masked and hashed columns, of each table."""
    parts = [t.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table"), "row_count", F.lit(",".join(sorted(masked.get(n, ())))).alias("masked"), F.lit(",".join(sorted(hashed.get(n, ())))).alias("hashed")) for n, t in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
