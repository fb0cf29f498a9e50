"""Searches of an imported registry table: hive, view, key_path, value_name, data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import Tables
from ..functions.sizes import SMALL_ROWS, small

UNINSTALL = r"SOFTWARE\\(WOW6432Node\\)?Microsoft\\Windows\\CurrentVersion\\Uninstall\\[^\\]+"


def installed_apps(values: DataFrame) -> DataFrame:
    """display_name, publisher, version, hive and key_path of applications with a name, sorted by name and hive.

    Of keys that several views show, that of the view named 64 stays.
    """
    names = {"display_name": "DisplayName", "publisher": "Publisher", "version": "DisplayVersion"}
    rows = values.where(F.col("key_path").rlike(f"(?i)^{UNINSTALL}$") & F.lower("value_name").isin([n.lower() for n in names.values()]))
    # Keys are dealt before texts are aggregated, because that sorts: a task then sorts its share of the keys, not all that it has read.
    dealt = rows.select("hive", "key_path", "view", "value_name", "data").repartition("hive", "key_path")
    pick = lambda name: F.max(F.when(F.lower("value_name") == name.lower(), F.col("data")))
    apps = dealt.groupBy("hive", "key_path", "view").agg(*(pick(n).alias(c) for c, n in names.items())).where(F.trim("display_name") != "")
    # In the order of the groups already, so that nothing is sorted or moved again.
    shown = apps.groupBy("hive", "key_path").agg(F.max_by(F.struct("view", *names), F.struct("view")).alias("app"))
    return shown.select("hive", "app.view", "key_path", *(f"app.{c}" for c in names)).orderBy(F.lower("display_name"), "hive", "key_path")


def suggest_roots(tokens: DataFrame, apps: DataFrame) -> DataFrame:
    """token, hive and path of likely roots: software keys of applications whose name or publisher has the token."""
    has = lambda c: F.contains(F.lower(apps[c]), F.lower(tokens["token"]))
    found = small(tokens).join(apps, has("display_name") | has("publisher"))
    under = lambda *parts: F.concat_ws("\\", F.lit("SOFTWARE"), *parts)
    paths = F.array(F.struct(F.lit("HKLM").alias("hive"), under("publisher", "display_name").alias("path")), F.struct(F.lit("HKCU").alias("hive"), under("publisher", "display_name").alias("path")), F.struct(F.lit("HKLM").alias("hive"), under("publisher").alias("path")))
    return found.select("token", F.explode(paths).alias("root")).select("token", "root.*").distinct()


def search(values: DataFrame, roots: Sequence[tuple[str, str]], keywords: Sequence[str] = (), patterns: Sequence[str] = (), max_depth: int = 12, max_hits: int = 200) -> DataFrame:
    """The first max_hits values below roots (hive, path) that hold a keyword or fit a pattern, nearest to the root first."""
    below = []
    for hive, path in roots:
        depth = F.size(F.split(F.substring(F.col("key_path"), len(path) + 1, 1 << 20), r"\\")) - 1
        inside = (F.lower("key_path") == path.lower()) | F.startswith(F.lower("key_path"), F.lit(path.lower() + "\\"))
        below.append(values.where((F.col("hive") == hive) & inside).withColumn("depth", depth))
    rows = reduce(DataFrame.unionByName, below).where(F.col("depth") <= max_depth).dropDuplicates(["hive", "view", "key_path", "value_name"])
    text = F.concat_ws("\n", "key_path", "value_name", "data")
    tests = [F.contains(F.lower(text), F.lit(k.lower())) for k in keywords] + [text.rlike(f"(?iuU){p}") for p in patterns]
    hits = rows.where(reduce(lambda a, b: a | b, tests)) if tests else rows
    return hits.orderBy("depth", "hive", "key_path", "value_name").limit(max_hits)


def _key_parts(key_path: str = "key_path") -> tuple:
    """A key's name for comparison, whatever its case, and that of the key above it."""
    key = F.lower(key_path)
    return key.alias("_key"), F.when(F.contains(key, F.lit("\\")), F.regexp_replace(key, r"\\[^\\]*\z", "")).alias("_above")


def value_matches(keywords: Sequence[str] = (), patterns: Sequence[str] = ()):
    """Whether a value's name and data hold all keywords, whatever the case, and one of them fits a pattern; a value without data doesn't."""
    both = F.concat(F.lower(F.coalesce("value_name", F.lit(""))), F.lit(" "), F.lower("data"))
    tests = [F.contains(both, F.lit(k.lower())) for k in keywords]
    if patterns:
        tests.append(reduce(lambda a, b: a | b, [F.col("data").rlike(p) | F.coalesce(F.col("value_name").rlike(p), F.lit(False)) for p in patterns]))
    return reduce(lambda a, b: a & b, tests, F.col("data").isNotNull())


def traverse(keys: DataFrame, values: DataFrame, roots: DataFrame, keywords: Sequence[str] = (), patterns: Sequence[str] = (), max_depth: int = 12, max_hits: int = 200) -> DataFrame:
    """The first max_hits matching values that a breadth-first walk from the roots meets, with depth, root_order and a preview of 120 characters.

    keys (hive, view, key_path) are those that can be opened, values (hive, view,
    key_path, value_name, data) what they hold, roots (root_order, hive, view,
    key_path) where walks begin; a root's null view stands for every view. All
    roots walk together, a level at a time: a level's keys are joined with the keys
    above which they stand, so what is below a key that can't be opened is never
    met. A key counts once, for the walk that reaches it first (the lower
    root_order of two at once). Levels end at max_depth, or with the one that
    brings max_hits.
    """
    tables = Tables(keys.sparkSession, "registry")
    known = tables.write(keys.select("hive", "view", "key_path", *_key_parts()).where("key_path IS NOT NULL").groupBy("hive", "view", "_key", "_above").agg(F.min("key_path").alias("key_path")))
    matching = tables.write(values.where(value_matches(keywords, patterns)).select("hive", F.coalesce("view", F.lit("")).alias("view"), F.lower("key_path").alias("_key"), "value_name", "data"))
    start = roots.select("root_order", F.col("hive").alias("_hive"), F.col("view").alias("_view"), F.lower("key_path").alias("_root"))
    at_root = (known["hive"] == start["_hive"]) & (known["_key"] == start["_root"])
    level = known.join(small(start), at_root).where("_view IS NULL OR view <=> _view").groupBy("hive", "view", "_key", "key_path").agg(F.min("root_order").alias("root_order"))
    hits, seen, total = None, None, 0
    for depth in range(max_depth + 1):
        level = tables.write(level.withColumn("_v", F.coalesce("view", F.lit(""))))
        size = level.count()
        if not size and hits is not None:
            break
        side = F.broadcast(level) if size <= SMALL_ROWS else level
        found = matching.withColumnRenamed("view", "_v").join(side.drop("view"), ["hive", "_v", "_key"]).withColumn("depth", F.lit(depth))
        hits = found if hits is None else hits.unionByName(found)
        total += found.limit(max_hits - total).count()
        if total >= max_hits or depth == max_depth:
            break
        seen = level if seen is None else seen.unionByName(level)
        above = side.select("hive", "_v", F.col("_key").alias("_above"), "root_order")
        below = known.withColumn("_v", F.coalesce("view", F.lit(""))).join(above, ["hive", "_v", "_above"]).groupBy("hive", "view", "_v", "_key", "key_path").agg(F.min("root_order").alias("root_order"))
        level = below.join(seen.select("hive", "_v", "_key"), ["hive", "_v", "_key"], "left_anti").drop("_v")
    ordered = hits.orderBy("depth", "root_order", F.split("_key", r"\\"), "_v", "value_name", "data").limit(max_hits)
    return ordered.select("hive", F.nullif("_v", F.lit("")).alias("view"), "key_path", "value_name", F.left("data", F.lit(120)).alias("preview"), "depth", "root_order")
