"""Expectation profiles: which profile configurations apply to which files."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizes import small
from ..functions.text import glob_anywhere, normalise_path, normalise_tags

#: profiles: name, tags and configs, an array of these.
CONFIG_TYPE = "struct<id:string,path:string,path_glob:string,application:string,version:string,branch:string,tags:array<string>,expected_format:string,expected_variant:string,ignore_review_flags:boolean>"


def provided(tags: list[str]) -> Column:
    """Tags as a column."""
    return normalise_tags(F.array(*(F.lit(t) for t in tags)).cast("array<string>"))


def _within(tags: Column, given: Column) -> Column:
    return F.size(F.array_except(F.coalesce(tags, F.array().cast("array<string>")), given)) == 0


def applicable_profiles(profiles: DataFrame, given: Column) -> DataFrame:
    """Profiles whose tags are all among the given ones; without tags always."""
    return profiles.where(_within(F.col("tags"), given))


def configs(profiles: DataFrame) -> DataFrame:
    """One row per profile configuration, with the profile's name and tags and the place in the store's order."""
    return profiles.select(F.col("name").alias("profile"), F.col("tags").alias("profile_tags"), F.posexplode("configs").alias("position", "config")).select("profile", "profile_tags", "position", "config.*")


def matching(files: DataFrame, profiles: DataFrame, given: Column, globs: list[str] | None = None, path: str = "relative_path") -> DataFrame:
    """Files with each configuration that applies to them: profile, config_id and position beside files' columns.

    A configuration applies if its tags and its application, version and branch
    are among the given tags and its path equals the file's, or its glob fits it,
    or it has neither. Equal paths are a hash join; each of `globs`, the few
    distinct globs of the store (collected from it if not given), filters files by
    a literal pattern and joins on the glob; rules without path join all. Files
    without path only get those.
    """
    active = configs(applicable_profiles(profiles, given)).where(_within(F.col("tags"), given))
    for prefix in ("application", "version", "branch"):
        active = active.where(F.col(prefix).isNull() | F.array_contains(given, F.concat(F.lit(f"{prefix}:"), F.col(prefix))))
    active = active.select("profile", F.col("id").alias("config_id"), "position", F.col("path").alias("rule_path"), F.col("path_glob").alias("rule_glob"), "expected_format", "expected_variant", "ignore_review_flags")
    if globs is None:
        globs = [r.rule_glob for r in active.where("rule_glob IS NOT NULL").select("rule_glob").distinct().orderBy("rule_glob").toLocalIterator()]
    keyed = files.withColumn("_path", normalise_path(F.col(path)))
    by_path = keyed.join(small(active.where("rule_path IS NOT NULL")), F.col("_path") == F.col("rule_path"))
    everywhere = keyed.crossJoin(small(active.where("rule_path IS NULL AND rule_glob IS NULL")))  # as many rows as the result
    parts = [by_path, everywhere]
    if globs:
        fits = F.filter(F.array(*(F.when(F.col("_path").rlike(glob_anywhere(g)), F.lit(g)) for g in globs)).cast("array<string>"), lambda x: x.isNotNull())
        by_glob = keyed.withColumn("_glob", F.explode(fits)).join(small(active.where("rule_glob IS NOT NULL")), F.col("_glob") == F.col("rule_glob"))
        parts.append(by_glob.where("rule_path IS NULL OR rule_path <> _path").drop("_glob"))
    return reduce(DataFrame.unionByName, parts).drop("_path", "rule_path", "rule_glob")


def bridge(hits: DataFrame, profiles: DataFrame, given: Column, globs: list[str] | None = None) -> DataFrame:
    """Hits with the profiles that apply to their path, nested; hits without any keep an empty array."""
    paths = hits.select("path").distinct()
    found = matching(paths, profiles, given, globs, "path").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("profile", "position", "config_id"))).alias("profiles"))
    empty = F.array().cast("array<struct<profile:string,position:int,config_id:string>>")
    return hits.join(found, "path", "left").withColumn("profiles", F.coalesce("profiles", empty))


def suppress_review(detections: DataFrame, matched: DataFrame) -> DataFrame:
    """detections (relative_path, needs_review) with review_ignored where a configuration that applies says to ignore review; needs_review is false there."""
    ignoring = matched.where("ignore_review_flags").select("relative_path", F.lit(True).alias("_ignore")).distinct()
    rows = detections.join(ignoring, "relative_path", "left")
    ignored = F.coalesce(F.col("_ignore") & F.col("needs_review"), F.lit(False))
    return rows.withColumn("review_ignored", ignored).withColumn("needs_review", F.col("needs_review") & ~F.col("review_ignored")).drop("_ignore")


def check_store(profiles: DataFrame) -> DataFrame:
    """The store itself; names or ids that it repeats are an error."""
    problem = store_problems(profiles).orderBy("kind", "name").first()
    if problem:
        raise ValueError(f"the store has {problem.kind} {problem.name!r} more than once")
    return profiles


def add_profile(profiles: DataFrame, new: DataFrame) -> DataFrame:
    """The store with more profiles."""
    return check_store(profiles.unionByName(new, allowMissingColumns=True))


def update_profile(profiles: DataFrame, name: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The store with what `change` makes of one profile's row; no such profile is an error, and so is a store that repeats names or ids."""
    mine = profiles.where(F.col("name") == name)
    if mine.isEmpty():
        raise KeyError(name)
    return check_store(profiles.where(F.col("name") != name).unionByName(change(mine)))


def remove_profile(profiles: DataFrame, name: str) -> DataFrame:
    """The store without a profile."""
    return profiles.where(F.col("name") != name)


def remove_config(profiles: DataFrame, name: str, config_id: str) -> DataFrame:
    """The store without one configuration of a profile."""
    kept = F.when(F.col("name") == name, F.filter("configs", lambda c: c["id"] != config_id)).otherwise(F.col("configs"))
    return profiles.withColumn("configs", kept)


def find_config(profiles: DataFrame, config_id: str) -> DataFrame:
    """The configuration of an id with its profile, or nothing."""
    return configs(profiles).where(F.col("id") == config_id)


def store_summary(profiles: DataFrame) -> DataFrame:
    """name, config_count and config_ids in declared order of each profile."""
    return profiles.select("name", F.size("configs").cast("bigint").alias("config_count"), F.transform("configs", lambda c: c["id"]).alias("config_ids"))


def store_problems(profiles: DataFrame) -> DataFrame:
    """kind and name of what a store may not have: repeated profile names or configuration ids."""
    names = profiles.groupBy("name").count().where("count > 1").select(F.lit("profile").alias("kind"), "name")
    ids = configs(profiles).groupBy("id").count().where("count > 1").select(F.lit("config").alias("kind"), F.col("id").alias("name"))
    return names.union(ids)


def store_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """name, status (added, removed, changed, same), added_ids and removed_ids between two store summaries."""
    a, b = before.select("name", F.col("config_ids").alias("old")), after.select("name", F.col("config_ids").alias("new"))
    none = F.array().cast("array<string>")
    old, new = F.coalesce("old", none), F.coalesce("new", none)
    added, removed = F.array_sort(F.array_except(new, old)), F.array_sort(F.array_except(old, new))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when((F.size(added) > 0) | (F.size(removed) > 0), "changed").otherwise("same")
    return a.join(b, "name", "full_outer").select("name", status.alias("status"), added.alias("added_ids"), removed.alias("removed_ids"))
