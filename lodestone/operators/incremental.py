"""Incremental re-indexing: classification by content hash, keyed merges, carry-over, expiry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def classify(old: DataFrame, new: DataFrame) -> DataFrame:
    """unchanged, changed, added or deleted by content hash."""
    a, b = old.select("file_path", F.col("content_hash").alias("o")), new.select("file_path", F.col("content_hash").alias("n"))
    state = F.when(F.col("n").isNull(), "deleted").when(F.col("o").isNull(), "added").when(F.col("o") == F.col("n"), "unchanged").otherwise("changed")
    return a.join(b, "file_path", "full_outer").select("file_path", state.alias("state"))


def merge(target: DataFrame, source: DataFrame, keys: list[str], overwrite: bool = True) -> DataFrame:
    """Keyed upsert: with ``overwrite`` source rows replace target rows, else they only fill gaps. Of source rows with one
    key the greatest by all columns stays, so the result doesn't depend on their order."""
    rest = [c for c in source.columns if c not in keys]
    own = source.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__r")).select(*keys, "__r.*") if rest else source.distinct()
    if overwrite:
        return target.join(own.select(*keys), keys, "left_anti").unionByName(own, allowMissingColumns=True)
    return target.unionByName(own.join(target.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def preserved_issues(issues: DataFrame, unchanged: DataFrame, types: list[str]) -> DataFrame:
    """Issues of the given types all of whose files are unchanged; by joins, so any number of paths works."""
    rows = issues.where(F.col("type").isin(types) & (F.size("file_paths") > 0)).select("id", F.explode("file_paths").alias("file_path"))
    broken = rows.join(unchanged.select("file_path"), "file_path", "left_anti").select("id").distinct()
    return issues.where(F.col("type").isin(types) & (F.size("file_paths") > 0)).join(broken, "id", "left_anti")


def mark_stale(proposals: DataFrame, gone: DataFrame, key: str = "issue_id") -> DataFrame:
    """Pending proposals of issues that go become stale."""
    g = gone.select(F.col("id").alias(key)).distinct().withColumn("__gone", F.lit(True))
    return proposals.join(g, key, "left").withColumn("status", F.when(F.col("__gone") & (F.col("status") == "pending"), "stale").otherwise(F.col("status"))).drop("__gone")


def without_paths(df: DataFrame, paths: DataFrame, reset: dict[str, object] | None = None) -> DataFrame:
    """Rows of other paths, with some columns set anew."""
    out = df.join(paths.select("file_path").distinct(), "file_path", "left_anti")
    return reduce(lambda d, kv: d.withColumn(kv[0], F.lit(kv[1])), (reset or {}).items(), out)


def carry_forward(old: DataFrame, new: DataFrame, unchanged: DataFrame, key: str = "file_path") -> DataFrame:
    """Old rows of unchanged files and all new rows."""
    return old.join(unchanged.select(F.col("file_path").alias(key)), key, "left_semi").unionByName(new, allowMissingColumns=True)


def add_churn(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Sums of old and new commits and lines and the later time; authors aren't recounted, new files have 0."""
    d = delta.select("file_path", *[F.col(c).alias(f"d_{c}") for c in ("commit_count", "lines_changed", "last_modified")])
    return old.join(d, "file_path", "full_outer").select(
        "file_path",
        *[(F.coalesce(c, F.lit(0)) + F.coalesce(f"d_{c}", F.lit(0))).alias(c) for c in ("commit_count", "lines_changed")],
        F.coalesce("unique_authors", F.lit(0)).alias("unique_authors"),
        F.greatest("last_modified", "d_last_modified").alias("last_modified"),
    )


def add_rollup(daily: DataFrame, fresh: DataFrame) -> DataFrame:
    """A rollup with another batch added to it."""
    return daily.unionByName(fresh).groupBy("user_id", "usage_date").agg(F.sum("total_tokens").alias("total_tokens"), F.sum("requests").alias("requests"))


def patched(df: DataFrame, **values) -> DataFrame:
    """Columns replaced where a value is given; None keeps the old one."""
    return reduce(lambda d, kv: d.withColumn(kv[0], F.coalesce(F.lit(kv[1]), F.col(kv[0]))), values.items(), df)


def forked(df: DataFrame, key: str, value, suffix: str, title: str, **values) -> DataFrame:
    """A copy of the rows of one key under another owner, its title marked."""
    own = df.where(F.col(key) == value).withColumn(title, F.concat(F.col(title), F.lit(suffix)))
    return reduce(lambda d, kv: d.withColumn(kv[0], F.lit(kv[1])), values.items(), own)


def unexpired(df: DataFrame, column: str, as_of: str, days: int) -> DataFrame:
    """Rows of the last days; rows without a time stay."""
    return df.where(F.coalesce(F.col(column) >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days)), F.lit(True)))


def stored_content(df: DataFrame, column: str, limit: int = 1 << 20) -> DataFrame:
    """The text cut to ``limit`` characters, and its size in bytes before."""
    return df.withColumns({"size_bytes": F.octet_length(column), column: F.substring(column, 1, limit)})


def first_dependency(deps: DataFrame) -> DataFrame:
    """One row for each (manifest, ecosystem, package, version): that of the least id."""
    keys = ["manifest_path", "ecosystem", "package_name", "pkg_version"]
    return deps.groupBy(*keys).agg(F.min("id").alias("id"), F.min_by("is_transitive", "id").alias("is_transitive"))


def bound_late(members: DataFrame, accounts: DataFrame) -> DataFrame:
    """Null user ids filled by user name."""
    a = accounts.groupBy("user_name").agg(F.min("user_id").alias("__id"))
    return members.join(a, "user_name", "left").withColumn("user_id", F.coalesce("user_id", "__id")).drop("__id")


def stamped_once(df: DataFrame, column: str, when: Column, as_of: str) -> DataFrame:
    """The time set where the condition holds and it is still null."""
    return df.withColumn(column, F.when(when, F.coalesce(F.col(column), F.lit(as_of).cast("timestamp"))).otherwise(F.col(column)))


def emitted_once(df: DataFrame, keys: list[str], time: str, days: int) -> DataFrame:
    """(keys, emitted): times that are kept if no kept time of the key lies in the days before; a chained rule, folded
    over each key's sorted times."""
    window = days * 86400
    times = F.sort_array(F.collect_list(F.unix_seconds(time)))
    kept = F.aggregate(times, F.array().cast("array<bigint>"), lambda acc, x: F.when((F.size(acc) == 0) | (x - F.try_element_at(acc, F.lit(-1)) >= window), F.concat(acc, F.array(x))).otherwise(acc))
    return df.groupBy(*keys).agg(kept.alias("k")).select(*keys, F.explode("k").alias("emitted"))


