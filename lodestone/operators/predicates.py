"""Filters and projections over the repository model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equal(df: DataFrame, **values) -> DataFrame:
    """Rows that match every value; null matches nothing."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), values.items(), df)


def not_equal(df: DataFrame, **values) -> DataFrame:
    """Rows that differ from every value; null differs from nothing."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) != kv[1]), values.items(), df)


def between(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """The half-open range [low, high)."""
    df = df if low is None else df.where(F.col(column) >= low)
    return df if high is None else df.where(F.col(column) < high)


def member(df: DataFrame, column: str, values: list | DataFrame) -> DataFrame:
    """A literal list filters; a DataFrame (its first column) is a semi join."""
    if isinstance(values, DataFrame):
        keys = values.select(F.col(values.columns[0]).alias("__v"))
        return df.join(keys, F.col(column) == F.col("__v"), "left_semi")
    return df.where(F.col(column).isin(values))


def missing(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def tuples_in(df: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns form one of the key tuples."""
    return df.join(keys.select(*columns).distinct(), columns, "left_semi")


def contains(df: DataFrame, array: str, value) -> DataFrame:
    return df.where(F.array_contains(array, value))


def json_value(df: DataFrame, column: str, path: str, value: str) -> DataFrame:
    return df.where(F.get_json_object(column, path) == value)


def overlaps(df: DataFrame, array: str, values: list[str]) -> DataFrame:
    return df.where(F.arrays_overlap(array, F.array(*map(F.lit, values))))


def ilike(df: DataFrame, column: str, part: str) -> DataFrame:
    return df.where(F.col(column).ilike(f"%{part}%"))


def subset_of(df: DataFrame, array: str, allowed: Column) -> DataFrame:
    """Rows whose non-empty array lies within ``allowed``."""
    return df.where((F.size(array) > 0) & (F.size(F.array_except(F.col(array), allowed)) == 0))


def accessible(repos: DataFrame, user, owner: str, shares: DataFrame, members: DataFrame) -> DataFrame:
    """Repositories that a user owns, or that a team of theirs shares."""
    teams = members.where(F.col("user_id") == user).select("team_id")
    shared = shares.join(teams, "team_id", "left_semi").select("repo_id")
    own = repos.where(F.col(owner) == user).select("repo_id")
    return repos.join(own.unionByName(shared).distinct(), "repo_id", "left_semi")


def search_issues(issues: DataFrame, text: str) -> DataFrame:
    """Issues whose description or any path holds the text, whatever its case."""
    low = text.lower()
    return issues.where(F.lower("description").contains(low) | F.exists("file_paths", lambda p: F.lower(p).contains(low)))


def search_dependencies(deps: DataFrame, text: str = "", ecosystem: str | None = None, vulnerable_only: bool = False) -> DataFrame:
    out = deps.where(F.lower("package_name").contains(text.lower())) if text else deps
    out = out.where(F.col("ecosystem") == ecosystem) if ecosystem else out
    return out.where(F.size("vulns") > 0) if vulnerable_only else out


def metrics_rows(nodes: DataFrame, text: str, low: int, high: int, column: str = "complexity_score") -> DataFrame:
    """Files whose path holds the text and whose metric is in [low, high)."""
    return between(nodes.where(F.lower("file_path").contains(text.lower())), column, low, high)


def recent(df: DataFrame, column: str, as_of: str, days: int | None) -> DataFrame:
    return df if days is None else df.where(F.col(column) >= F.date_sub(F.lit(as_of).cast("date"), days))


def pull_requests(reviews: DataFrame, which: str) -> DataFrame:
    """``has_findings`` or ``clean``; clean needs a review."""
    total = F.col("total_findings")
    return reviews.where(total > 0 if which == "has_findings" else total == 0)


#: Notification types and their defaults (in_app, email).
CHANNEL_DEFAULTS = (("click", True, False), ("view", True, True), ("purchase", True, True), ("signup", False, True), ("error", True, False))


def channel_on(df: DataFrame, channel: str, overrides: Column, type_col: str = "type", switch: Column | None = None) -> DataFrame:
    """Rows whose channel is on: the switch, and the user's choice or else the default of the type.

    ``overrides``: map<string, boolean>; types without a default are on.
    """
    at = 1 if channel == "in_app" else 2
    defaults = F.create_map(*[F.lit(x) for row in CHANNEL_DEFAULTS for x in (row[0], row[at])])
    on = F.coalesce(F.element_at(overrides, F.col(type_col)), F.element_at(defaults, F.col(type_col)), F.lit(True))
    return df.where(on if switch is None else switch & on)


def json_field(df: DataFrame, column: str, path: str, name: str) -> DataFrame:
    return df.withColumn(name, F.get_json_object(column, path))
