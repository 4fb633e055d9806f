"""Stored tables as sources: scans with pushed filters, and commits as a code host's interface pages them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most commits that are taken, the newest (fixed value).
MOST_COMMITS = 500


def scan_table(spark: SparkSession, path: str, columns: list[str], where: Column | None = None) -> DataFrame:
    """Columns of a stored table where a condition holds: both reach the files, and no number of rows ends the scan."""
    rows = spark.read.parquet(path)
    return (rows if where is None else rows.where(where)).select(*columns)


_FILE = "struct<filename: string, additions: long, deletions: long, changes: long>"
_COMMIT = f"sha string, commit struct<author: struct<name: string, email: string, date: timestamp>>, author struct<login: string>, files array<{_FILE}>"


def read_commits(spark: SparkSession, path: str, since: str | None = None, most: int | None = MOST_COMMITS) -> DataFrame:
    """(sha, author, ts, files) from stored pages of commit details, a JSON object a line or arrays of them, in any number of files.

    A commit that two pages have counts once. ``since`` leaves out older ones; of the rest the newest ``most`` stay, by sha
    where times are equal. The author is the login, else the e-mail address, else the name.
    """
    pages = spark.read.schema(_COMMIT).json(path)
    author = F.coalesce("author.login", "commit.author.email", "commit.author.name")
    rows = pages.where("sha is not null").select("sha", author.alias("author"), F.col("commit.author.date").alias("ts"), F.coalesce("files", F.array().cast(f"array<{_FILE}>")).alias("files"))
    rows = rows.dropDuplicates(["sha"])
    rows = rows if since is None else rows.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    return rows if most is None else rows.orderBy(F.desc("ts"), "sha").limit(most)
