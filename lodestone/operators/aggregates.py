"""Grouped aggregation over the repository model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "medium", "low")


def with_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Incoming and outgoing counts over distinct edges; 0 where a file has none."""
    pairs = edges.select("from_path", "to_path").distinct()
    into = pairs.groupBy(F.col("to_path").alias("file_path")).agg(F.count("*").cast("int").alias("incoming_count"))
    out = pairs.groupBy(F.col("from_path").alias("file_path")).agg(F.count("*").cast("int").alias("outgoing_count"))
    joined = nodes.join(into, "file_path", "left").join(out, "file_path", "left")
    return joined.fillna(0, ["incoming_count", "outgoing_count"])


def language_histogram(nodes: DataFrame) -> DataFrame:
    """Counts by language, ``unknown`` for none, and the share of the total."""
    counts = nodes.groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count("*").alias("n_files"))
    total = nodes.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("language", "n_files", (F.col("n_files") / F.col("total")).alias("share"))  # one row


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row for each (from, to), with the sorted union of symbols."""
    symbols = edges.select("from_path", "to_path", F.explode_outer("symbols").alias("s"))
    return symbols.groupBy("from_path", "to_path").agg(F.sort_array(F.collect_set("s")).alias("symbols"))


def churn_by_file(commits: DataFrame, as_of: str) -> DataFrame:
    """Commits, recent commits, distinct authors, changed lines and last change of each file."""
    author = F.coalesce(F.nullif(F.col("author"), F.lit("")), F.lit("unknown"))
    flat = commits.select("sha", author.alias("author"), "ts", F.inline("files"))
    since = F.lit(as_of).cast("timestamp") - F.expr("interval 30 days")
    return flat.groupBy(F.col("filename").alias("file_path")).agg(
        F.count("*").alias("commit_count"),
        F.count_if(F.col("ts") >= since).alias("commits_in_last_30d"),
        F.count_distinct("author").alias("unique_authors"),
        F.sum(F.col("additions") + F.col("deletions")).alias("lines_changed"),
        F.max("ts").alias("last_modified"),
    )


def canonical_pairs(pairs: DataFrame, threshold: float) -> DataFrame:
    """Unordered pairs of different ids with their greatest similarity, strictly above the threshold; NaN never is."""
    own = pairs.where((F.col("id_a") != F.col("id_b")) & ~F.isnan("similarity"))
    best = own.groupBy(F.least("id_a", "id_b").alias("chunk_a_id"), F.greatest("id_a", "id_b").alias("chunk_b_id")).agg(F.max("similarity").alias("similarity"))
    return best.where(F.col("similarity") > threshold)


def usage_rollup(usage: DataFrame) -> DataFrame:
    """Tokens and requests for each user and UTC day."""
    return usage.groupBy("user_id", F.to_date("created_at").alias("usage_date")).agg(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), F.count("*").alias("requests"))


def backfill(daily: DataFrame, rolled: DataFrame) -> DataFrame:
    """Rows of the rollup for days that the stored table lacks."""
    return rolled.join(daily, ["user_id", "usage_date"], "left_anti")


def usage_since(usage: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    start = F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))
    recent = usage.where((F.col("created_at") >= start) & (F.col("created_at") <= F.lit(as_of).cast("timestamp")))
    return recent.groupBy("user_id").agg(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), F.count("*").alias("requests"))


def usage_on(usage: DataFrame, day: str) -> DataFrame:
    """Totals of one UTC day; zeros where it has no rows."""
    own = usage.where((F.col("created_at") >= F.lit(day).cast("timestamp")) & (F.col("created_at") < F.lit(day).cast("timestamp") + F.expr("interval 1 day")))
    return own.agg(F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"), F.count("*").alias("requests"))


def rolling_budget(daily: DataFrame, day: str) -> DataFrame:
    """Tokens of a day and the day before it."""
    d = F.lit(day).cast("date")
    return daily.where(F.col("usage_date").isin(d, F.date_sub(d, 1))).groupBy("user_id").agg(F.sum("total_tokens").alias("tokens"))


def severity_counts(findings: DataFrame, by: list[str]) -> DataFrame:
    return findings.groupBy(*by).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.count("*").alias("total"))


def counts_by(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias(name))


#: Weight of a security issue by severity; others weigh 5 here.
AUDIT_WEIGHTS = (("critical", 20), ("high", 10), ("medium", 5), ("low", 2))


def security_weight(issues: DataFrame, types: list[str]) -> DataFrame:
    """Sum of severity weights of a file's security issues."""
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in AUDIT_WEIGHTS for x in kv]), F.col("severity")), F.lit(5))
    own = issues.where(F.col("type").isin(types))
    return own.select(F.explode("file_paths").alias("file_path"), weight.alias("w")).groupBy("file_path").agg(F.sum("w").alias("weight"))


def median_of(df: DataFrame, column: str, name: str = "median") -> DataFrame:
    """The midpoint median; 0 for no rows."""
    return df.agg(F.coalesce(F.median(column), F.lit(0.0)).alias(name))


def percentile_90(df: DataFrame, column: str, by: list[str], name: str = "p90") -> DataFrame:
    """The value at index floor((n - 1) * 0.9) of the ascending order, by group; nulls sort first and count as 0.

    A value's rank range comes from counts of values, so no group is sorted in one task.
    """
    values = df.groupBy(*by, F.coalesce(F.col(column), F.lit(0)).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy("v")
    ranked = values.withColumns({"upto": F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(Window.partitionBy(*by))})
    at = F.floor((F.col("n") - 1) * 9 / 10)
    return ranked.where((F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)).select(*by, F.col("v").alias(name))


def folder(path: Column) -> Column:
    """The path without its last segment; ``.`` where there is one segment."""
    cut = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(path.contains("/"), cut).otherwise(F.lit("."))


def folder_clusters(nodes: DataFrame, issues: DataFrame, least: int = 3) -> DataFrame:
    """Folders of at least ``least`` files: sums, average complexity, any issue, dominant language."""
    hit = issues.select(F.explode("file_paths").alias("file_path")).distinct().withColumn("hit", F.lit(True))
    rows = nodes.join(hit, "file_path", "left").withColumn("folder", folder(F.col("file_path")))
    languages = rows.groupBy("folder", F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count("*").alias("c"))
    top = languages.groupBy("folder").agg(F.min_by("language", F.struct(-F.col("c"), "language")).alias("dominant_language"))
    sums = rows.groupBy("folder").agg(F.count("*").alias("n_files"), F.sum("incoming_count").alias("incoming"), F.sum("outgoing_count").alias("outgoing"), F.sum("line_count").alias("line_count"), F.avg("complexity_score").alias("avg_complexity"), F.coalesce(F.bool_or("hit"), F.lit(False)).alias("has_issue"))
    return sums.where(F.col("n_files") >= least).join(top, "folder")


def cluster_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges between different folders, with their number of file edges."""
    remapped = edges.select(folder(F.col("from_path")).alias("from_folder"), folder(F.col("to_path")).alias("to_folder")).where("from_folder <> to_folder")
    return remapped.groupBy("from_folder", "to_folder").agg(F.count("*").alias("n_edges"))


def health(nodes: DataFrame, issues: DataFrame) -> DataFrame:
    """clamp(round(100 - 200 critical / n - 50 at risk / n)) by repository; at risk: complexity strictly above the 90th percentile."""
    p = percentile_90(nodes, "complexity_score", ["repo_id"])
    at_risk = nodes.join(p, "repo_id").groupBy("repo_id").agg(F.count("*").alias("n"), F.count_if(F.col("complexity_score") > F.col("p90")).alias("at_risk"))
    critical = issues.where("severity = 'critical'").groupBy("repo_id").agg(F.count("*").alias("critical"))
    joined = at_risk.join(critical, "repo_id", "left").fillna(0, ["critical"])
    raw = F.round(F.lit(100) - F.col("critical") * 200 / F.col("n") - F.col("at_risk") * 50 / F.col("n")).cast("int")
    return joined.select("repo_id", "n", "at_risk", "critical", F.greatest(F.lit(0), F.least(F.lit(100), raw)).alias("health"))


def coverage_summary(nodes: DataFrame, by: list[str]) -> DataFrame:
    own = nodes.where(F.coalesce(~F.col("is_test_file"), F.lit(True)))
    return own.groupBy(*by).agg(F.count("*").alias("n_source"), F.count_if("has_test_coverage").alias("n_covered"), F.round(F.count_if("has_test_coverage") * 100 / F.count("*")).cast("int").alias("covered_percent"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in ``bins`` equal bins of [low, high); 0 and bins + 1 hold what lies outside."""
    return df.where(F.col(column).isNotNull()).groupBy(F.width_bucket(F.col(column).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def column_maxima(nodes: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    return nodes.groupBy(*by).agg(*[F.greatest(F.lit(1), F.max(c)).alias(f"max_{c}") for c in columns])


def vulnerability_groups(issues: DataFrame) -> DataFrame:
    """Dependency issues by first path: how many, and their ids in order."""
    own = issues.where("type = 'vulnerable_dependency'")
    return own.groupBy(F.element_at("file_paths", 1).alias("manifest_path")).agg(F.count("*").alias("vuln_count"), F.sort_array(F.collect_list("id")).alias("ids"))


def issues_by_type(issues: DataFrame) -> DataFrame:
    """Count and first path (of the least id) of each type."""
    return issues.groupBy("repo_id", "type").agg(F.count("*").alias("n"), F.min_by(F.element_at("file_paths", 1), "id").alias("first_path"))


#: Severity ranks of the dependency list; others rank 0.
VULN_RANKS = (("low", 1), ("medium", 2), ("high", 3))


def max_severity(deps: DataFrame) -> DataFrame:
    """The greatest severity of each dependency's vulnerabilities, null for none."""
    rank = F.create_map(*[F.lit(x) for kv in VULN_RANKS for x in kv])
    top = F.array_max(F.transform("vulns", lambda v: F.coalesce(F.element_at(rank, v["severity"]), F.lit(0))))
    return deps.select("id", "package_name", F.when(top > 0, F.element_at(F.array(*[F.lit(k) for k, _ in VULN_RANKS]), F.greatest(top, F.lit(1)))).alias("max_severity"))


def grouped_findings(findings: DataFrame) -> DataFrame:
    """Findings by severity and file, each with its lines in order."""
    return findings.groupBy("severity", "file_path").agg(F.sort_array(F.collect_list("line_number")).alias("lines"))


def path_tree(nodes: DataFrame) -> DataFrame:
    """Every folder above a file with its depth and number of files below."""
    parts = F.split("file_path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    rows = nodes.where(F.size(parts) > 1).select(F.explode(prefixes).alias("folder"))
    return rows.groupBy("folder").agg(F.count("*").alias("n_files")).withColumn("depth", F.size(F.split("folder", "/")))


def unread(notifications: DataFrame) -> DataFrame:
    return notifications.where("read_at is null").groupBy("user_id").agg(F.count("*").alias("unread"))


def coupled_neighbours(edges: DataFrame, k: int = 5) -> DataFrame:
    """Of each file, the k neighbours with most edges either way, with the sorted union of symbols."""
    both = edges.select(F.col("from_path").alias("file_path"), F.col("to_path").alias("neighbour"), "symbols").unionByName(edges.select(F.col("to_path").alias("file_path"), F.col("from_path").alias("neighbour"), "symbols"))
    own = both.groupBy("file_path", "neighbour").agg(F.count("*").alias("n"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("symbols")))).alias("symbols"))
    w = Window.partitionBy("file_path").orderBy(F.desc("n"), "neighbour")
    return own.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def top_importers(edges: DataFrame, to_path: str, k: int = 30) -> DataFrame:
    own = edges.where(F.col("to_path") == to_path)
    return own.select("from_path", F.size("symbols").alias("n_symbols")).orderBy(F.desc("n_symbols"), "from_path").limit(k)


def package_blast(edges: DataFrame, package: str) -> DataFrame:
    """Distinct files that import a path with the package's name."""
    return edges.where(F.col("to_path").ilike(f"%{package}%")).select("from_path").distinct().agg(F.count("*").alias("n_importers"))


def by_day(notifications: DataFrame, zone: str) -> DataFrame:
    """Notifications by the viewer's local day, newest first within it."""
    day = F.to_date(F.from_utc_timestamp("created_at", zone))
    newest = F.reverse(F.sort_array(F.collect_list(F.struct("created_at", "id"))))
    return notifications.groupBy("user_id", day.alias("day")).agg(F.transform(newest, lambda x: x["id"]).alias("ids"))


def daily_snapshot(repos: DataFrame, nodes: DataFrame, edges_by_repo: DataFrame, issues: DataFrame, deps: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """One row for each repository: size, complexity, issue, vulnerability and dependency counts, ten top risks.

    Each part is aggregated by repository on its own and joined once, so no part multiplies another's rows.
    """
    size = nodes.groupBy("repo_id").agg(F.count("*").alias("n_files"), F.sum("line_count").alias("loc"), F.avg("complexity_score").alias("avg_complexity"), F.max("complexity_score").alias("max_complexity"))
    kinds = issues.groupBy("repo_id").agg(*[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in types], *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES])
    w = Window.partitionBy("repo_id").orderBy(F.desc_nulls_last("risk_score"), "id")
    risks = issues.withColumn("k", F.row_number().over(w)).where("k <= 10").groupBy("repo_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("top_risks"))
    packages = deps.groupBy("repo_id").agg(F.count_distinct("id").alias("n_dependencies"), F.count_distinct(F.when(~F.col("is_transitive"), F.col("id"))).alias("n_direct"), F.count_distinct(F.when(F.size("vulns") > 0, F.col("id"))).alias("n_vulnerable"))
    out = repos.join(size, "repo_id", "left").join(edges_by_repo, "repo_id", "left").join(kinds, "repo_id", "left").join(packages, "repo_id", "left").join(risks, "repo_id", "left")
    zero = [c for c in out.columns if c.startswith("n_") or c in ("loc", "max_complexity", "avg_complexity")]
    return out.fillna(0, zero).withColumn("top_risks", F.coalesce("top_risks", F.array().cast("array<bigint>")))
