"""Joins over the repository model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.aggregates import folder


def shares_of_members(shares: DataFrame, members: DataFrame) -> DataFrame:
    """Who reaches which shared repository: (repo_id, user_id), once each. A team's users and shares come once into the join."""
    return shares.select("repo_id", "team_id").distinct().join(members.select("user_id", "team_id").distinct(), "team_id").select("repo_id", "user_id").distinct()


def left_counts(left: DataFrame, right: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Every left row with its number of right rows, 0 for none; the right side is counted before the join."""
    counts = right.groupBy(key).agg(F.count("*").alias(name))
    return left.join(counts, key, "left").fillna(0, [name])


def with_metric(left: DataFrame, right: DataFrame, key: str, columns: dict[str, object]) -> DataFrame:
    """Left join that fills absent metrics."""
    return left.join(right.select(key, *columns), key, "left").fillna({k: v for k, v in columns.items() if v is not None})


def dependencies_with_issues(manifests: DataFrame, groups: DataFrame) -> DataFrame:
    """Manifest rows (by folder, package and version; the one with most vulnerabilities first) full-joined with groups
    of issue-derived vulnerabilities, whose counts win; unmatched groups become rows of their own."""
    keys = ["manifest_dir", "package_name", "pkg_version"]
    w = Window.partitionBy(*keys).orderBy(F.desc("vuln_count"), "manifest_path")
    first = manifests.withColumn("manifest_dir", folder(F.col("manifest_path"))).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
    g = groups.withColumnRenamed("vuln_count", "issue_count")
    return first.join(g, keys, "full_outer").select(*keys, "manifest_path", F.coalesce("issue_count", "vuln_count").alias("vuln_count"), F.col("issue_count").isNotNull().alias("from_issues"))


def tree_status(base: DataFrame, head: DataFrame, key: str = "file_path", mark: str = "content_hash") -> DataFrame:
    """added, removed, modified or unchanged for each path of two trees."""
    b, h = base.select(key, F.col(mark).alias("b")), head.select(key, F.col(mark).alias("h"))
    status = F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").when(F.col("b") != F.col("h"), "modified").otherwise("unchanged")
    return b.join(h, key, "full_outer").select(key, status.alias("status"))


def real_targets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is a known file; sources aren't checked."""
    return edges.join(nodes.select(F.col("file_path").alias("to_path")), "to_path", "left_semi")


def induced(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges with both ends among the paths."""
    own = paths.select("file_path")
    return edges.join(own.withColumnRenamed("file_path", "from_path"), "from_path", "left_semi").join(own.withColumnRenamed("file_path", "to_path"), "to_path", "left_semi")


def with_end_ids(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges as (source, target) ids; dangling ones go."""
    a = nodes.select(F.col("file_path").alias("from_path"), F.col("file_id").alias("source"))
    b = nodes.select(F.col("file_path").alias("to_path"), F.col("file_id").alias("target"))
    return edges.join(a, "from_path").join(b, "to_path").select("source", "target")


def unsuppressed(findings: DataFrame, suppressions: DataFrame, wildcard: bool) -> DataFrame:
    """Findings without a suppression of their file, rule and line; with ``wildcard`` a null line covers every line."""
    s = suppressions.select(F.col("file_path").alias("s_path"), F.col("rule_id").alias("s_rule"), F.col("line_number").alias("s_line")).distinct()
    same = (F.col("file_path") == F.col("s_path")) & (F.col("rule_id") == F.col("s_rule"))
    line = F.col("s_line").eqNullSafe(F.col("line_number"))
    return findings.join(s, same & (line | F.col("s_line").isNull() if wildcard else line), "left_anti")


def issue_keys(path: Column, rule: Column, line: Column, text: Column) -> Column:
    """The three keys by which a finding counts as known."""
    return F.array(F.concat_ws("|", path, rule, line.cast("string")), F.concat_ws("|", path, rule, F.lower(text)), F.concat_ws("|", path, line.cast("string"), F.lower(text)))


def unknown_findings(findings: DataFrame, issues: DataFrame) -> DataFrame:
    """Findings that share none of their keys with an issue (of each of its files)."""
    line = F.regexp_extract("description", r"line (\d+)", 1)
    known = issues.select(F.explode("file_paths").alias("p"), "type", line.alias("l"), "description").select(F.explode(issue_keys(F.col("p"), F.col("type"), F.col("l"), F.col("description"))).alias("key")).distinct()
    own = findings.select("finding_id", F.explode(issue_keys(F.col("file_path"), F.col("rule_id"), F.col("line_number"), F.col("message"))).alias("key"))
    hit = own.join(known, "key", "left_semi").select("finding_id").distinct()
    return findings.join(hit, "finding_id", "left_anti")


def new_rows(head: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of head whose keys base lacks."""
    return head.join(base.select(*keys).distinct(), keys, "left_anti")


def fresh_on_added_lines(findings: DataFrame, base_hashes: DataFrame, added: DataFrame) -> DataFrame:
    """Findings whose (rule, context hash) base lacks, on added lines only."""
    own = findings.join(base_hashes.select("rule_id", "context_hash").distinct(), ["rule_id", "context_hash"], "left_anti")
    return own.join(added.select("file_path", "line_number"), ["file_path", "line_number"], "left_semi")


def line_proximity(a: Column, b: Column) -> Column:
    """3 for the same line, 2 within five, 1 within twenty, else 0 (also for a null)."""
    d = F.abs(a - b)
    return F.when(d == 0, 3).when(d <= 5, 2).when(d <= 20, 1).otherwise(0)


def link_findings(findings: DataFrame, issues: DataFrame) -> DataFrame:
    """(finding_id, issue_id, score) of the same file with score above 1: 1 + 3 for the same type or 2 for the same
    family (the part before ``_``) + line proximity."""
    line = F.expr("try_cast(nullif(regexp_extract(description, 'line ([0-9]+)', 1), '') as int)")
    i = issues.select(F.col("id").alias("issue_id"), F.explode(F.array_distinct("file_paths")).alias("file_path"), "type", line.alias("issue_line"))
    family = lambda c: F.substring_index(c, "_", 1)
    category = F.when(F.col("rule_id") == F.col("type"), 3).when(family(F.col("rule_id")) == family(F.col("type")), 2).otherwise(0)
    score = F.lit(1) + category + line_proximity(F.col("line_number"), F.col("issue_line"))
    return findings.join(i, "file_path").select("finding_id", "issue_id", score.alias("score")).where("score > 1")


def first_match(left: DataFrame, right: DataFrame, keys: list[str], order: list, columns: list[str]) -> DataFrame:
    """Left join with the first right row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = right.withColumn("__k", F.row_number().over(w)).where("__k = 1").select(*keys, *columns)
    return left.join(first, keys, "left")


def share_impact(shares: DataFrame, members: DataFrame, creator: Column) -> DataFrame:
    """Distinct members (accounts; nulls don't count) that a shared item reaches, without its creator."""
    of_team = members.where("user_id is not null").select("user_id", "team_id").distinct()  # however many accounts a user has in a team
    return shares.distinct().join(of_team, "team_id").where(F.col("user_id") != creator).groupBy("item_id").agg(F.count_distinct("user_id").alias("n_members"))


def recipients(owners: DataFrame, shared: DataFrame) -> DataFrame:
    """(repo_id, user_id): the owner and all members of teams that share the repository, once each."""
    return owners.select("repo_id", "user_id").unionByName(shared.select("repo_id", "user_id")).where("user_id is not null").distinct()


def owned_or_shared(owned: DataFrame, shared: DataFrame) -> DataFrame:
    """Owned repositories, then shared ones that aren't owned, each once with the least team."""
    own = owned.select("repo_id", F.lit("owner").alias("access"), F.lit(None).cast("bigint").alias("team_id"))
    rest = shared.groupBy("repo_id").agg(F.min("team_id").alias("team_id")).join(owned.select("repo_id"), "repo_id", "left_anti")
    return own.unionByName(rest.select("repo_id", F.lit("shared").alias("access"), F.col("team_id").cast("bigint").alias("team_id")))


def split_comments(comments: DataFrame, diff_lines: DataFrame) -> DataFrame:
    """Earlier comments: ``outdated`` where their line is still in the diff, else ``delete``."""
    marked = diff_lines.select("file_path", "line_number").distinct().withColumn("there", F.lit(True))
    return comments.join(marked, ["file_path", "line_number"], "left").withColumn("action", F.when(F.col("there"), "outdated").otherwise("delete")).drop("there")


def match_comments(findings: DataFrame, comments: DataFrame) -> DataFrame:
    """The comment of each finding by (path, line), else the one at the same place in order within the repository."""
    by_key = comments.groupBy("repo_id", "file_path", "line_number").agg(F.min("comment_id").alias("by_key"))
    place = lambda c: F.row_number().over(Window.partitionBy("repo_id").orderBy(c))
    by_place = comments.select("repo_id", F.col("comment_id").alias("by_place"), place("comment_id").alias("place"))
    f = findings.withColumn("place", place("finding_id")).join(by_key, ["repo_id", "file_path", "line_number"], "left").join(by_place, ["repo_id", "place"], "left")
    return f.select("finding_id", F.coalesce("by_key", "by_place").alias("comment_id"))
