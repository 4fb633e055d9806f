"""Joins and set operations as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import joins as J
from lodestone.operators.aggregates import severity_counts
from lodestone.plans.registry import query


def _teams(m):
    shares = m.table("supplier").select(F.col("s_suppkey").alias("repo_id"), F.col("s_nationkey").alias("team_id"))
    members = m.table("customer").select(F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey") % 40).alias("user_id"), F.col("c_nationkey").alias("team_id"))
    return shares, members


_TEAMS = "WITH shares AS (SELECT s_suppkey AS repo_id, s_nationkey AS team_id FROM supplier), members AS (SELECT CASE WHEN c_custkey % 10 <> 0 THEN c_custkey % 40 END AS user_id, c_nationkey AS team_id FROM customer)"
query("J1_inner", lambda m: J.shares_of_members(*_teams(m)), f"{_TEAMS} SELECT DISTINCT repo_id, user_id FROM shares JOIN members USING (team_id)")
query("J4_left_counts", lambda m: J.left_counts(m.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), m.table("orders"), "o_custkey"), "SELECT c_custkey AS o_custkey, c_name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
query(
    "J5_embedded",
    lambda m: _teams(m)[0].join(m.table("nation").select(F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("team")), "team_id", "left").select("repo_id", "team"),
    f"{_TEAMS} SELECT repo_id, n_name AS team FROM shares LEFT JOIN nation ON n_nationkey = team_id",
)
query("J6_inner_filter", lambda m: m.findings.join(m.issues.where("repo_id = 'Brand#3'").select(F.explode("file_paths").alias("file_path"), F.col("id").alias("issue_id")), "file_path").select("finding_id", "issue_id"), "SELECT finding_id, i.id AS issue_id FROM findings f JOIN (SELECT id, unnest(file_paths) AS p FROM issues WHERE repo_id = 'Brand#3') i ON i.p = f.file_path", "findings", "issues")
query("J7_churn_complexity", lambda m: J.with_metric(m.churn.select("file_path", "commit_count"), m.nodes, "file_path", {"complexity_score": 0}), "SELECT file_path, commit_count, coalesce(complexity_score, 0) AS complexity_score FROM churn LEFT JOIN nodes USING (file_path)", "churn", "nodes")
query("J8_nodes_churn", lambda m: J.with_metric(m.nodes.select("file_path", "line_count"), m.churn.where("commit_count > 25"), "file_path", {"commit_count": 0, "unique_authors": 0}), "SELECT file_path, line_count, coalesce(commit_count, 0) AS commit_count, coalesce(unique_authors, 0) AS unique_authors FROM nodes LEFT JOIN (SELECT * FROM churn WHERE commit_count > 25) USING (file_path)", "churn", "nodes")


def _deps_full(m):
    d = m.dependencies.where("repo_id in ('Brand#1', 'Brand#2', 'Brand#3')").withColumn("vuln_count", F.size("vulns").cast("long"))
    groups = m.dependencies.where("repo_id in ('Brand#3', 'Brand#4')").groupBy(F.substring_index("manifest_path", "/", 1).alias("manifest_dir"), "package_name", "pkg_version").agg(F.count("*").alias("vuln_count"))
    return J.dependencies_with_issues(d.select("manifest_path", "package_name", "pkg_version", "vuln_count"), groups)


query(
    "J9_dependencies_full",
    _deps_full,
    ", d AS (SELECT * FROM (SELECT string_split(manifest_path, '/')[1] AS manifest_dir, package_name, pkg_version, manifest_path, len(vulns) AS vc, row_number() OVER (PARTITION BY string_split(manifest_path, '/')[1], package_name, pkg_version ORDER BY len(vulns) DESC, manifest_path) AS k FROM dependencies WHERE repo_id IN ('Brand#1', 'Brand#2', 'Brand#3')) WHERE k = 1), g AS (SELECT string_split(manifest_path, '/')[1] AS manifest_dir, package_name, pkg_version, count(*) AS gc FROM dependencies WHERE repo_id IN ('Brand#3', 'Brand#4') GROUP BY 1, 2, 3) SELECT manifest_dir, package_name, pkg_version, manifest_path, coalesce(gc, vc) AS vuln_count, gc IS NOT NULL AS from_issues FROM d FULL JOIN g USING (manifest_dir, package_name, pkg_version)",
    "dependencies",
)
_HEAD = "SELECT file_path, CASE WHEN file_id % 5 = 0 THEN 'x' ELSE content_hash END AS h FROM nodes WHERE file_id % 11 <> 0"


def _trees(m):
    head = m.nodes.where("file_id % 11 <> 0").withColumn("content_hash", F.when(F.col("file_id") % 5 == 0, "x").otherwise(F.col("content_hash")))
    return m.nodes.where("file_id % 13 <> 0"), head


query(
    "J10_tree_status",
    lambda m: J.tree_status(*_trees(m)),
    f", h AS ({_HEAD}) SELECT file_path, CASE WHEN b.content_hash IS NULL THEN 'added' WHEN h IS NULL THEN 'removed' WHEN b.content_hash <> h THEN 'modified' ELSE 'unchanged' END AS status FROM (SELECT * FROM nodes WHERE file_id % 13 <> 0) b FULL JOIN h USING (file_path)",
    "nodes",
)
query("J11_real_targets", lambda m: J.real_targets(m.edges, m.nodes.where("file_id % 4 <> 0")).select("from_path", "to_path"), "SELECT from_path, to_path FROM edges WHERE to_path IN (SELECT file_path FROM nodes WHERE file_id % 4 <> 0)", "edges", "nodes")
query("J12_induced", lambda m: J.induced(m.edges, m.nodes.where("line_count >= 300")).select("from_path", "to_path"), ", p AS (SELECT file_path FROM nodes WHERE line_count >= 300) SELECT from_path, to_path FROM edges WHERE from_path IN (FROM p) AND to_path IN (FROM p)", "edges", "nodes")
query("J13_end_ids", lambda m: J.with_end_ids(m.edges, m.nodes.where("file_id % 4 <> 0")), "SELECT a AS source, b AS target FROM edge_ids WHERE a % 4 <> 0 AND b % 4 <> 0", "edge_ids")
query("J14_unsuppressed_exact", lambda m: J.unsuppressed(m.findings, m.suppressions, False).select("finding_id"), "SELECT finding_id FROM findings f WHERE NOT EXISTS (SELECT 1 FROM suppressions s WHERE s.file_path = f.file_path AND s.rule_id = f.rule_id AND s.line_number IS NOT DISTINCT FROM f.line_number)", "findings", "suppressions")
query("J15_unsuppressed_wildcard", lambda m: J.unsuppressed(m.findings, m.suppressions, True).select("finding_id"), "SELECT finding_id FROM findings f WHERE NOT EXISTS (SELECT 1 FROM suppressions s WHERE s.file_path = f.file_path AND s.rule_id = f.rule_id AND (s.line_number IS NULL OR s.line_number = f.line_number))", "findings", "suppressions")
query(
    "J16_unknown_findings",
    lambda m: J.unknown_findings(m.findings, m.issues).select("finding_id"),
    ", i AS (SELECT unnest(file_paths) AS p, type, regexp_extract(description, 'line (\\d+)', 1) AS l, lower(description) AS d FROM issues), k AS (SELECT unnest([p || '|' || type || '|' || l, p || '|' || type || '|' || d, p || '|' || l || '|' || d]) AS key FROM i), f AS (SELECT finding_id, unnest([file_path || '|' || rule_id || '|' || line_number, file_path || '|' || rule_id || '|' || lower(message), file_path || '|' || line_number || '|' || lower(message)]) AS key FROM findings) SELECT finding_id FROM findings WHERE finding_id NOT IN (SELECT finding_id FROM f WHERE key IN (SELECT key FROM k))",
    "findings", "issues",
)
query("J17_new_dependencies", lambda m: J.new_rows(m.dependencies.where("repo_id = 'Brand#5'"), m.dependencies.where("repo_id <> 'Brand#5'"), ["ecosystem", "package_name", "pkg_version"]).select("id"), "SELECT id FROM dependencies d WHERE repo_id = 'Brand#5' AND NOT EXISTS (SELECT 1 FROM dependencies b WHERE b.repo_id <> 'Brand#5' AND b.package_name = d.package_name AND b.pkg_version = d.pkg_version)", "dependencies")


def _contexts(m):
    h = F.sha2(F.concat_ws("|", "message", (F.col("line_number") % 7).cast("string")), 256)
    f = m.findings.withColumn("context_hash", h)
    return f.where("finding_id % 2 = 0"), f.where("finding_id % 4 = 3"), m.suppressions.where("line_number is not null")


query(
    "J18_fresh_on_added_lines",
    lambda m: J.fresh_on_added_lines(*_contexts(m)).select("finding_id"),
    ", f AS (SELECT *, sha256(message || '|' || (line_number % 7)) AS h FROM findings) SELECT finding_id FROM f WHERE finding_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM f b WHERE b.finding_id % 4 = 3 AND b.rule_id = f.rule_id AND b.h = f.h) AND EXISTS (SELECT 1 FROM suppressions s WHERE s.file_path = f.file_path AND s.line_number = f.line_number)",
    "findings", "suppressions",
)
query(
    "J19_link_findings",
    lambda m: J.link_findings(m.findings, m.issues),
    ", i AS (SELECT DISTINCT id, unnest(file_paths) AS p, type, regexp_extract(description, 'line (\\d+)', 1)::INT AS l FROM issues), s AS (SELECT finding_id, i.id AS issue_id, 1 + CASE WHEN rule_id = type THEN 3 WHEN string_split(rule_id, '_')[1] = string_split(type, '_')[1] THEN 2 ELSE 0 END + CASE WHEN abs(line_number - l) = 0 THEN 3 WHEN abs(line_number - l) <= 5 THEN 2 WHEN abs(line_number - l) <= 20 THEN 1 ELSE 0 END AS score FROM findings JOIN i ON i.p = file_path) SELECT * FROM s WHERE score > 1",
    "findings", "issues",
)
query("J20_line_proximity", lambda m: m.table("lineitem").groupBy(J.line_proximity(F.col("l_quantity"), F.lit(20)).alias("proximity")).agg(F.count("*").alias("n")), "SELECT CASE WHEN abs(l_quantity - 20) = 0 THEN 3 WHEN abs(l_quantity - 20) <= 5 THEN 2 WHEN abs(l_quantity - 20) <= 20 THEN 1 ELSE 0 END AS proximity, count(*) AS n FROM lineitem GROUP BY 1")


def _comments(m):
    return m.findings.where("finding_id % 2 = 0").select((F.col("finding_id") * 10).alias("comment_id"), "repo_id", "file_path", "line_number")


_COMMENTS = "c AS (SELECT finding_id * 10 AS comment_id, repo_id, file_path, line_number FROM findings WHERE finding_id % 2 = 0)"
query("J21_first_match", lambda m: J.first_match(m.findings.select("finding_id", "repo_id", "line_number"), _comments(m), ["repo_id", "line_number"], ["comment_id"], ["comment_id"]).select("finding_id", "comment_id"), f", {_COMMENTS} SELECT finding_id, (SELECT min(comment_id) FROM c WHERE c.repo_id = f.repo_id AND c.line_number = f.line_number) AS comment_id FROM findings f", "findings")
query("J22_share_impact", lambda m: J.share_impact(_teams(m)[0].withColumnRenamed("repo_id", "item_id"), _teams(m)[1], F.col("item_id") % 40), f"{_TEAMS} SELECT repo_id AS item_id, count(DISTINCT user_id) AS n_members FROM shares JOIN members USING (team_id) WHERE user_id <> repo_id % 40 GROUP BY 1")
query("J23_recipients", lambda m: J.recipients(_teams(m)[0].select("repo_id", (F.col("repo_id") % 40).alias("user_id")), J.shares_of_members(*_teams(m))), f"{_TEAMS} SELECT repo_id, repo_id % 40 AS user_id FROM shares UNION SELECT repo_id, user_id FROM shares JOIN members USING (team_id) WHERE user_id IS NOT NULL")
query("J24_owned_or_shared", lambda m: J.owned_or_shared(_teams(m)[0].where("repo_id % 4 = 1"), _teams(m)[0].where("team_id % 3 = 0")), f"{_TEAMS} SELECT repo_id, 'owner' AS access, NULL::BIGINT AS team_id FROM shares WHERE repo_id % 4 = 1 UNION ALL SELECT repo_id, 'shared', min(team_id)::BIGINT FROM shares WHERE team_id % 3 = 0 AND repo_id % 4 <> 1 GROUP BY 1")
query("J25_split_comments", lambda m: J.split_comments(_comments(m), m.suppressions.where("line_number is not null")).select("comment_id", "action"), f", {_COMMENTS} SELECT comment_id, CASE WHEN EXISTS (SELECT 1 FROM suppressions s WHERE s.file_path = c.file_path AND s.line_number = c.line_number) THEN 'outdated' ELSE 'delete' END AS action FROM c", "findings", "suppressions")
query(
    "J26_match_comments",
    lambda m: J.match_comments(m.findings, _comments(m)),
    f", {_COMMENTS}, p AS (SELECT repo_id, comment_id, row_number() OVER (PARTITION BY repo_id ORDER BY comment_id) AS place FROM c), f AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY finding_id) AS place FROM findings) SELECT finding_id, coalesce((SELECT min(comment_id) FROM c WHERE c.repo_id = f.repo_id AND c.file_path = f.file_path AND c.line_number = f.line_number), p.comment_id) AS comment_id FROM f LEFT JOIN p USING (repo_id, place)",
    "findings",
)
query("J27_review_detail", lambda m: severity_counts(J.unsuppressed(m.findings, m.suppressions, True), ["repo_id"]).select("repo_id", "critical", "high", "total"), "SELECT repo_id, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) AS total FROM findings f WHERE NOT EXISTS (SELECT 1 FROM suppressions s WHERE s.file_path = f.file_path AND s.rule_id = f.rule_id AND (s.line_number IS NULL OR s.line_number = f.line_number)) GROUP BY 1", "findings", "suppressions")

# --- set operations
query("U1_union_keys", lambda m: _trees(m)[0].select("file_path").union(_trees(m)[1].select("file_path")).distinct(), f"SELECT file_path FROM nodes WHERE file_id % 13 <> 0 UNION SELECT file_path FROM ({_HEAD})", "nodes")
query("U2_edge_difference", lambda m: m.edges.where("from_path like 'src%'").select("from_path", "to_path").subtract(m.edges.where("to_path like 'tests%'").select("from_path", "to_path")), "SELECT from_path, to_path FROM edges WHERE from_path LIKE 'src%' EXCEPT SELECT from_path, to_path FROM edges WHERE to_path LIKE 'tests%'", "edges")
query("U3_deleted_paths", lambda m: _trees(m)[0].join(_trees(m)[1], "file_path", "left_anti").select("file_path"), f"SELECT file_path FROM nodes WHERE file_id % 13 <> 0 AND file_path NOT IN (SELECT file_path FROM ({_HEAD}))", "nodes")
query("U4_concatenate", lambda m: m.issues.where("severity = 'high'").select("id", "type").unionByName(m.issues.where("type = 'secret'").select("type", "id")), "SELECT id, type FROM issues WHERE severity = 'high' UNION ALL SELECT id, type FROM issues WHERE type = 'secret'", "issues")
query("U5_distinct", lambda m: m.edges.select("to_path").distinct(), "SELECT DISTINCT to_path FROM edges", "edges")
query(
    "U7_split_tours",
    lambda m: m.table("conversations").select("conv_id").distinct().select(F.col("conv_id").alias("id"), (F.col("conv_id") % 5 == 0).alias("featured"), (F.col("conv_id") % 3 == 1).alias("mine"), ((F.col("conv_id") % 2 == 0) & (F.col("conv_id") % 3 != 1)).alias("team")).where("featured or mine or team"),
    "SELECT DISTINCT conv_id AS id, conv_id % 5 = 0 AS featured, conv_id % 3 = 1 AS mine, conv_id % 2 = 0 AND conv_id % 3 <> 1 AS team FROM conversations WHERE conv_id % 5 = 0 OR conv_id % 3 = 1 OR conv_id % 2 = 0",
)
