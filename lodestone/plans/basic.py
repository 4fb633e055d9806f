"""Filters, projections and aggregates as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import aggregates as A
from lodestone.operators import predicates as P
from lodestone.plans.model import ISSUE_TYPES
from lodestone.plans.registry import query

# --- filters and projections
query("P1_equal", lambda m: P.not_equal(P.equal(m.nodes, language="python"), repo_id="Brand#2").select("file_id", "file_path"), "SELECT file_id, file_path FROM nodes WHERE language = 'python' AND repo_id <> 'Brand#2'", "nodes")
query("P2_range", lambda m: P.between(m.nodes, "line_count", 100, 300).select("file_id", "line_count"), "SELECT file_id, line_count FROM nodes WHERE line_count >= 100 AND line_count < 300", "nodes")
query(
    "P3_member",
    lambda m: P.member(P.member(m.nodes, "language", ["python", "go"]), "file_path", m.edges.select("to_path")).select("file_id"),
    "SELECT file_id FROM nodes WHERE language IN ('python', 'go') AND file_path IN (SELECT to_path FROM edges)",
    "nodes", "edges",
)
query("P4_null", lambda m: P.missing(m.nodes, "complexity_score").select("file_id"), "SELECT file_id FROM nodes WHERE complexity_score IS NULL", "nodes")
query(
    "P5_tuples",
    lambda m: P.tuples_in(m.findings, m.suppressions.select("repo_id", "file_path", "rule_id"), ["repo_id", "file_path", "rule_id"]).select("finding_id"),
    "SELECT finding_id FROM findings f WHERE EXISTS (SELECT 1 FROM suppressions s WHERE s.repo_id = f.repo_id AND s.file_path = f.file_path AND s.rule_id = f.rule_id)",
    "findings", "suppressions",
)
query("P6_contains", lambda m: P.contains(m.issues, "file_paths", "src/d2/f2.cs").select("id", "type"), "SELECT id, type FROM issues WHERE list_contains(file_paths, 'src/d2/f2.cs')", "issues")
query("P7_json_value", lambda m: P.json_value(m.table("events"), "props", "$.k", "7").select("event_id"), "SELECT event_id FROM events WHERE props->>'$.k' = '7'")
query("P8_overlaps", lambda m: P.overlaps(m.issues, "file_paths", ["src/d2/f2.cs", "src/d17/f17.py", "src/d10/f10.cs"]).select("id"), "SELECT id FROM issues WHERE list_has_any(file_paths, ['src/d2/f2.cs', 'src/d17/f17.py', 'src/d10/f10.cs'])", "issues")
query("P9_ilike", lambda m: P.ilike(m.issues, "description", "RED w").select("id", "description"), "SELECT id, description FROM issues WHERE description ILIKE '%RED w%'", "issues")
query("P10_match", lambda m: P.equal(m.issues, type="secret", severity="high").select("id"), "SELECT id FROM issues WHERE type = 'secret' AND severity = 'high'", "issues")
query(
    "P11_subset",
    lambda m: P.subset_of(m.issues.crossJoin(F.broadcast(m.nodes.where("file_id < 40").agg(F.collect_list("file_path").alias("allowed")))), "file_paths", F.col("allowed")).select("id"),
    "SELECT id FROM issues WHERE len(file_paths) > 0 AND list_has_all((SELECT list(file_path) FROM nodes WHERE file_id < 40), file_paths)",
    "nodes", "issues",
)


def _accessible(m):
    repos = m.table("supplier").select(F.col("s_suppkey").alias("repo_id"), (F.col("s_suppkey") % 10).alias("owner_id"), "s_nationkey")
    shares = repos.select("repo_id", F.col("s_nationkey").alias("team_id"))
    members = m.table("customer").select((F.col("c_custkey") % 50).alias("user_id"), F.col("c_nationkey").alias("team_id"))
    return P.accessible(repos, 3, "owner_id", shares, members).select("repo_id")


query(
    "P12_accessible",
    _accessible,
    "SELECT s_suppkey AS repo_id FROM supplier WHERE s_suppkey % 10 = 3 OR EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_custkey % 50 = 3)",
)
query(
    "P13_nested_membership",
    lambda m: P.member(m.table("customer"), "c_nationkey", P.member(m.table("nation").select("n_nationkey", "n_regionkey"), "n_regionkey", m.table("region").where("r_name = 'ASIA'").select("r_regionkey"))).select("c_custkey"),
    "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA'))",
)
query("P14_project", lambda m: m.nodes.select("file_path", "language", "line_count"), "SELECT file_path, language, line_count FROM nodes", "nodes")
query(
    "P15_conditionals",
    lambda m: m.nodes.select("file_id", F.coalesce("complexity_score", F.lit(0)).alias("cx"), F.when(F.col("line_count") > 500, "large").otherwise("small").alias("size_class"), F.nullif("language", F.lit("go")).alias("language2"), F.least("line_count", F.lit(400)).alias("lo"), F.greatest("line_count", F.lit(400)).alias("hi")),
    "SELECT file_id, coalesce(complexity_score, 0) AS cx, CASE WHEN line_count > 500 THEN 'large' ELSE 'small' END AS size_class, nullif(language, 'go') AS language2, least(line_count, 400) AS lo, greatest(line_count, 400) AS hi FROM nodes",
    "nodes",
)
query("P16_search_issues", lambda m: P.search_issues(m.issues, "D7/F").select("id"), "SELECT id FROM issues WHERE lower(description) LIKE '%d7/f%' OR len(list_filter(file_paths, lambda p: lower(p) LIKE '%d7/f%')) > 0", "issues")
query("P17_search_dependencies", lambda m: P.search_dependencies(m.dependencies, "bolt", "npm", True).select("id", "package_name"), "SELECT id, package_name FROM dependencies WHERE lower(package_name) LIKE '%bolt%' AND ecosystem = 'npm' AND len(vulns) > 0", "dependencies")
query("P18_metrics_rows", lambda m: P.metrics_rows(m.nodes, "src/d1", 10, 20).select("file_id", "complexity_score"), "SELECT file_id, complexity_score FROM nodes WHERE lower(file_path) LIKE '%src/d1%' AND complexity_score >= 10 AND complexity_score < 20", "nodes")
query("P19_recent", lambda m: P.recent(m.usage, "created_at", "2024-01-30", 7).groupBy("endpoint").agg(F.count("*").alias("n")), "SELECT endpoint, count(*) AS n FROM usage WHERE created_at >= DATE '2024-01-30' - 7 GROUP BY 1", "usage")
query(
    "P20_pull_requests",
    lambda m: P.pull_requests(m.table("orders").select(F.col("o_orderkey").alias("pr"), "o_custkey").join(m.findings.groupBy(F.col("finding_id").alias("o_custkey")).agg(F.count("*").alias("total_findings")), "o_custkey", "left"), "has_findings").select("pr"),
    "SELECT o_orderkey AS pr FROM orders WHERE o_custkey IN (SELECT finding_id FROM findings)",
    "findings",
)
query(
    "P21_channels",
    lambda m: P.channel_on(m.notifications, "email", F.when(F.col("user_id") % 4 == 0, F.create_map(F.lit("click"), F.lit(True), F.lit("error"), F.lit(True))).otherwise(F.create_map().cast("map<string,boolean>")), switch=F.col("user_id") % 5 != 0).groupBy("type").agg(F.count("*").alias("n")),
    "SELECT type, count(*) AS n FROM notifications WHERE user_id % 5 <> 0 AND (type IN ('view', 'purchase', 'signup') OR (user_id % 4 = 0 AND type IN ('click', 'error'))) GROUP BY 1",
    "notifications",
)
query("P22_json_field", lambda m: P.json_field(m.table("events"), "props", "$.k", "status").groupBy("status").agg(F.count("*").alias("n")), "SELECT props->>'$.k' AS status, count(*) AS n FROM events GROUP BY 1")

# --- aggregates
query("A1_degrees", lambda m: m.degrees.select("file_path", "incoming_count", "outgoing_count"), "SELECT file_path, incoming_count, outgoing_count FROM degrees", "degrees")
query("A2_languages", lambda m: A.language_histogram(m.nodes).drop("share"), "SELECT coalesce(language, 'unknown') AS language, count(*) AS n_files FROM nodes GROUP BY 1", "nodes")
query("A38_language_share", lambda m: A.language_histogram(m.nodes).select("language", F.round("share", 9).alias("share")), "SELECT coalesce(language, 'unknown') AS language, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM nodes GROUP BY 1", "nodes")
query(
    "A3_merge_edges",
    lambda m: A.merge_edges(m.edges.withColumn("to_path", A.folder(F.col("to_path")))),
    "SELECT from_path, regexp_replace(to_path, '/[^/]*$', '') AS to_path, list_sort(list_distinct(flatten(list(symbols)))) AS symbols FROM edges GROUP BY ALL",
    "edges",
)
query("A4_churn", lambda m: m.churn, "SELECT * FROM churn", "churn")
_PAIRS = "SELECT a AS id_a, b AS id_b, ((a * 31 + b) % 100) / 100.0::DOUBLE AS similarity FROM edge_ids"
query(
    "A5_canonical_pairs",
    lambda m: A.canonical_pairs(m.edge_ids.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), ((F.col("a") * 31 + F.col("b")) % 100 / 100.0).alias("similarity")), 0.92),
    f"SELECT least(id_a, id_b) AS chunk_a_id, greatest(id_a, id_b) AS chunk_b_id, max(similarity) AS similarity FROM ({_PAIRS}) WHERE id_a <> id_b GROUP BY 1, 2 HAVING max(similarity) > 0.92",
    "edge_ids",
)
query(
    "A6_dedupe_candidates",
    lambda m: A.canonical_pairs(m.edge_ids.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), F.when(F.col("a") % 9 == 0, F.lit(float("nan"))).otherwise((F.col("a") * 31 + F.col("b")) % 100 / 100.0).alias("similarity")), 0.5),
    f"SELECT least(id_a, id_b) AS chunk_a_id, greatest(id_a, id_b) AS chunk_b_id, max(similarity) AS similarity FROM ({_PAIRS}) WHERE id_a <> id_b AND id_a % 9 <> 0 GROUP BY 1, 2 HAVING max(similarity) > 0.5",
    "edge_ids",
)
_DAILY = "daily AS (SELECT user_id, created_at::DATE AS usage_date, sum(prompt_tokens + completion_tokens)::BIGINT AS total_tokens, count(*) AS requests FROM usage GROUP BY 1, 2)"
query("A7_usage_backfill", lambda m: A.backfill(A.usage_rollup(m.usage.where("user_id % 3 = 0")), A.usage_rollup(m.usage)), f", {_DAILY} SELECT user_id, usage_date, total_tokens, requests FROM daily WHERE user_id % 3 <> 0", "usage")
query("A8_usage_24h", lambda m: A.usage_since(m.usage, "2024-01-15 12:00:00"), "SELECT user_id, sum(prompt_tokens + completion_tokens)::BIGINT AS total_tokens, count(*) AS requests FROM usage WHERE created_at BETWEEN TIMESTAMP '2024-01-14 12:00:00' AND TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1", "usage")
query("A9_usage_today", lambda m: A.usage_on(m.usage, "2024-01-10"), "SELECT coalesce(sum(prompt_tokens), 0)::BIGINT AS prompt_tokens, coalesce(sum(completion_tokens), 0)::BIGINT AS completion_tokens, count(*) AS requests FROM usage WHERE created_at::DATE = DATE '2024-01-10'", "usage")
query("A10_rolling_budget", lambda m: A.rolling_budget(A.usage_rollup(m.usage), "2024-01-10"), f", {_DAILY} SELECT user_id, sum(total_tokens)::BIGINT AS tokens FROM daily WHERE usage_date IN (DATE '2024-01-10', DATE '2024-01-09') GROUP BY 1", "usage")


def _snapshot(m):
    edges = m.edges.join(m.nodes.select(F.col("file_path").alias("from_path"), "repo_id"), "from_path").groupBy("repo_id").agg(F.count("*").alias("n_edges"))
    repos = m.nodes.select("repo_id").distinct()
    return A.daily_snapshot(repos, m.nodes, edges, m.issues, m.dependencies, ISSUE_TYPES)


query(
    "A11_daily_snapshot",
    _snapshot,
    ", s AS (SELECT repo_id, count(*) AS n_files, sum(line_count)::BIGINT AS loc, coalesce(avg(complexity_score), 0) AS avg_complexity, coalesce(max(complexity_score), 0) AS max_complexity FROM nodes GROUP BY 1), e AS (SELECT repo_id, count(*) AS n_edges FROM edges JOIN nodes ON file_path = from_path GROUP BY 1), i AS (SELECT repo_id, "
    + ", ".join([f"count(*) FILTER (WHERE type = '{t}') AS n_{t}" for t in ISSUE_TYPES] + [f"count(*) FILTER (WHERE severity = '{s}') AS n_{s}" for s in A.SEVERITIES])
    + " FROM issues GROUP BY 1), d AS (SELECT repo_id, count(DISTINCT id) AS n_dependencies, count(DISTINCT id) FILTER (WHERE NOT is_transitive) AS n_direct, count(DISTINCT id) FILTER (WHERE len(vulns) > 0) AS n_vulnerable FROM dependencies GROUP BY 1), r AS (SELECT repo_id, list(id ORDER BY k) AS top_risks FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY risk_score DESC NULLS LAST, id) AS k FROM issues) WHERE k <= 10 GROUP BY 1) SELECT s.*, coalesce(n_edges, 0) AS n_edges, "
    + ", ".join(f"coalesce(n_{t}, 0) AS n_{t}" for t in (*ISSUE_TYPES, *A.SEVERITIES))
    + ", n_dependencies, n_direct, n_vulnerable, coalesce(top_risks, []) AS top_risks FROM s LEFT JOIN e USING (repo_id) LEFT JOIN i USING (repo_id) LEFT JOIN d USING (repo_id) LEFT JOIN r USING (repo_id)",
    "nodes", "edges", "issues", "dependencies",
)
query("A12_size_sums", lambda m: m.nodes.groupBy("repo_id").agg(F.sum("line_count").alias("loc"), F.avg("complexity_score").alias("avg_complexity"), F.max("complexity_score").alias("max_complexity")), "SELECT repo_id, sum(line_count)::BIGINT AS loc, avg(complexity_score) AS avg_complexity, max(complexity_score) AS max_complexity FROM nodes GROUP BY 1", "nodes")
query("A13_conditional_counts", lambda m: m.issues.groupBy("repo_id").agg(*[F.count_if(F.col("type") == t).alias(t) for t in ISSUE_TYPES]), "SELECT repo_id, " + ", ".join(f"count(*) FILTER (WHERE type = '{t}') AS {t}" for t in ISSUE_TYPES) + " FROM issues GROUP BY 1", "issues")
query("A14_distinct_filter", lambda m: m.dependencies.groupBy("repo_id").agg(F.count_distinct("id").alias("n"), F.count_distinct(F.when(F.size("vulns") > 0, F.col("package_name"))).alias("vulnerable")), "SELECT repo_id, count(DISTINCT id) AS n, count(DISTINCT package_name) FILTER (WHERE len(vulns) > 0) AS vulnerable FROM dependencies GROUP BY 1", "dependencies")
query(
    "A15_package_severity",
    lambda m: A.max_severity(m.dependencies).where("max_severity is not null").groupBy("max_severity").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("package_name")).alias("packages")),
    ", x AS (SELECT package_name, list_max(list_transform(vulns, lambda v: list_position(['low', 'medium', 'high'], v.severity))) AS k FROM dependencies WHERE len(vulns) > 0) SELECT (['low', 'medium', 'high'])[k] AS max_severity, count(*) AS n, list_sort(list(DISTINCT package_name)) AS packages FROM x GROUP BY 1",
    "dependencies",
)
query("A16_top_risks", lambda m: _snapshot(m).select("repo_id", "top_risks"), "SELECT repo_id, list(id ORDER BY k) AS top_risks FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY risk_score DESC NULLS LAST, id) AS k FROM issues) WHERE k <= 10 GROUP BY 1", "issues")
query("A18_severity_counts", lambda m: A.severity_counts(m.findings, ["repo_id"]), "SELECT repo_id, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low, count(*) AS total FROM findings GROUP BY 1", "findings")
query("A19_audit_counts", lambda m: A.counts_by(m.findings, "severity"), "SELECT severity, count(*) AS n FROM findings GROUP BY 1", "findings")
query("A20_security_weight", lambda m: A.security_weight(m.issues, ["secret", "missing_auth", "insecure_pattern"]), "SELECT p AS file_path, sum(CASE severity WHEN 'critical' THEN 20 WHEN 'high' THEN 10 WHEN 'medium' THEN 5 WHEN 'low' THEN 2 ELSE 5 END)::BIGINT AS weight FROM (SELECT unnest(file_paths) AS p, severity FROM issues WHERE type IN ('secret', 'missing_auth', 'insecure_pattern')) GROUP BY 1", "issues")
query("A21_median", lambda m: A.median_of(m.churn, "commits_in_last_30d"), "SELECT coalesce(median(commits_in_last_30d), 0)::DOUBLE AS median FROM churn", "churn")
_P90 = "p90 AS (SELECT repo_id, v AS p90 FROM (SELECT repo_id, coalesce(complexity_score, 0) AS v, row_number() OVER (PARTITION BY repo_id ORDER BY coalesce(complexity_score, 0)) AS k, count(*) OVER (PARTITION BY repo_id) AS n FROM nodes) WHERE k = (n - 1) * 9 // 10 + 1)"
query("A22_percentile_90", lambda m: A.percentile_90(m.nodes, "complexity_score", ["repo_id"]), f", {_P90} SELECT * FROM p90", "nodes")
query(
    "A23_folder_clusters",
    lambda m: A.folder_clusters(m.degrees, m.issues).withColumn("avg_complexity", F.round("avg_complexity", 6)),
    ", x AS (SELECT *, regexp_replace(file_path, '/[^/]*$', '') AS folder FROM degrees), h AS (SELECT DISTINCT unnest(file_paths) AS file_path, TRUE AS hit FROM issues), l AS (SELECT folder, arg_min(language, (-c, language)) AS dominant_language FROM (SELECT folder, coalesce(language, 'unknown') AS language, count(*) AS c FROM x GROUP BY 1, 2) GROUP BY 1) SELECT folder, count(*) AS n_files, sum(incoming_count)::BIGINT AS incoming, sum(outgoing_count)::BIGINT AS outgoing, sum(line_count)::BIGINT AS line_count, round(avg(complexity_score), 6) AS avg_complexity, coalesce(bool_or(hit), FALSE) AS has_issue, any_value(dominant_language) AS dominant_language FROM x LEFT JOIN h USING (file_path) JOIN l USING (folder) GROUP BY folder HAVING count(*) >= 3",
    "degrees", "issues",
)
query("A23_cluster_edges", lambda m: A.cluster_edges(m.edges), "SELECT regexp_replace(from_path, '/[^/]*$', '') AS from_folder, regexp_replace(to_path, '/[^/]*$', '') AS to_folder, count(*) AS n_edges FROM edges WHERE regexp_replace(from_path, '/[^/]*$', '') <> regexp_replace(to_path, '/[^/]*$', '') GROUP BY 1, 2", "edges")
query(
    "A24_health",
    lambda m: A.health(m.nodes, m.issues),
    f", {_P90}, c AS (SELECT repo_id, count(*) AS critical FROM issues WHERE severity = 'critical' GROUP BY 1), r AS (SELECT repo_id, count(*) AS n, count(*) FILTER (WHERE complexity_score > p90) AS at_risk FROM nodes JOIN p90 USING (repo_id) GROUP BY 1) SELECT repo_id, n, at_risk, coalesce(critical, 0) AS critical, greatest(0, least(100, round(100 - coalesce(critical, 0) * 200 / n - at_risk * 50 / n)::INT)) AS health FROM r LEFT JOIN c USING (repo_id)",
    "nodes", "issues",
)
query("A25_coverage", lambda m: A.coverage_summary(m.nodes, ["repo_id"]), "SELECT repo_id, count(*) AS n_source, count(*) FILTER (WHERE has_test_coverage) AS n_covered, round(count(*) FILTER (WHERE has_test_coverage) * 100 / count(*))::INT AS covered_percent FROM nodes WHERE NOT is_test_file GROUP BY 1", "nodes")
query("A26_histogram", lambda m: A.histogram(m.nodes, "complexity_score", 0, 54, 18), "SELECT CASE WHEN complexity_score >= 54 THEN 19 ELSE complexity_score // 3 + 1 END::BIGINT AS bin, count(*) AS n FROM nodes WHERE complexity_score IS NOT NULL GROUP BY 1", "nodes")
query("A27_maxima", lambda m: A.column_maxima(m.degrees, ["line_count", "incoming_count"], ["repo_id"]), "SELECT repo_id, greatest(1, max(line_count)) AS max_line_count, greatest(1, max(incoming_count)) AS max_incoming_count FROM degrees GROUP BY 1", "degrees")
query("A29_vulnerability_groups", lambda m: A.vulnerability_groups(m.issues), "SELECT file_paths[1] AS manifest_path, count(*) AS vuln_count, list(id ORDER BY id) AS ids FROM issues WHERE type = 'vulnerable_dependency' GROUP BY 1", "issues")
query("A30_issues_by_type", lambda m: A.issues_by_type(m.issues), "SELECT repo_id, type, count(*) AS n, arg_min(file_paths[1], id) AS first_path FROM issues GROUP BY 1, 2", "issues")
query("A31_max_severity", lambda m: A.max_severity(m.dependencies), "SELECT id, package_name, (['low', 'medium', 'high'])[list_max(list_transform(vulns, lambda v: list_position(['low', 'medium', 'high'], v.severity)))] AS max_severity FROM dependencies", "dependencies")
query("A32_grouped_findings", lambda m: A.grouped_findings(m.findings), "SELECT severity, file_path, list(line_number ORDER BY line_number) AS lines FROM findings GROUP BY 1, 2", "findings")
query("A33_path_tree", lambda m: A.path_tree(m.nodes), ", x AS (SELECT string_split(file_path, '/') AS p FROM nodes), y AS (SELECT array_to_string(p[1:i], '/') AS folder, i FROM (SELECT p, unnest(generate_series(1, len(p) - 1)) AS i FROM x)) SELECT folder, count(*) AS n_files, any_value(i)::INT AS depth FROM y GROUP BY 1", "nodes")
query("A34_unread", lambda m: A.unread(m.notifications), "SELECT user_id, count(*) AS unread FROM notifications WHERE read_at IS NULL GROUP BY 1", "notifications")
query(
    "A35_coupled_neighbours",
    lambda m: A.coupled_neighbours(m.edges),
    ", b AS (SELECT from_path AS file_path, to_path AS neighbour, symbols FROM edges UNION ALL SELECT to_path, from_path, symbols FROM edges), g AS (SELECT file_path, neighbour, count(*) AS n, list_sort(list_distinct(flatten(list(symbols)))) AS symbols FROM b GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY n DESC, neighbour) AS place FROM g) SELECT * FROM k WHERE place <= 5",
    "edges",
)
query("A36_top_importers", lambda m: A.top_importers(m.edges, "src/d1/f1.py"), "SELECT from_path, len(symbols) AS n_symbols FROM edges WHERE to_path = 'src/d1/f1.py' ORDER BY 2 DESC, 1 LIMIT 30", "edges")
query("A37_package_blast", lambda m: A.package_blast(m.edges, "/d7/"), "SELECT count(DISTINCT from_path) AS n_importers FROM edges WHERE to_path ILIKE '%/d7/%'", "edges")
query("A39_by_day", lambda m: A.by_day(m.notifications, "America/New_York"), "SELECT user_id, (created_at AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE AS day, list(id ORDER BY created_at DESC, id DESC) AS ids FROM notifications GROUP BY 1, 2", "notifications")
