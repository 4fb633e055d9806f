"""Detection and scoring as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import aggregates as A
from lodestone.operators import detection as D
from lodestone.operators import reachability as R
from lodestone.operators.windows import hotspots, within_budget
from lodestone.plans.registry import query
from lodestone.storage import written


def _dense(m):
    """Nodes with degrees large enough for thresholds."""
    return m.degrees.withColumns({"incoming_count": (F.col("incoming_count") * F.col("file_id") % 900).cast("int"), "outgoing_count": (F.col("file_id") % 41).cast("int")})


_DENSE = ", x AS (SELECT * REPLACE (incoming_count * file_id % 900 AS incoming_count, file_id % 41 AS outgoing_count) FROM degrees)"
query(
    "D1_god_files",
    lambda m: D.god_files(_dense(m)),
    f"{_DENSE}, n AS (SELECT *, incoming_count >= 10 AND incoming_count > 0.3 * count(*) OVER () AS c, coalesce(complexity_score, 0) > 30 OR (line_count > 500 AND incoming_count > 0.1 * count(*) OVER ()) AS b FROM x) SELECT file_path, CASE WHEN c AND b THEN 'high' ELSE 'medium' END AS severity FROM n WHERE c OR b",
    "degrees",
)
query("D2_high_coupling", lambda m: D.high_coupling(_dense(m)), f"{_DENSE} SELECT file_path, CASE WHEN outgoing_count >= 30 THEN 'high' WHEN outgoing_count >= 20 THEN 'medium' ELSE 'low' END AS severity FROM x WHERE outgoing_count > 15", "degrees")
query("D3_dead_code", lambda m: D.dead_code(m.degrees), "SELECT file_path FROM degrees WHERE incoming_count = 0 AND coalesce(language, '') <> 'csharp' AND NOT starts_with(file_path, 'tests/')", "degrees")
_P90 = "(SELECT list_sort(list(coalesce({0}, 0)))[(count(*) - 1) * 9 // 10 + 1] FROM x y WHERE NOT y.is_test_file AND y.repo_id = x.repo_id)"
query(
    "D4_untested_critical",
    lambda m: D.untested_critical(m.degrees),
    f", x AS (SELECT * FROM degrees) SELECT repo_id, file_path FROM x WHERE NOT is_test_file AND NOT has_test_coverage AND (coalesce(complexity_score, 0) >= {_P90.format('complexity_score')} OR incoming_count >= {_P90.format('incoming_count')})",
    "degrees",
)


def _risk(m):
    seeds = m.issues.select(F.col("id").alias("node"))
    counts = R.transitive_counts(m.edge_ids, seeds, enough=99).join(m.nodes.select(F.col("file_id").alias("seed"), "file_path"), "seed").select("file_path", "n")
    churn = written(m.churn.select("file_path", "commit_count", "commits_in_last_30d"), "churn")  # read twice
    return D.risk_scores(m.issues, counts, churn.select("file_path", "commits_in_last_30d"), A.median_of(churn, "commit_count").select((F.col("median") / 10).alias("median")))


query(
    "D5_risk_scores",
    _risk,
    ", reach(a, b) AS (SELECT a, b FROM edge_ids UNION SELECT r.a, e.b FROM reach r JOIN edge_ids e ON r.b = e.a), t AS (SELECT b AS seed, count(*) AS n FROM (SELECT a, b FROM reach WHERE a <> b EXCEPT SELECT a, b FROM edge_ids) GROUP BY 1), p AS (SELECT id, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS weight, least(3.0, 1 + log10(1 + coalesce(n, 0))) AS blast, CASE WHEN commits_in_last_30d IS NULL OR md = 0 THEN 1.0 ELSE least(2.0, 1 + commits_in_last_30d / md) END AS churn FROM issues LEFT JOIN t ON seed = id LEFT JOIN churn ON churn.file_path = file_paths[1], (SELECT median(commit_count) / 10 AS md FROM churn)) SELECT id, weight, round(blast, 6)::DOUBLE AS blast, round(churn, 6)::DOUBLE AS churn, round(weight * blast * churn, 4)::DOUBLE AS risk_score FROM p",
    "edge_ids", "issues", "churn",
    recursive=True,
)
query(
    "D6_hotspot_score",
    lambda m: hotspots(m.churn, m.nodes, None).select("file_path", F.round("score", 6).alias("score"), "severity"),
    ", j AS (SELECT c.file_path, commit_count, coalesce(complexity_score, 0) AS cx FROM churn c LEFT JOIN nodes USING (file_path)), s AS (SELECT file_path, commit_count / greatest(1, max(commit_count) OVER ()) * (cx / greatest(1, max(cx) OVER ())) AS score FROM j) SELECT file_path, round(score, 6) AS score, CASE WHEN score > 0.5 THEN 'high' ELSE 'medium' END AS severity FROM s WHERE score > 0",
    "churn", "nodes",
)
query("D14_test_paths", lambda m: m.nodes.where(D.is_test_path(F.col("file_path"))).select("file_path"), "SELECT file_path FROM nodes WHERE is_test_file", "nodes")
query("D15_coverage", lambda m: D.coverage(m.nodes, m.edges, m.nodes.where("file_id % 10 = 3").select("file_path", (F.col("file_id") % 4 * 25.0).alias("coverage_percentage"))), "SELECT n.file_path, CASE WHEN file_id % 10 = 3 THEN file_id % 4 > 0 ELSE n.file_path IN (SELECT to_path FROM edges WHERE from_path LIKE 'tests/%') END AS covered FROM nodes n", "nodes", "edges")
query("D16_coverage_paths", lambda m: D.match_coverage_paths(m.nodes.select(F.concat(F.lit("/root/app/"), "file_path").alias("reported")), m.nodes.select("file_path")), "SELECT '/root/app/' || file_path AS reported, file_path FROM nodes", "nodes")
query("D17_cvss", lambda m: m.table("lineitem").groupBy(D.cvss_severity(F.col("l_quantity") / 5).alias("severity")).agg(F.count("*").alias("n")), "SELECT CASE WHEN l_quantity / 5 < 4 THEN 'low' WHEN l_quantity / 5 <= 7 THEN 'medium' ELSE 'high' END AS severity, count(*) AS n FROM lineitem GROUP BY 1")
query(
    "D18_first_fixed",
    lambda m: m.table("part").select("p_partkey", D.first_fixed(F.array(F.struct(F.lit("x").alias("package"), F.lit("npm").alias("ecosystem"), F.array(F.lit("0")).alias("fixed")), F.struct(F.col("p_name").alias("package"), F.lit("npm").alias("ecosystem"), F.array(F.col("p_size").cast("string"), F.lit("9")).alias("fixed"))), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, "npm").otherwise("pypi")).alias("fixed")),
    "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR END AS fixed FROM part",
)
query("D19_dependency_issues", lambda m: D.dependency_issues(m.dependencies), "SELECT id, package_name, pkg_version, v.id AS vuln_id, v.severity AS severity FROM (SELECT id, package_name, pkg_version, unnest(vulns) AS v FROM dependencies)", "dependencies")
query("D20_cache_misses", lambda m: D.cache_split(m.usage.select("user_id", "endpoint").distinct(), m.usage.select("user_id", "endpoint", "created_at"), ["user_id", "endpoint"], "2024-01-20")[1], "SELECT user_id, endpoint FROM usage GROUP BY 1, 2 HAVING NOT coalesce(bool_or(created_at > TIMESTAMP '2024-01-19'), FALSE)", "usage")
_COUNTS = ", c AS (SELECT finding_id // 4 AS review, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) AS total FROM findings GROUP BY 1)"


def _reviews(m):
    """One or two findings make a review; those of two are ready."""
    return A.severity_counts(m.findings.withColumn("review", F.expr("finding_id div 4")), ["review"]).withColumn("status", F.when(F.col("total") > 1, "ready"))


query("D21_gate", lambda m: D.gate(_reviews(m), ["critical"]).select("review", "fails"), f"{_COUNTS} SELECT review, total <= 1 OR critical > 0 AS fails FROM c", "findings")
query("D22_review_event", lambda m: D.review_event(_reviews(m), "high").select("review", "event"), f"{_COUNTS} SELECT review, CASE WHEN critical + high > 0 THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END AS event FROM c", "findings")
query(
    "D23_new_in_diff",
    lambda m: D.new_in_diff(_dense(m).where("file_id % 3 <> 0"), _dense(m).withColumn("line_count", F.col("line_count") + 50)),
    f"{_DENSE}, k AS (SELECT file_path, file_id, unnest([CASE WHEN coalesce(complexity_score, 0) > 30 OR line_count + 50 > 500 THEN 'god_file' END, CASE WHEN outgoing_count > 15 THEN 'high_coupling' END]) AS type FROM x), b AS (SELECT file_path, unnest([CASE WHEN coalesce(complexity_score, 0) > 30 OR line_count > 500 THEN 'god_file' END, CASE WHEN outgoing_count > 15 THEN 'high_coupling' END]) AS type FROM x WHERE file_id % 3 <> 0) SELECT file_path, type FROM k WHERE type IS NOT NULL EXCEPT SELECT file_path, type FROM b",
    "degrees",
)
query("D24_version_changes", lambda m: D.version_changes(m.dependencies.where("repo_id = 'Brand#1'"), m.dependencies.where("repo_id = 'Brand#2'")), "SELECT a.package_name, a.pkg_version AS old_version, b.pkg_version AS new_version FROM dependencies a JOIN dependencies b USING (package_name) WHERE a.repo_id = 'Brand#1' AND b.repo_id = 'Brand#2' AND a.pkg_version <> b.pkg_version", "dependencies")
query("D25_batch_key", lambda m: m.issues.groupBy("repo_id").agg(D.batch_key(F.collect_list(F.col("id").cast("string"))).alias("batch_key")), "SELECT repo_id, sha256(string_agg(id::VARCHAR, ',' ORDER BY id::VARCHAR))[1:16] AS batch_key FROM issues GROUP BY 1", "issues")
query("D26_context_hash", lambda m: m.texts.select("id", D.context_hash(F.col("content"), F.lit(2)).alias("h")), "SELECT id, sha256(array_to_string(string_split(content, chr(10))[1:3], chr(10))) AS h FROM texts", "texts")
query(
    "D27_added_lines",
    lambda m: D.added_lines(m.table("part").select("p_partkey", F.concat(F.lit("@@ -1,2 +"), F.col("p_size").cast("string"), F.lit(",3 @@\n a\n-b\n+"), "p_name", F.lit("\n+z\n@@ -9 +90 @@\n c\n+last")).alias("patch")), "p_partkey", "patch"),
    "SELECT p_partkey, p_size + 1 AS line_number, p_name AS text FROM part UNION ALL SELECT p_partkey, p_size + 2, 'z' FROM part UNION ALL SELECT p_partkey, 91, 'last' FROM part",
)
query("D28_finding_id", lambda m: m.findings.select("finding_id", D.finding_id(F.col("file_path"), F.col("line_number"), F.col("rule_id"), F.col("message")).alias("hex")), "SELECT finding_id, sha1(file_path || ':' || line_number || ':' || rule_id || ':' || message)[1:16] AS hex FROM findings", "findings")
query("D29_audit_budget", lambda m: within_budget(m.texts.withColumn("tokens", D.audit_tokens(F.col("n_chars"))), ["repo_id"], ["id"], F.col("tokens"), 20000, first_always=False).select("id", "tokens"), ", t AS (SELECT id, repo_id, 3212 + least(ceil(n_chars / 4), 5000)::BIGINT AS tokens FROM texts), s AS (SELECT *, sum(tokens) OVER (PARTITION BY repo_id ORDER BY id) AS s FROM t) SELECT id, tokens FROM s WHERE s <= 20000", "texts")
query("D31_review_status", lambda m: _reviews(m).select("review", D.review_status(F.col("status"), F.col("critical"), F.col("high"), F.col("total")).alias("state")), f"{_COUNTS} SELECT review, CASE WHEN total <= 1 THEN 'not_reviewed' WHEN critical + high > 0 THEN 'blocking' ELSE 'findings' END AS state FROM c", "findings")
query("D32_staleness", lambda m: m.nodes.select("file_id", D.staleness(F.when(F.col("file_id") % 3 > 0, F.col("content_hash")), F.when(F.col("file_id") % 3 == 1, F.col("content_hash")).otherwise("abcdefghij")).alias("note")), "SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 'Index commit is unknown' WHEN file_id % 3 = 2 THEN 'Index is at ' || content_hash[1:7] || ', head is abcdefg' END AS note FROM nodes", "nodes")
