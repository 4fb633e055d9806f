"""Incremental operators as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import aggregates as A
from lodestone.operators import incremental as R
from lodestone.plans.joins import _HEAD, _trees
from lodestone.plans.registry import query

_STATE = f", h AS ({_HEAD}), s AS (SELECT file_path, CASE WHEN h IS NULL THEN 'deleted' WHEN b.content_hash IS NULL THEN 'added' WHEN h = b.content_hash THEN 'unchanged' ELSE 'changed' END AS state FROM (SELECT * FROM nodes WHERE file_id % 13 <> 0) b FULL JOIN h USING (file_path))"


def _unchanged(m):
    return R.classify(*_trees(m)).where("state = 'unchanged'").select("file_path")


query("R1_classify", lambda m: R.classify(*_trees(m)), f"{_STATE} SELECT file_path, state FROM s", "nodes")
query("S9_upsert", lambda m: R.merge(m.nodes.where("file_id % 4 <> 0").select("file_path", "line_count"), m.nodes.where("file_id % 6 = 0").select("file_path", (F.col("line_count") + 1).alias("line_count")), ["file_path"]), "SELECT file_path, line_count + (file_id % 6 = 0)::INT AS line_count FROM nodes WHERE file_id % 4 <> 0 OR file_id % 6 = 0", "nodes")
query("S9_fill", lambda m: R.merge(m.nodes.where("file_id % 4 <> 0").select("file_path", "line_count"), m.nodes.where("file_id % 6 = 0").select("file_path", (F.col("line_count") + 1).alias("line_count")), ["file_path"], False), "SELECT file_path, line_count + (file_id % 12 = 0)::INT AS line_count FROM nodes WHERE file_id % 4 <> 0 OR file_id % 6 = 0", "nodes")
_KEEP = f"{_STATE}, k AS (SELECT id FROM issues WHERE type IN ('secret', 'missing_auth', 'insecure_pattern') AND list_has_all((SELECT list(file_path) FROM s WHERE state = 'unchanged'), file_paths))"
_TYPES = ["secret", "missing_auth", "insecure_pattern"]
query("R2_preserved", lambda m: R.preserved_issues(m.issues, _unchanged(m), _TYPES).select("id"), f"{_KEEP} SELECT id FROM k", "nodes", "issues")


def _stale(m):
    proposals = m.issues.select((F.col("id") * 10).alias("proposal_id"), F.col("id").alias("issue_id"), F.when(F.col("id") % 3 == 0, "pending").otherwise("applied").alias("status"))
    gone = m.issues.join(R.preserved_issues(m.issues, _unchanged(m), _TYPES).select("id"), "id", "left_anti")
    return R.mark_stale(proposals, gone).select("proposal_id", "status")


query("R3_stale", _stale, f"{_KEEP} SELECT id * 10 AS proposal_id, CASE WHEN id % 3 <> 0 THEN 'applied' WHEN id IN (FROM k) THEN 'pending' ELSE 'stale' END AS status FROM issues", "nodes", "issues")
query("R4_without_paths", lambda m: R.without_paths(m.nodes, R.classify(*_trees(m)).where("state in ('changed', 'deleted')"), {"has_test_coverage": False}).select("file_path", "has_test_coverage"), f"{_STATE} SELECT file_path, FALSE AS has_test_coverage FROM nodes WHERE file_path NOT IN (SELECT file_path FROM s WHERE state IN ('changed', 'deleted'))", "nodes")
query("S13_partial_clear", lambda m: R.without_paths(m.churn, m.nodes.where("file_id % 4 = 0")).select("file_path", "commit_count"), "SELECT file_path, commit_count FROM churn WHERE file_path NOT IN (SELECT file_path FROM nodes WHERE file_id % 4 = 0)", "churn", "nodes")
query("R5_carry_forward", lambda m: R.carry_forward(m.edges.select("from_path", "to_path"), m.edges.where("from_path like 'tests%'").select("from_path", "to_path"), _unchanged(m), "from_path"), f"{_STATE} SELECT from_path, to_path FROM edges WHERE from_path IN (SELECT file_path FROM s WHERE state = 'unchanged') UNION ALL SELECT from_path, to_path FROM edges WHERE from_path LIKE 'tests%'", "nodes", "edges")
query("R6_add_churn", lambda m: R.add_churn(m.churn.where("commit_count % 2 = 0"), m.churn.where("commit_count % 3 = 0")), ", a AS (SELECT * FROM churn WHERE commit_count % 2 = 0), b AS (SELECT * FROM churn WHERE commit_count % 3 = 0) SELECT file_path, coalesce(a.commit_count, 0) + coalesce(b.commit_count, 0) AS commit_count, (coalesce(a.lines_changed, 0) + coalesce(b.lines_changed, 0))::BIGINT AS lines_changed, coalesce(a.unique_authors, 0) AS unique_authors, greatest(a.last_modified, b.last_modified) AS last_modified FROM a FULL JOIN b USING (file_path)", "churn")
query("R7_add_rollup", lambda m: R.add_rollup(A.usage_rollup(m.usage.where("event_id % 2 = 0")), A.usage_rollup(m.usage.where("event_id % 2 = 1"))), "SELECT user_id, created_at::DATE AS usage_date, sum(prompt_tokens + completion_tokens)::BIGINT AS total_tokens, count(*) AS requests FROM usage GROUP BY 1, 2", "usage")
query("R8_patched", lambda m: R.patched(m.table("nation"), n_name="renamed", n_regionkey=None).select("n_nationkey", "n_name", "n_regionkey"), "SELECT n_nationkey, 'renamed' AS n_name, n_regionkey FROM nation")
query("R9_forked", lambda m: R.forked(m.table("nation"), "n_regionkey", 2, " (copy)", "n_name", owner="me"), "SELECT n_nationkey, n_name || ' (copy)' AS n_name, n_regionkey, 'me' AS owner FROM nation WHERE n_regionkey = 2")
query("R10_stale_reviews", lambda m: m.table("orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "O", "stale").otherwise("ready").alias("status")), "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN 'stale' ELSE 'ready' END AS status FROM orders")
query("R11_unexpired", lambda m: R.unexpired(m.notifications, "read_at", "2024-01-31", 7).select("id"), "SELECT id FROM notifications WHERE coalesce(read_at >= TIMESTAMP '2024-01-24', TRUE)", "notifications")
query("R12_stored_content", lambda m: R.stored_content(m.texts, "content", 1000).select("id", "size_bytes", F.length("content").alias("kept")), "SELECT id, strlen(content) AS size_bytes, least(length(content), 1000) AS kept FROM texts", "texts")
query("R13_first_dependency", lambda m: R.first_dependency(m.dependencies).select("id", "is_transitive"), "SELECT min(id) AS id, arg_min(is_transitive, id) AS is_transitive FROM dependencies GROUP BY manifest_path, ecosystem, package_name, pkg_version", "dependencies")
query("R14_bound_late", lambda m: R.bound_late(m.table("customer").select(F.concat(F.lit("Supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("user_name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") * 100).alias("user_id")), m.table("supplier").select(F.col("s_name").alias("user_name"), F.col("s_suppkey").alias("user_id"))).select("user_name", "user_id"), "SELECT 'Supplier#' || lpad(c_custkey::VARCHAR, 9, '0') AS user_name, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 100 ELSE s_suppkey END AS user_id FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
query("R15_stamped_once", lambda m: R.stamped_once(m.notifications, "read_at", F.col("user_id") % 2 == 0, "2024-02-01").select("id", "read_at"), "SELECT id, CASE WHEN user_id % 2 = 0 THEN coalesce(read_at, TIMESTAMP '2024-02-01') ELSE read_at END AS read_at FROM notifications", "notifications")
_N = ", n AS (SELECT user_id, type, epoch(date_trunc('second', created_at))::BIGINT AS t, row_number() OVER (PARTITION BY user_id, type ORDER BY created_at) AS k FROM notifications), f(user_id, type, k, last) AS (SELECT user_id, type, k, t FROM n WHERE k = 1 UNION ALL SELECT n.user_id, n.type, n.k, CASE WHEN n.t - f.last >= 5 * 86400 THEN n.t ELSE f.last END FROM f JOIN n ON n.user_id = f.user_id AND n.type = f.type AND n.k = f.k + 1)"
query("ST3_emitted_once", lambda m: R.emitted_once(m.notifications, ["user_id", "type"], "created_at", 5), f"{_N} SELECT DISTINCT user_id, type, last AS emitted FROM f", "notifications", recursive=True)
