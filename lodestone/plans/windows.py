"""Ordered operators as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import aggregates as A
from lodestone.operators import windows as W
from lodestone.plans.registry import query

query("W1_renumber", lambda m: W.renumber(m.table("lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_partkey", "step_order"), "SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS step_order FROM lineitem")
query("W2_latest", lambda m: W.latest(m.table("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"]), "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
query("W3_latest_pending", lambda m: W.latest(m.table("orders").where("o_orderstatus = 'P'"), ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"], ["o_orderkey"]), "SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderstatus = 'P') WHERE k = 1")
query("W4_first_chunk", lambda m: W.earliest(m.chunks, ["repo_id"], ["start_line", "id"], ["id", "start_line"]), "SELECT repo_id, id, start_line FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY start_line, id) AS k FROM chunks) WHERE k = 1", "chunks")
_DAYS = "d AS (SELECT user_id, created_at::DATE AS day, sum(prompt_tokens)::DOUBLE AS v FROM usage GROUP BY 1, 2)"
query("W5_trend_delta", lambda m: W.trend_delta(m.usage.groupBy("user_id", F.to_date("created_at").alias("day")).agg(F.sum("prompt_tokens").cast("double").alias("v")), ["user_id"], "day", "v"), f", {_DAYS} SELECT user_id, arg_min(v, day) AS first_value, arg_max(v, day) AS last_value, count(*) AS n, CASE WHEN count(*) > 1 THEN round(arg_max(v, day) - arg_min(v, day), 2) END AS delta FROM d GROUP BY 1", "usage")
query("W6_budget", lambda m: W.within_budget(m.texts, ["repo_id"], ["id"], F.col("n_chars"), 12000).select("repo_id", "id"), ", x AS (SELECT repo_id, id, sum(n_chars) OVER (PARTITION BY repo_id ORDER BY id) AS s, row_number() OVER (PARTITION BY repo_id ORDER BY id) AS k FROM texts) SELECT repo_id, id FROM x WHERE s <= 12000 OR k = 1", "texts")
query("W7_budget_offset", lambda m: W.within_budget(m.texts, ["repo_id"], ["id"], F.col("n_chars"), 24000, offset=3000, first_always=False).select("repo_id", "id"), ", x AS (SELECT repo_id, id, 3000 + sum(n_chars) OVER (PARTITION BY repo_id ORDER BY id) AS s FROM texts) SELECT repo_id, id FROM x WHERE s <= 24000", "texts")


def _gaps(m):
    spans = m.table("lineitem").select(F.col("l_orderkey").alias("file"), (F.col("l_partkey") % 60 + 1).alias("start_line"), (F.col("l_partkey") % 60 + 1 + F.col("l_suppkey") % 9).alias("end_line"))
    return W.uncovered_runs(spans, spans.select("file").distinct().withColumn("n_lines", F.lit(80).cast("long")), "file")


query(
    "W9_uncovered_runs",
    _gaps,
    "WITH s AS (SELECT l_orderkey AS file, l_partkey % 60 + 1 AS a, l_partkey % 60 + 1 + l_suppkey % 9 AS b FROM lineitem), c AS (SELECT DISTINCT file, unnest(generate_series(a, b)) AS line FROM s), l AS (SELECT f.file, line FROM (SELECT DISTINCT file FROM s) f, (SELECT unnest(generate_series(1, 80)) AS line) EXCEPT SELECT * FROM c), g AS (SELECT file, line, line - row_number() OVER (PARTITION BY file ORDER BY line) AS island FROM l) SELECT file, min(line) AS start, max(line) AS \"end\" FROM g GROUP BY file, island",
)
query(
    "W10_fold_messages",
    lambda m: W.fold_messages(m.table("conversations").withColumn("role", F.when(F.col("turn") % 3 > 0, "assistant").otherwise("user")), "conv_id", "turn", "role", "text", "assistant"),
    "WITH c AS (SELECT *, CASE WHEN turn % 3 > 0 THEN 'assistant' ELSE 'user' END AS r FROM conversations), s AS (SELECT *, CASE WHEN r = 'assistant' AND lag(r) OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant' THEN 0 ELSE 1 END AS s FROM c), x AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM s) SELECT conv_id, run::BIGINT AS run, min(r) AS role, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n FROM x GROUP BY 1, 2",
)
query("W11_keyset_page", lambda m: W.keyset_page(m.notifications.select("id", "created_at"), "created_at", "id", F.lit("2024-01-20").cast("timestamp"), 25), "SELECT id, created_at, TRUE AS has_more FROM notifications WHERE created_at < TIMESTAMP '2024-01-20' ORDER BY created_at DESC, id DESC LIMIT 25", "notifications")
query("W12_offset_page", lambda m: W.offset_page(m.table("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 40, 20), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")

# --- rankings
query("O2_audit_targets", lambda m: W.top_k(m.degrees.select("file_path", (F.coalesce("incoming_count", F.lit(0)) + F.coalesce("complexity_score", F.lit(0))).alias("score")), [F.desc("score"), "file_path"], 20), "SELECT file_path, coalesce(incoming_count, 0) + coalesce(complexity_score, 0) AS score FROM degrees ORDER BY 2 DESC, 1 LIMIT 20", "degrees")
_SECURITY = ["secret", "missing_auth", "insecure_pattern"]
query(
    "O3_audit_ranking",
    lambda m: W.audit_ranking(m.degrees, A.security_weight(m.issues, _SECURITY), m.nodes.where("file_id % 50 = 1")),
    ", w AS (SELECT p AS file_path, sum(CASE severity WHEN 'critical' THEN 20 WHEN 'high' THEN 10 WHEN 'medium' THEN 5 ELSE 2 END) AS weight FROM (SELECT unnest(file_paths) AS p, severity FROM issues WHERE type IN ('secret', 'missing_auth', 'insecure_pattern')) GROUP BY 1) SELECT file_path, (incoming_count + coalesce(complexity_score, 0) + CASE WHEN weight > 0 THEN 1000 + weight ELSE 0 END + CASE WHEN file_id % 50 = 1 THEN 500 ELSE 0 END)::BIGINT AS score FROM degrees LEFT JOIN w USING (file_path) ORDER BY 2 DESC, 1 LIMIT 20",
    "degrees", "issues",
)
query("O4_hubs", lambda m: W.top_k(m.degrees.select("file_path", "incoming_count"), [F.desc("incoming_count"), "file_path"], 10), "SELECT file_path, incoming_count FROM degrees ORDER BY 2 DESC, 1 LIMIT 10", "degrees")
query("O4_sinks", lambda m: W.top_k(m.degrees.select("file_path", "outgoing_count"), [F.desc("outgoing_count"), "file_path"], 10), "SELECT file_path, outgoing_count FROM degrees ORDER BY 2 DESC, 1 LIMIT 10", "degrees")
query(
    "O5_hotspots",
    lambda m: W.hotspots(m.churn, m.nodes),
    ", j AS (SELECT file_path, commit_count, coalesce(complexity_score, 0) AS cx FROM churn LEFT JOIN nodes USING (file_path)), s AS (SELECT file_path, commit_count, cx, (commit_count / greatest(1, max(commit_count) OVER ())) * (cx / greatest(1, max(cx) OVER ())) AS score FROM j) SELECT *, CASE WHEN score > 0.5 THEN 'high' ELSE 'medium' END AS severity FROM s WHERE score > 0 ORDER BY score DESC, file_path LIMIT 10",
    "churn", "nodes",
)
query("O6_top_risk", lambda m: W.top_k(m.issues.select("id", "risk_score"), [F.desc_nulls_last("risk_score"), "id"], 50), "SELECT id, risk_score FROM issues ORDER BY risk_score DESC NULLS LAST, id LIMIT 50", "issues")
query("O7_severity_order", lambda m: W.top_k(m.issues.select("id", "severity"), [W.severity_order(), "id"], 100), "SELECT id, severity FROM issues ORDER BY list_position(['critical', 'high', 'medium', 'low'], severity), id LIMIT 100", "issues")
query("O8_truncated", lambda m: W.truncated(m.issues.select("id"), ["id"], 50), "SELECT id, (SELECT count(*) FROM issues) AS total, TRUE AS truncated FROM issues ORDER BY id LIMIT 50", "issues")
query("O9_largest_files", lambda m: W.top_k_by(m.table("lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), ["l_returnflag"], [F.desc("l_quantity"), "l_orderkey", "l_linenumber", "l_partkey"], 50), "SELECT * FROM (SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey) AS place FROM lineitem) WHERE place <= 50")
query("O10_keyword_rerank", lambda m: W.keyword_rerank(m.texts.select("id", "content", "n_chars"), "content", "idiot|moron|licen[cs]e", "n_chars", "id", 40).select("id", "hits"), "SELECT id, len(regexp_extract_all(lower(content), 'idiot|moron|licen[cs]e')) AS hits FROM texts ORDER BY 2 DESC, n_chars, id LIMIT 40", "texts")
query("O11_blocking_first", lambda m: W.top_k(m.table("orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("blocking")), [F.desc("blocking"), F.desc("o_orderkey")], 30), "SELECT o_orderkey, o_orderstatus = 'F' AS blocking FROM orders ORDER BY 2 DESC, 1 DESC LIMIT 30")
query("O12_complexity_deltas", lambda m: W.top_k(m.nodes.select("file_path", (F.coalesce("complexity_score", F.lit(0)) - F.col("line_count") % 40).alias("delta")), [F.desc(F.abs("delta")), "file_path"], 25), "SELECT file_path, coalesce(complexity_score, 0) - line_count % 40 AS delta FROM nodes ORDER BY abs(delta) DESC, 1 LIMIT 25", "nodes")
query("O13_default_first", lambda m: W.renumber(m.table("nation").select("n_name"), [], [F.col("n_name") != "NATION_7", "n_name"], "place"), "SELECT n_name, row_number() OVER (ORDER BY n_name <> 'NATION_7', n_name) AS place FROM nation")
query("O14_dependency_order", lambda m: W.top_k(m.dependencies.select("id", F.size("vulns").cast("long").alias("vuln_count"), "package_name"), [F.desc("vuln_count"), "package_name", "id"], 60), "SELECT id, len(vulns) AS vuln_count, package_name FROM dependencies ORDER BY 2 DESC, 3, 1 LIMIT 60", "dependencies")
query("O15_dynamic_sort", lambda m: W.top_k(m.degrees.select("file_path", "line_count"), [F.asc("line_count"), "file_path"], 45), "SELECT file_path, line_count FROM nodes ORDER BY 2, 1 LIMIT 45", "nodes")
query("O16_dashboard_sort", lambda m: W.top_k(m.notifications.select("id", F.coalesce("read_at", "created_at").alias("at")), [F.desc("at"), "id"], 30), "SELECT id, coalesce(read_at, created_at) AS at FROM notifications ORDER BY 2 DESC, 1 LIMIT 30", "notifications")
