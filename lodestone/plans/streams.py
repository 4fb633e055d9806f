"""Streaming operators over their batch sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators.windows import within_budget
from lodestone.plans.model import path_of, path_sql
from lodestone.plans.registry import query
from lodestone.storage import fresh_path
from lodestone.streaming import keyed as K
from lodestone.streaming import reindex as X
from lodestone.streaming import usage as U

query("ST1_rate_limits", lambda m: U.rate_limits(m.usage, "1 hour", 2), "SELECT date_trunc('hour', created_at) AS window_start, user_id, count(*) AS requests, count(*) > 2 AS limited FROM usage GROUP BY 1, 2", "usage")
query("ST2_daily_rollup", lambda m: U.daily_rollup(m.usage), "SELECT user_id, created_at::DATE AS usage_date, sum(prompt_tokens + completion_tokens)::BIGINT AS total_tokens, count(*) AS requests FROM usage GROUP BY 1, 2", "usage")
query("ST4_digest", lambda m: U.digest(m.notifications, "2024-01-20 14:00:00", 9, F.when(F.col("user_id") % 2 == 0, "America/New_York").otherwise("UTC")), "SELECT user_id, count(*) AS n_unread FROM notifications WHERE user_id % 2 = 0 AND read_at IS NULL AND created_at >= TIMESTAMP '2024-01-19 14:00:00' AND created_at < TIMESTAMP '2024-01-20 14:00:00' GROUP BY 1", "notifications")
query("ST6_folded", lambda m: U.folded(m.table("conversations"), ["conv_id", "role"], "turn", "text").select("conv_id", "role", F.sha2("text", 256).alias("h")), "SELECT conv_id, role, sha256(string_agg(text, '' ORDER BY turn)) AS h FROM conversations GROUP BY 1, 2")
query("ST7_escalated", lambda m: U.escalated(m.notifications, "error", 15), "SELECT user_id, count(*) AS n FROM notifications WHERE type = 'error' GROUP BY 1 HAVING count(*) >= 15", "notifications")
query("ST8_token_cap", lambda m: within_budget(m.usage, ["user_id"], ["created_at", "event_id"], F.col("prompt_tokens"), 5000, first_always=False).groupBy("user_id").agg(F.count("*").alias("n")), ", s AS (SELECT user_id, sum(prompt_tokens) OVER (PARTITION BY user_id ORDER BY created_at, event_id) AS s FROM usage) SELECT user_id, count(*) AS n FROM s WHERE s <= 5000 GROUP BY 1", "usage")


def _stream(m, slices, batches: int = 3):
    """A stream of the slices, written one after another, in about so many batches."""
    folder = fresh_path(m.spark, "stream-in")
    for df in slices:
        df.write.mode("append").parquet(folder)
    stored = m.spark.read.parquet(folder)
    return m.spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", max(1, -(-len(stored.inputFiles()) // batches))).parquet(folder)


def _run(m, build, events, time: str):
    """What a stateful stream puts out for all events. A last row, of no key, moves the watermark past them; it may be as
    late as all of them, since files of one slice come in any order."""
    last = events.limit(0).select(time).sparkSession.range(1).select(*[F.lit("2200-01-01").cast("timestamp").alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields])
    out = fresh_path(m.spark, "stream-out")
    frame = build(_stream(m, [events, last]))
    frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(m.spark, "stream-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return m.spark.read.schema(frame.schema).parquet(out)


_LATE = "36500 days"
query(
    "ST7_escalation_stream",
    lambda m: _run(m, lambda s: K.escalations(s, "user_id", "created_at", "id", F.col("type") == "error", 15, _LATE), m.notifications.select("user_id", "created_at", "id", "type"), "created_at"),
    ", e AS (SELECT user_id AS key, date_trunc('milliseconds', created_at) AS escalated_at, id FROM notifications WHERE type = 'error') SELECT key, escalated_at FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY escalated_at, id) = 15",
    "notifications",
)
_MINUTES = ", e AS (SELECT user_id AS key, event_id AS id, epoch_ms(created_at) AS t FROM usage), l AS (SELECT *, row_number() OVER (PARTITION BY key, t // 60000 ORDER BY t, id) > 1 AS late FROM e), h AS (SELECT *, row_number() OVER (PARTITION BY key, t // 3600000, late ORDER BY t, id) > 2 AS much FROM l) SELECT key, id, CASE WHEN late THEN 'minute' WHEN much THEN 'hour' END AS refused_by FROM h"
query("ST1_admissions", lambda m: K.admissions(m.usage, "user_id", "created_at", "event_id", 1, 2), _MINUTES, "usage")
query("ST1_admission_stream", lambda m: _run(m, lambda s: K.admissions(s, "user_id", "created_at", "event_id", 1, 2, _LATE), m.usage.select("user_id", "created_at", "event_id"), "created_at"), _MINUTES, "usage")
query(
    "ST8_turn_stream",
    lambda m: _run(m, lambda s: K.capped_turns(s, "user_id", "created_at", "event_id", "prompt_tokens", 2500, 15, _LATE), m.usage.select("user_id", "created_at", "event_id", "prompt_tokens"), "created_at"),
    ", e AS (SELECT user_id AS key, event_id AS id, prompt_tokens AS x, row_number() OVER w AS n, sum(prompt_tokens) OVER w AS total FROM usage WINDOW w AS (PARTITION BY user_id ORDER BY epoch_ms(created_at), event_id)) SELECT key, id, total::BIGINT AS total FROM e WHERE n <= 15 AND total - x < 2500",
    "usage",
)


def _changes(m):
    """Files that change, stay, go and come, by the remainder of their id; each in one of three slices."""
    k, kind = F.col("file_id"), F.col("file_id") % 17
    targets = F.array(path_of((k * 7 + 3) % m.n_files), path_of(k % 5))
    rows = m.nodes.where(kind.isin(1, 2, 3, 4)).select(
        "file_id", k.cast("long").alias("seq"), "file_path", F.when(kind == 1, F.sha2(F.concat("content_hash", F.lit("x")), 256)).when(kind != 3, F.col("content_hash")).alias("content_hash"),
        (F.col("line_count") + 1).cast("int").alias("line_count"), targets.alias("targets"), (k % 5).cast("long").alias("commits"), (k % 11).cast("long").alias("lines"), F.timestamp_seconds(F.lit(1704067200) + k).alias("ts"),
    )
    return [rows.where(k % 3 == i).drop("file_id") for i in range(3)]


def _first_state(m):
    proposals = m.issues.select((F.col("id") * 10).alias("proposal_id"), F.col("id").alias("issue_id"), F.when(F.col("id") % 3 == 0, "pending").otherwise("applied").alias("status"))
    return {
        "nodes": m.nodes.where("file_id % 17 <> 4").select("file_path", "content_hash", F.col("line_count").cast("int").alias("line_count")),
        "edges": m.edges.select("from_path", "to_path"),
        "issues": m.issues.select("id", "type", "file_paths"),
        "proposals": proposals,
        "churn": m.churn.select("file_path", "commit_count", "lines_changed", "unique_authors", "last_modified"),
    }


def _reindex(m):
    """All tables of the state after a stream of changes: (name, key, value)."""
    snapshots = X.Snapshots(m.spark, fresh_path(m.spark, "snapshots"))
    snapshots.commit(-1, _first_state(m))
    X.reindexed(_stream(m, _changes(m)), snapshots, fresh_path(m.spark, "stream-checkpoint")).awaitTermination()
    t = snapshots.last()[1]
    rows = lambda name, key, value: t[name].select(F.lit(name).alias("name"), F.col(key).cast("string").alias("key"), value.alias("value"))
    joined = lambda *cols: F.concat_ws(":", *cols)
    out = rows("nodes", "file_path", joined("content_hash", "line_count")).union(rows("edges", "from_path", F.col("to_path"))).union(rows("issues", "id", F.col("type")))
    return out.union(rows("proposals", "proposal_id", F.col("status"))).union(rows("churn", "file_path", joined("commit_count", "lines_changed", F.unix_seconds("last_modified"))))


query(
    "ST5_change_stream",
    _reindex,
    f""", broken AS (SELECT file_path FROM nodes WHERE file_id % 17 IN (1, 3)),
    fresh AS (SELECT file_id, file_path, CASE file_id % 17 WHEN 1 THEN sha256(content_hash || 'x') ELSE content_hash END AS h, line_count + 1 AS n FROM nodes WHERE file_id % 17 IN (1, 4)),
    gone AS (SELECT id FROM issues WHERE list_has_any(file_paths, (SELECT list(file_path) FROM broken))),
    d AS (SELECT file_path, file_id % 5 AS c, file_id % 11 AS l, 1704067200 + file_id AS t FROM nodes WHERE file_id % 17 IN (1, 2, 3, 4))
    SELECT 'nodes' AS name, file_path AS key, content_hash || ':' || line_count AS value FROM nodes WHERE file_id % 17 NOT IN (1, 3, 4) UNION ALL SELECT 'nodes', file_path, h || ':' || n FROM fresh
    UNION ALL SELECT 'edges', from_path, to_path FROM edges WHERE from_path NOT IN (FROM broken)
    UNION ALL SELECT 'edges', file_path, to_path FROM (SELECT DISTINCT file_path, unnest([{path_sql('((file_id * 7 + 3) % (SELECT count(*) FROM part))')}, {path_sql('(file_id % 5)')}]) AS to_path FROM fresh)
    UNION ALL SELECT 'issues', id::VARCHAR, type FROM issues WHERE id NOT IN (FROM gone)
    UNION ALL SELECT 'proposals', (id * 10)::VARCHAR, CASE WHEN id % 3 <> 0 THEN 'applied' WHEN id IN (FROM gone) THEN 'stale' ELSE 'pending' END FROM issues
    UNION ALL SELECT 'churn', file_path, (coalesce(commit_count, 0) + coalesce(c, 0)) || ':' || (coalesce(lines_changed, 0) + coalesce(l, 0)) || ':' || greatest(epoch(last_modified)::BIGINT, t) FROM churn FULL JOIN d USING (file_path)""",
    "nodes", "edges", "issues", "churn",
)
