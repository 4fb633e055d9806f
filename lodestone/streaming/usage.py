"""Streaming twins of the usage operators. Event times must be timestamps with a zone; update mode keeps late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate_limits(usage: DataFrame, length: str, limit: int, watermark: str = "1 hour") -> DataFrame:
    """Requests of each user in tumbling windows, and whether they pass the limit."""
    own = usage.withWatermark("created_at", watermark) if usage.isStreaming else usage
    counts = own.groupBy(F.window("created_at", length), "user_id").agg(F.count("*").alias("requests"))
    return counts.select(F.col("window.start").alias("window_start"), "user_id", "requests", (F.col("requests") > limit).alias("limited"))


def daily_rollup(usage: DataFrame, watermark: str = "2 days") -> DataFrame:
    own = usage.withWatermark("created_at", watermark) if usage.isStreaming else usage
    sums = own.groupBy(F.window("created_at", "1 day"), "user_id").agg(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), F.count("*").alias("requests"))
    return sums.select("user_id", F.to_date("window.start").alias("usage_date"), "total_tokens", "requests")


def deduplicated(events: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """At most one row of a key within the delay; in batch, one row of a key."""
    if events.isStreaming:
        return events.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def digest(notifications: DataFrame, as_of: str, hour: int, zone: Column) -> DataFrame:
    """Unread rows of the last 24 hours for users whose local hour it is."""
    now = F.lit(as_of).cast("timestamp")
    own = notifications.where((F.col("created_at") >= now - F.expr("interval 1 day")) & (F.col("created_at") < now) & F.col("read_at").isNull())
    due = F.hour(F.from_utc_timestamp(now, zone)) == hour
    return own.where(due).groupBy("user_id").agg(F.count("*").alias("n_unread"))


def folded(fragments: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Fragments joined in order."""
    return fragments.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), "").alias(text))


def escalated(events: DataFrame, kind: str, least: int = 2) -> DataFrame:
    """Users with at least so many events of a kind."""
    return events.where(F.col("type") == kind).groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def changed_files(stream: DataFrame, apply, checkpoint: str):
    """Each micro-batch of changes goes to ``apply(batch, number)``; replays bring the same number again."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
