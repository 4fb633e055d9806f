"""Ordered operators: renumbering, latest rows, budgets, gaps, pages, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def renumber(df: DataFrame, by: list[str], order: list, name: str = "step_order") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def latest(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The row of the greatest order of each key; an aggregate, so a hot key isn't sorted."""
    best = F.max(F.struct(*order, *[c for c in columns if c not in order]))
    return df.groupBy(*by).agg(best.alias("__best")).select(*by, *[F.col(f"__best.{c}").alias(c) for c in columns])


def earliest(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    best = F.min(F.struct(*order, *[c for c in columns if c not in order]))
    return df.groupBy(*by).agg(best.alias("__best")).select(*by, *[F.col(f"__best.{c}").alias(c) for c in columns])


def trend_delta(series: DataFrame, by: list[str], day: str, value: str) -> DataFrame:
    """First, last and their difference; the difference is null for a single row."""
    out = series.groupBy(*by).agg(F.min_by(value, day).alias("first_value"), F.max_by(value, day).alias("last_value"), F.count("*").alias("n"))
    return out.withColumn("delta", F.when(F.col("n") > 1, F.round(F.col("last_value") - F.col("first_value"), 2)))


def within_budget(df: DataFrame, by: list[str], order: list, size: Column, budget: int, offset: int = 0, first_always: bool = True) -> DataFrame:
    """Rows while the running size fits the budget; sizes aren't negative, so nothing fits after the first overflow."""
    w = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumns({"__sum": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)) + offset, "__rn": F.row_number().over(w)})
    keep = (F.col("__sum") <= budget) | (F.col("__rn") == 1) if first_always else F.col("__sum") <= budget
    return ranked.where(keep).drop("__sum", "__rn")


def uncovered_runs(spans: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """(key, start, end): runs of lines 1 to n_lines that no span covers.

    Works on span ends, not on lines: each span's start is compared with the furthest end before it.
    """
    w = Window.partitionBy(key).orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, -1)
    own = spans.join(lines, key).withColumn("reached", F.coalesce(F.max("end_line").over(w), F.lit(0)))
    gaps = own.where(F.col("start_line") > F.col("reached") + 1).select(key, (F.col("reached") + 1).alias("start"), F.least(F.col("start_line") - 1, "n_lines").alias("end"))
    last = spans.groupBy(key).agg(F.max("end_line").alias("reached"))
    tails = lines.join(last, key, "left").withColumn("reached", F.coalesce("reached", F.lit(0))).where(F.col("reached") < F.col("n_lines")).select(key, (F.col("reached") + 1).alias("start"), F.col("n_lines").alias("end"))
    return gaps.where(F.col("start") <= F.col("end")).unionByName(tails)


def fold_messages(messages: DataFrame, by: str, order: str, role: str, text: str, merged: str) -> DataFrame:
    """Runs of one role ``merged`` become one message; other messages stay alone."""
    w = Window.partitionBy(by).orderBy(order)
    starts = F.when((F.col(role) == merged) & (F.lag(role).over(w) == merged), 0).otherwise(1)
    runs = messages.withColumn("__s", starts).withColumn("run", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return runs.groupBy(by, "run").agg(F.first(role).alias(role), F.array_join(parts, "\n").alias(text), F.count("*").alias("n"))


def keyset_page(df: DataFrame, order: str, tie: str, before, size: int) -> DataFrame:
    """The page before a cursor, newest first, with has_more on each row; one row more is read to know it."""
    own = df.where(F.col(order) < before).orderBy(F.desc(order), F.desc(tie)).limit(size + 1)
    counted = own.withColumn("__n", F.count("*").over(Window.partitionBy())).withColumn("__k", F.row_number().over(Window.orderBy(F.desc(order), F.desc(tie))))  # size + 1 rows
    return counted.where(F.col("__k") <= size).withColumn("has_more", F.col("__n") > size).drop("__n", "__k")


def offset_page(df: DataFrame, order: list, start: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(start).limit(size)


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    """A top-k without a full sort; ``order`` must end in a unique tie-break."""
    return df.orderBy(*order).limit(k)


def top_k_by(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """Top-k of each group; Spark drops rows beyond k before the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def truncated(df: DataFrame, order: list, limit: int) -> DataFrame:
    """The first rows, each with the total and whether rows were cut."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).limit(limit).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > limit)  # one row


def audit_ranking(nodes: DataFrame, weights: DataFrame, surface: DataFrame, k: int = 20) -> DataFrame:
    """Incoming + complexity, 1000 + weight for files with a security issue, 500 for attack surface; the top k."""
    own = nodes.join(weights, "file_path", "left").join(surface.select("file_path", F.lit(True).alias("exposed")).distinct(), "file_path", "left")
    score = F.coalesce("incoming_count", F.lit(0)) + F.coalesce("complexity_score", F.lit(0)) + F.when(F.col("weight") > 0, 1000 + F.col("weight")).otherwise(0) + F.when(F.col("exposed"), 500).otherwise(0)
    return own.select("file_path", score.alias("score")).orderBy(F.desc("score"), "file_path").limit(k)


def hotspots(churn: DataFrame, nodes: DataFrame, k: int | None = 10) -> DataFrame:
    """(commits / most commits) * (complexity / greatest complexity), maxima floored at 1; the top k above 0, or all."""
    j = churn.join(nodes.select("file_path", "complexity_score"), "file_path", "left").withColumn("cx", F.coalesce("complexity_score", F.lit(0)))
    top = j.agg(F.greatest(F.lit(1), F.max("commit_count")).alias("mc"), F.greatest(F.lit(1), F.max("cx")).alias("mx"))
    scored = j.crossJoin(F.broadcast(top)).withColumn("score", (F.col("commit_count") / F.col("mc")) * (F.col("cx") / F.col("mx")))  # one row
    out = scored.where("score > 0").select("file_path", "commit_count", "cx", "score", F.when(F.col("score") > 0.5, "high").otherwise("medium").alias("severity"))
    return out if k is None else out.orderBy(F.desc("score"), "file_path").limit(k)


#: Severity order of issue lists; others come last.
SEVERITY_ORDER = (("critical", 0), ("high", 1), ("medium", 2), ("low", 3))


def severity_order(column: str = "severity") -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_ORDER for x in kv]), F.col(column)), F.lit(9))


def keyword_rerank(chunks: DataFrame, text: str, pattern: str, distance: str, tie: str, k: int) -> DataFrame:
    """Most pattern hits first, then least distance."""
    return chunks.withColumn("hits", F.regexp_count(F.lower(text), F.lit(pattern))).orderBy(F.desc("hits"), distance, tie).limit(k)
