"""Incremental re-index of a stream of changes: versioned tables that are committed together, each batch exactly once.

A commit writes every table of the new state to a folder of its own, and then one file that names them all with the batch's
number; that file appears at once or not at all. A batch whose number is in the ledger is skipped, so a stream that
dies at any point and starts again from its checkpoint, in another process too, goes on from the last commit. What a dead
attempt has written is never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import incremental as R
from lodestone.storage import fresh_path

_LEDGER = "batch long, name string, path string"
#: What a file change carries. A null hash: the file is gone. ``targets``: paths it imports.
CHANGE = "seq long, file_path string, content_hash string, line_count int, targets array<string>, commits long, lines long, ts timestamp"


class Snapshots:
    """Tables by name as of the last commit, under one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def ledger(self) -> DataFrame:
        """(batch, name, path) of every commit."""
        try:
            return self.spark.read.schema(_LEDGER).json(f"{self.folder}/commits/*")
        except AnalysisException:  # no commit yet
            return self.spark.createDataFrame([], _LEDGER)

    def last(self) -> tuple[int | None, dict[str, DataFrame]]:
        """The number of the last committed batch and its tables; (None, {}) before the first."""
        ledger = self.ledger()
        rows = ledger.where(F.col("batch") == ledger.agg(F.max("batch")).head()[0]).collect()  # a row for each table
        return (rows[0]["batch"] if rows else None), {r["name"]: self.spark.read.parquet(r["path"]) for r in rows}

    def as_of(self, batch: int) -> dict[str, DataFrame]:
        return {r["name"]: self.spark.read.parquet(r["path"]) for r in self.ledger().where(F.col("batch") == batch).collect()}

    def commit(self, batch: int, tables: dict[str, DataFrame]) -> None:
        """Makes ``tables`` the state after ``batch``. One file by one task: it is there whole or not at all."""
        rows = []
        for name, table in tables.items():
            path = f"{self.folder}/tables/{name}/{batch}-{fresh_path(self.spark, 'v').rsplit('-', 1)[1]}"
            table.write.parquet(path)
            rows.append((batch, name, path))
        self.spark.createDataFrame(rows, _LEDGER).coalesce(1).write.json(f"{self.folder}/commits/{batch:020d}")


def exactly_once(snapshots: Snapshots, step: Callable[[dict[str, DataFrame], DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: ``step`` turns the last state and a batch into the next state."""

    def apply(batch: DataFrame, number: int) -> None:
        done, state = snapshots.last()
        if done is None or done < number:
            snapshots.commit(number, step(state, batch))

    return apply


def apply_changes(state: dict[str, DataFrame], changes: DataFrame) -> dict[str, DataFrame]:
    """The state after a batch of file changes (``CHANGE``); the last change of a file (by seq) tells what it is now.

    ``state``: nodes (file_path, content_hash, line_count), edges (from_path, to_path), issues (id, type, file_paths),
    proposals (proposal_id, issue_id, status), churn (file_path, commit_count, lines_changed, unique_authors, last_modified).
    Files are classified by their hash. Rows of changed and deleted files go and come anew, those of unchanged ones are
    carried forward; issues stay while all their files do, and pending proposals of those that go become stale. Every
    change adds to its file's churn.
    """
    now = changes.groupBy("file_path").agg(F.max_by(F.struct("content_hash", "line_count", "targets"), "seq").alias("r")).select("file_path", "r.*")
    here = now.where("content_hash is not null")
    old = state["nodes"].join(now.select("file_path"), "file_path", "left_semi")
    states = R.classify(old, here)
    broken = states.where("state in ('changed', 'deleted')").select("file_path")
    fresh = here.join(states.where("state in ('changed', 'added')").select("file_path"), "file_path", "left_semi")
    nodes = R.without_paths(state["nodes"], broken).unionByName(fresh.select("file_path", "content_hash", "line_count"))
    edges = state["edges"].join(broken.withColumnRenamed("file_path", "from_path"), "from_path", "left_anti").select("from_path", "to_path")
    edges = edges.unionByName(fresh.select(F.col("file_path").alias("from_path"), F.explode("targets").alias("to_path")).distinct())
    hit = state["issues"].select("id", F.explode("file_paths").alias("file_path")).join(broken, "file_path", "left_semi").select("id").distinct()
    issues = state["issues"].join(hit, "id", "left_anti")
    delta = changes.groupBy("file_path").agg(F.sum("commits").alias("commit_count"), F.sum("lines").alias("lines_changed"), F.max("ts").alias("last_modified"))
    return {"nodes": nodes, "edges": edges, "issues": issues, "proposals": R.mark_stale(state["proposals"], hit), "churn": R.add_churn(state["churn"], delta)}


def reindexed(stream: DataFrame, snapshots: Snapshots, checkpoint: str, step: Callable = apply_changes, trigger: dict | None = None):
    """Starts the re-index of a stream of changes on the state that ``snapshots`` holds; commit a first state as batch -1."""
    writer = stream.writeStream.foreachBatch(exactly_once(snapshots, step)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
