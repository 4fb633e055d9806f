"""Named questions about one repository, with small answers: the operators as a public interface.

Each answer is a plain dictionary with at most ``MOST`` items, and ``total`` and ``truncated`` where there are more. What can't
be answered gives ``{"is_error": True, "message": ...}``; a reader without access gets that for every question. All
work is done by the operators on the cluster; only the items of an answer reach the caller.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.operators import reachability as R
from lodestone.operators import similarity as S
from lodestone.operators import text as X

#: Most items of an answer, and most chunks of a search (fixed values).
MOST, MOST_CHUNKS = 50, 20


def _answers(f: Callable) -> Callable:
    @wraps(f)
    def call(self, *args, **kwargs) -> dict:
        try:
            if not self.allowed:
                raise LookupError("Repository not found or unauthorized")
            return f(self, *args, **kwargs)
        except (LookupError, ValueError, TypeError) as e:
            return {"is_error": True, "message": str(e.args[0]) if e.args else type(e).__name__}

    return call


def _items(df: DataFrame, most: int = MOST, column: str | None = None) -> dict:
    """Items of an ordered frame, one more than is shown being read to know whether there are more."""
    rows = df.limit(most + 1).collect()
    out: dict = {"items": [r[column] if column else r.asDict(True) for r in rows[:most]]}
    return out if len(rows) <= most else out | {"truncated": True, "total": df.count()}


class RepositoryTools:
    """``nodes`` (file_path, language, line_count, complexity_score, incoming_count, outgoing_count, node_classification,
    is_test_file), ``edges`` (from_path, to_path), ``issues`` (id, type, severity, file_paths, description, risk_score,
    created_at), ``chunks`` (id, repo_id, file_path, embedding), ``contents`` (file_path, content), ``dependencies`` (package_name,
    ecosystem, pkg_version, vulns): tables of one repository; any but those asked about may be left out."""

    def __init__(self, allowed: bool = True, **tables: DataFrame):
        self.allowed, self._tables = allowed, tables

    def _table(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise LookupError(f"No {name} are indexed")
        return self._tables[name]

    @property
    def _edges(self) -> DataFrame:
        return self._table("edges").select(F.col("from_path").alias("a"), F.col("to_path").alias("b"))

    def _one(self, path: str) -> DataFrame:
        if not path:
            raise ValueError("A path is needed")
        return self._table("edges").sparkSession.createDataFrame([(path,)], "node string")

    @_answers
    def get_graph_overview(self) -> dict:
        nodes = self._table("nodes")
        totals = R.overview(nodes.select(F.col("file_path").alias("node")), self._edges).first()
        top = lambda c: [r.asDict() for r in nodes.where(F.col(c) > 0).orderBy(F.desc(c), "file_path").limit(10).select("file_path", c).collect()]
        return {"nodeCount": totals["n_nodes"], "edgeCount": totals["n_edges"], "topHubs": top("incoming_count"), "topSinks": top("outgoing_count"), "cyclicComponentCount": totals["n_cycles"]}

    @_answers
    def list_issues(self, type: str | None = None, severity: str | None = None, file: str | None = None, sort_by: str = "risk") -> dict:
        df = self._table("issues")
        df = df if type is None else df.where(F.col("type") == type)
        df = df if severity is None else df.where(F.col("severity") == severity)
        df = df if file is None else df.where(F.array_contains("file_paths", file))
        rank = F.element_at(F.create_map(*[F.lit(x) for kv in {"critical": 4, "high": 3, "medium": 2, "low": 1}.items() for x in kv]), F.col("severity"))
        orders = {"risk": F.desc_nulls_last("risk_score"), "recent": F.desc_nulls_last("created_at"), "severity": F.desc(F.coalesce(rank, F.lit(0)))}
        if sort_by not in orders:
            raise ValueError(f"Unknown order {sort_by}")
        return _items(df.orderBy(orders[sort_by], "id"))

    @_answers
    def get_file_metrics(self, path: str) -> dict:
        row = self._table("nodes").where(F.col("file_path") == path).first()
        if row is None:
            raise LookupError(f"No metrics for {path}")
        return row.asDict(True)

    @_answers
    def get_blast_radius(self, path: str, depth: int | None = None) -> dict:
        found = G.blast_radius(self._edges, self._one(path), depth).select("node", "kind", "depth").orderBy("depth", "node")
        direct, transitive = (found.where(F.col("kind") == k) for k in ("direct", "transitive"))
        a, b = _items(direct, column="node"), _items(transitive, column="node")
        totals = [x.get("total", len(x["items"])) for x in (a, b)]
        return {"direct": a["items"], "transitive": b["items"], "truncated": max(totals) > MOST, "total_direct": totals[0], "total_transitive": totals[1]}

    @_answers
    def get_dependents(self, path: str) -> dict:
        return _items(G.neighbours(G.reverse(self._edges), path).orderBy("node"), column="node")

    @_answers
    def get_imports(self, path: str) -> dict:
        real = self._table("nodes").select(F.col("file_path").alias("node"))
        return _items(G.neighbours(G.adjacency(self._edges, real), path).orderBy("node"), column="node")

    @_answers
    def find_paths(self, from_path: str, to_path: str, max_paths: int = 10) -> dict:
        paths = G.simple_paths(self._edges, self._one(from_path), self._one(to_path), min(max_paths or 10, MOST))
        return {"paths": [r["path"] for r in paths.collect()]}

    @_answers
    def get_attack_paths(self, source: str | None = None, sink: str | None = None, max_paths: int = 20) -> dict:
        nodes, most = self._table("nodes"), min(max_paths or 20, MOST)
        ends = [nodes.where(F.col("node_classification").isin(kind, "both") & (F.lit(True) if only is None else F.col("file_path") == only)).select(F.col("file_path").alias("node")) for kind, only in (("source", source), ("sink", sink))]
        paths = [r["path"] for r in G.simple_paths(self._edges, *ends, most + 1).collect()]
        return {"paths": paths[:most], "truncated": len(paths) > most}

    @_answers
    def search_code(self, embedding: list[float], top_k: int = 8) -> dict:
        """The question comes as its embedding: models are no part of this library."""
        near = S.nearest(self._table("chunks"), embedding, min(top_k or 8, MOST_CHUNKS))
        return {"items": [r.asDict() for r in near.collect()]}

    @_answers
    def read_file(self, path: str, start_line: int | None = None, end_line: int | None = None) -> dict:
        df = self._table("contents").where(F.col("file_path") == path)
        content = F.col("content") if start_line is None and end_line is None else X.line_range(F.col("content"), max(start_line or 1, 1), end_line or 1 << 30)
        row = df.select(content.alias("content")).first()
        if row is None:
            raise LookupError(f"File not found: {path}")
        return {"path": path, "content": row["content"]}

    @_answers
    def get_vulns(self, severity: str | None = None) -> dict:
        hit = F.size("vulns") > 0 if severity is None else F.exists("vulns", lambda v: v["severity"] == severity)
        return _items(self._table("dependencies").where(hit).orderBy(F.desc(F.size("vulns")), "package_name"))
