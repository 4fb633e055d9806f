"""All queries over the repository model, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans.model import Model, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, build: Callable[[Model], DataFrame], sql: str | None = None, *ctes: str, recursive: bool = False) -> None:
    """Register ``build`` under ``name``; ``sql`` may start from the relations in ``ctes``."""
    QUERIES[name] = lambda spark, sf_dir: build(Model(spark, sf_dir))
    if sql is not None:
        ORACLE_SQL[name] = with_ctes(sql, *ctes, recursive=recursive) if ctes else sql


def _load() -> None:
    import importlib

    for module in ("basic", "joins", "windows", "graph", "similarity", "detection", "scans", "incremental", "text", "streams", "files"):
        importlib.import_module(f"lodestone.plans.{module}")


_load()
