"""Named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from wordloom.plans.workspace import Workspace

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}  # as written; ``oracle_views.with_views`` puts the views in front


def query(name: str, sql: str | None = None):
    """Register ``fn(ws) -> DataFrame``; ``sql`` may use the views of ``oracle_views``."""

    def add(fn: Callable[[Workspace], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Workspace.open(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
