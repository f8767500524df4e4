"""Registry of named queries: a Spark plan builder and, where expressible,
the equivalent DuckDB SQL over the same parquet tables (the oracle)."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    # importing the plan modules fills the registry
    from folio.plans import (search_plans, relational_plans, extract_plans,  # noqa: F401
                             taxonomy_plans, suggest_plans, stats_plans, export_plans,
                             stream_plans, source_plans, processor_plans)
