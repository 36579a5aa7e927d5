"""Query registry: name -> (spark builder, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir)`` under ``name`` with its
    DuckDB oracle (None = rows-only check)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    # importing the binding modules fills the registry
    from promptlens.plans import (  # noqa: F401
        q_basic, q_profile, q_vectors, q_incremental, q_textsim, q_generate,
        q_refine, q_limits, q_streaming)


def attach_oracle(name: str, sql: str) -> None:
    """Give an already registered query its oracle (for SQL built after the
    query function, e.g. unrolled iterations)."""
    if name not in QUERIES:
        raise KeyError(name)
    ORACLE[name] = sql
