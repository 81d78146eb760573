"""Registry of named queries: a Spark callable and, where the query is
SQL-expressible, the DuckDB text of the same query for the oracle check.

Every query reads the driver tables of ``sf_dir`` through the retail
binding, over whole tables.  Oracle texts start from the same binding
(``RETAIL_CTES``) and are written in the literal, row-by-row form of the
reference semantics, so they also check the rewrites the Spark plans use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise KeyError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from cartwise.plans import (queries_core, queries_flow, queries_ml,  # noqa: F401
                                queries_relational, queries_sources)
