"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame`` and,
where the query is expressible in SQL, the equivalent DuckDB oracle text."""

from __future__ import annotations

from probitas.stages import owned

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, oracle: str | None = None):
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = owned(fn)
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return fn
    return wrap


def load_all() -> None:
    """Import every query module (registration happens at import)."""
    from probitas.plans import (core_queries, graph_queries, io_queries, rollup_queries,  # noqa: F401
                                sample_queries, text_queries)
