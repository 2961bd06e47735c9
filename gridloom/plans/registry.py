"""Queries and their oracle SQL by name; the modules of this package fill them on import."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a (spark, sf_dir) -> DataFrame function, and DuckDB SQL with the same rows."""

    def add(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


from gridloom.plans import q_aggregates, q_books, q_joins, q_model, q_quality, q_sources, q_streams, q_text, q_windows  # noqa: E402, F401
