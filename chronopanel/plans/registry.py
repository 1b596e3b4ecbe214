"""Registered queries, each with the DuckDB text that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from ..adapters import with_tables

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, extra: dict[str, str] | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_tables(sql, extra)
        return f

    return add
