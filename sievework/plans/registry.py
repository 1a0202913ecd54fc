"""Where queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, folder), with its SQL where SQL can say it."""

    def add(f: Callable) -> Callable:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is there already")
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def lit(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"
