"""A decorator that registers a query and its SQL."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    queries: dict = {}
    sql: dict = {}

    def query(text: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query
