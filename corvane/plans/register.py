"""Names a module's queries and pairs them with their SQL."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    queries: dict = {}
    oracle: dict = {}

    def query(sql: str | None = None):
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql is not None:
                oracle[f.__name__] = sql
            return f

        return add

    return queries, oracle, query
