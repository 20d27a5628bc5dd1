"""Registration of queries under their names."""

from __future__ import annotations

from collections.abc import Callable


def registrar() -> tuple[dict, dict, Callable]:
    """(queries, SQL, decorator): the decorator registers a query under its name, with the SQL that states the same."""
    queries: dict = {}
    sql: dict = {}

    def query(text: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query
