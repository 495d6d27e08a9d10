"""Names of queries, their functions and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *relations: str):
    """Registers a function (spark, sf_dir) under its name, with SQL over the named common table expressions."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (f"WITH {', '.join(relations)} " if relations else "") + sql
        return f

    return register
