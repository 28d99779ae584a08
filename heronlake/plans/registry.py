"""All queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a callable (spark, sf_dir) -> DataFrame under ``name``, with its SQL if there is one."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is there already")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def queries() -> dict[str, Callable]:
    from heronlake.plans import catalog

    catalog.load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from heronlake.plans import catalog

    catalog.load()
    return dict(ORACLES)
