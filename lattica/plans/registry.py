"""Query names, their plans and their DuckDB SQL."""

from __future__ import annotations

_QUERIES: dict = {}
_SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register a plan (spark, sf_dir) -> DataFrame under a name, with its DuckDB SQL."""

    def add(f):
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    from . import functions, relational  # noqa: F401


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
