"""Registered queries over the driver's tables and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "describe_lineitem"


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


_ENTRIES: dict[str, Entry] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query under ``name``; ``sql`` is its DuckDB counterpart, None where SQL can't express it."""

    def add(run: Query) -> Query:
        if name in _ENTRIES:
            raise ValueError(f"query {name!r} is registered twice")
        _ENTRIES[name] = Entry(run, sql)
        return run

    return add


def _load() -> None:
    from spectrafold import plans  # noqa: F401  registers its queries on import


def queries() -> dict[str, Query]:
    _load()
    return {name: e.run for name, e in _ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: e.sql for name, e in _ENTRIES.items() if e.sql is not None}
