"""Name -> (query, oracle SQL).  Query modules fill it through `register`."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


CATALOG: dict[str, Entry] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query under `name`; `sql` is the DuckDB text with the same result."""

    def add(run: Query) -> Query:
        if name in CATALOG:
            raise ValueError(f"query {name} registered twice")
        CATALOG[name] = Entry(run, sql.strip() if sql else None)
        return run

    return add
