"""Where queries register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Queries over rows that are written down here, for functions whose values no table holds: tests run them, they are not
#: registered with the driver.
INLINE: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
INLINE_ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None, queries: dict = QUERIES, oracles: dict = ORACLES):
    """Register a query under its function's name, with its oracle if SQL can say it."""

    def add(f):
        queries[name or f.__name__] = f
        if sql:
            oracles[name or f.__name__] = sql
        return f

    return add


def inline(sql: str, name: str | None = None):
    """The same for a query over rows written down here."""
    return query(sql, name, INLINE, INLINE_ORACLES)


def values_sql(rows: list[tuple], columns: str) -> str:
    """Literal rows as an SQL table."""

    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS t({columns})"
