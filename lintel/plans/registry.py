"""The register of named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def values(columns: str, rows: list[tuple]) -> str:
    """A SELECT of literal rows; ``columns`` gives names and SQL types."""
    parts = [c.split() for c in columns.split(",")]
    cast = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in parts)
    names = ", ".join(n for n, _ in parts)
    if not rows:
        return "SELECT " + ", ".join(f"CAST(NULL AS {t}) AS {n}" for n, t in parts) + " WHERE FALSE"
    return f"SELECT {cast} FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) AS v({names})"
