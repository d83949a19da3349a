"""Registered queries and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL if the result can be written in SQL."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def cte(name: str, body: str, *needs: str) -> None:
    _CTES[name] = (body, needs)


def with_ctes(body: str, *needs: str) -> str:
    """SQL text with the named common table expressions and what they need, in order."""
    seen: list[str] = []

    def visit(name: str) -> None:
        if name in seen:
            return
        for need in _CTES[name][1]:
            visit(need)
        seen.append(name)

    for need in needs:
        visit(need)
    parts = [f"{n} AS MATERIALIZED ({_CTES[n][0]})" for n in seen]
    if not parts:
        return body
    if body.lstrip().startswith("WITH"):
        body = f"SELECT * FROM ({body}) AS body"
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


def u(*parts: str) -> str:
    """SQL for the md5 uniform; parts are SQL expressions."""
    return f"(('0x'||substr(md5(concat_ws('|',{','.join(parts)})),1,13))::BIGINT/4503599627370496.0)"
