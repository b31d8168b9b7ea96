"""Names, Spark callables and oracle SQL of all registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.standin import SHOP_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, prefix: str = ""):
    """Register ``fn(spark, sf_dir)``; ``sql`` may use the sh_* views of the stand-in shop and ``prefix`` CTEs."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, prefix)
        return fn

    return register


def with_views(sql: str, prefix: str = "") -> str:
    """Prepend the stand-in views the statement uses."""
    text = prefix + sql
    needed: list[str] = []

    def need(body: str) -> None:
        for view, definition in SHOP_SQL.items():
            if view in body and view not in needed:
                need(definition)
                needed.append(view)

    need(text)
    ctes = [f"{v} as ({SHOP_SQL[v]})" for v in needed]
    if prefix:
        ctes.append(prefix.strip().rstrip(","))
    return ("with recursive " + ",\n".join(ctes) + "\n" if ctes else "") + sql.strip()
