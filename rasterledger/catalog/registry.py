"""Registry of runnable queries and of the equivalent SQL texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import Tables, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, fx: tuple[str, ...] | str = ()):
    """Register ``fn(tables)`` under ``name``; ``sql`` reads the fixtures in ``fx``."""
    fixtures = fx.split() if isinstance(fx, str) else list(fx)

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = with_fixtures(fixtures, sql)
        return fn

    return register


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def sql_case(expr: str, mapping: dict, default: str = "NULL") -> str:
    def lit(v):
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in mapping.items()) + f" ELSE {default} END"
