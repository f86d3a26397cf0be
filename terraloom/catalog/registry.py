"""Query registration: a Spark query together with the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terraloom.catalog.views import BASE_TABLE, VIEW_SQL, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(body: str) -> str:
    """Prefix the CTEs of the views that ``body`` mentions. ``body`` is a SELECT, or CTEs and a SELECT."""
    ctes = []
    for name, sql in VIEW_SQL.items():
        if re.search(rf"\b{name}\b", body):
            base = BASE_TABLE[name]
            ctes.append(f"{name} AS ({sql.format(**{base: base})})")
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return (f"WITH {', '.join(ctes)} " if ctes else "") + body
    return "WITH RECURSIVE " + ", ".join(ctes + [body])


def query(name: str, sql: str | None = None):
    """Register ``fn(views)`` under an inventory name, with its check SQL when one exists."""

    def register(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def composed(name: str, *parts: str, sql: str = "SELECT * FROM ({0}) a"):
    """Register ``fn(views)``, checked by the SQL of other queries: ``{0}``, ``{1}`` ... in ``sql`` stand for theirs."""

    def register(fn: Callable[[Views], DataFrame]):
        query(name)(fn)
        ORACLES[name] = sql.format(*[ORACLES[p] for p in parts])
        return fn

    return register
