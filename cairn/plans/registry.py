"""Registered queries: a Spark plan each, most with an equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cairn.plans.projections import Views, with_views

Plan = Callable[[Views], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    plan: Plan
    sql: str | None


REGISTERED: dict[str, Query] = {}


def query(sql: str | None = None, *views: str) -> Callable[[Plan], Plan]:
    """Register a plan under its function name; ``views`` are the projections its SQL reads."""

    def add(plan: Plan) -> Plan:
        text = None if sql is None else with_views(sql, views)
        REGISTERED[plan.__name__] = Query(plan.__name__, plan, text)
        return plan

    return add


def _load() -> None:
    from cairn.plans import (  # noqa: F401
        archive_queries,
        batch_queries,
        catalog_queries,
        inventory_queries,
        linkage_queries,
        quality_queries,
        record_queries,
        scan_queries,
    )


def runnable() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(q: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: q.plan(Views(spark, sf_dir))

    return {name: bind(q) for name, q in REGISTERED.items()}


def sql_texts() -> dict[str, str]:
    _load()
    return {name: q.sql for name, q in REGISTERED.items() if q.sql is not None}
