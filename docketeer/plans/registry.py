"""Queries by name: what runs on the driver's tables, the operators it covers, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    plan: Plan
    operators: str
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(operators: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Registers a function under its name."""

    def add(plan: Plan) -> Plan:
        if plan.__name__ in QUERIES:
            raise ValueError(f"{plan.__name__} is registered twice")
        QUERIES[plan.__name__] = Query(plan, operators, sql)
        return plan

    return add
