"""Registered queries: a Spark callable and, where SQL can say it, a check."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passledger.plans.standins import CHECK_VIEWS, Tables
from passledger.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


def expand(sql: str) -> str:
    """Replace ``@view`` by its definition as a common table expression."""
    return re.sub(
        r"@(\w+)", lambda m: f"{m.group(1)} AS ({CHECK_VIEWS[m.group(1)]})", sql
    ).strip()


def query(name: str, operators: str, check: str | None = None):
    """Register ``fn(tables) -> DataFrame`` for the listed operator ids."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(configure(spark), folder))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        OPERATORS[name] = operators
        if check is not None:
            CHECKS[name] = expand(check)
        return fn

    return register
