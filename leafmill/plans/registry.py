"""All registered queries and their SQL; the llm subpackage is added where it can be imported."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.plans import documents, general, pivots, services, sheets
from leafmill.session import ship

Query = Callable[[SparkSession, str], DataFrame]
CORE = (general, documents, sheets, pivots, services)


def ready(queries: dict[str, Query]) -> dict[str, Query]:
    """The queries, each of which first sees to it that the workers have this package."""

    def one(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {name: one(f) for name, f in queries.items()}


def core_queries() -> dict[str, Query]:
    return ready({name: f for module in CORE for name, f in module.QUERIES.items()})


def core_sql() -> dict[str, str]:
    return {name: text for module in CORE for name, text in module.SQL.items()}
