"""All queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from causeway.plans.bindings import graphs, packages, relations, risk, scalars

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (risk, scalars, graphs, relations, packages)


def queries() -> dict[str, Query]:
    return {k: f for m in MODULES for k, (f, _) in m.BINDINGS.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in MODULES for k, (_, sql) in m.BINDINGS.items() if sql}
