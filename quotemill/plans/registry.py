"""All queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quotemill.plans import collection, fares, series

MODULES = (series, fares, collection)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}


def flagship(spark: SparkSession, root: str) -> DataFrame:
    return fares.route_summary(spark, root)
