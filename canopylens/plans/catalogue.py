"""Registered queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from canopylens.plans import inventory_queries, name_queries, raster_queries, series_queries, spatial_queries, stream_queries
from canopylens.plans.fixtures import Inputs, expand

MODULES = (name_queries, inventory_queries, series_queries, raster_queries, spatial_queries, stream_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory_queries.registry(Inputs(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, d, build=build: build(Inputs(spark, d)) for m in MODULES for name, (build, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: expand(sql) for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
