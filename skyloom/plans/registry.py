"""All queries of the core, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyloom.plans import band_queries, catalog_queries, photoz_queries, raster_queries, relational_queries, spatial_queries

MODULES = [catalog_queries, band_queries, photoz_queries, raster_queries, relational_queries, spatial_queries]


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return catalog_queries.QUERIES["q_bin_percentile_main"](spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
