"""All queries of the library by name, and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import details, ingest, proxies


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return proxies.QUERIES | ingest.QUERIES | details.QUERIES


def oracle_sql() -> dict[str, str]:
    return proxies.SQL | ingest.SQL | details.SQL
