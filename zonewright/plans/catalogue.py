"""All registered queries, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import lake, matches, monitoring, names, profiles, reports, search, triage  # noqa: F401
from .register import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
