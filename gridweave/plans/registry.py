"""Named queries over the tables of a folder, with equivalent SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridweave.plans import features, models, places, regimes, reports

MODULES = [features, regimes, places, reports, models]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.emission(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
