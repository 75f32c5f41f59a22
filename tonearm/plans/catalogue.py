"""All registered queries of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tonearm.plans import clustering, commands, entities, graphs, providers, reading, scalars, states, stores, views  # noqa: F401
from tonearm.plans.registry import QUERIES, SQL
from tonearm.tables import Tables


def _bound(f: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bound(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
