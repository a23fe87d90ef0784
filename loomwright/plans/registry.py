"""All queries of the engine's own operators, by name."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import aggregations, build, filters, functions, graphs, joins, mutations, ranking, rules, search, sources, streams, text, training  # noqa: F401
from .views import ORACLES, QUERIES, Views


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: functools.partial(_run, f) for k, f in QUERIES.items()}


def _run(f, spark: SparkSession, sf_dir: str) -> DataFrame:
    return f(Views(spark, sf_dir))


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
