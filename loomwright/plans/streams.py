"""Incremental ingestion and windowed counts over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import ingest as ops
from .views import Views, query


@query("st01_windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st01(v: Views) -> DataFrame:
    return ops.windowed_counts(v.events, "ts", "event_type")


@query(
    "st02_resolve_batch",
    ", k AS (SELECT DISTINCT name, category FROM entity WHERE id < 500) SELECT e.name, e.category, CAST(sum(e.cnt) AS BIGINT) AS cnt, CASE WHEN any_value(k.name) IS NOT NULL THEN 'known' ELSE 'pending' END AS status FROM entity e LEFT JOIN k ON e.name = k.name AND e.category = k.category WHERE e.id >= 400 GROUP BY 1, 2",
)
def st02(v: Views) -> DataFrame:
    registry = ops.keyed(v.entity.where("id < 500"))
    return ops.resolve(v.entity.where("id >= 400"), registry).select("name", "category", "cnt", "status")
