"""End-to-end builds: alignment, registry and their invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import registry as ops
from .joins import vectors
from .views import Views, query

_STAR = {"floor": 0.31, "string_floor": 0.2, "sure": 0.99, "sure_string": 0.2}


def _entities(v: Views) -> DataFrame:
    sizes = v.part.select(F.col("p_partkey").alias("pk"), F.col("p_size").cast("long").alias("cnt"))
    e = vectors(v)
    return e.join(sizes, F.col("id") == F.col("pk")).select(F.col("id").alias("key"), "book_id", "id", "name", "category", "cnt", "vector")


def _built(v: Views) -> ops.Alignment:
    return ops.build_alignment(_entities(v), 0.30, 0.25, 0.05, _STAR)


@query("b01_alignment")
def b01(v: Views) -> DataFrame:
    return _built(v).clusters


@query("b02_registry")
def b02(v: Views) -> DataFrame:
    return ops.build_registry(_built(v), _entities(v))


@query(
    "b03_build_invariants",
    "SELECT unnest(['duplicate cluster ids', 'duplicate stable keys', 'clusters without members', 'members without a cluster', 'members in two clusters', 'clusters of one book', 'edges to strangers', 'edges to oneself']) AS \"check\", CAST(0 AS BIGINT) AS bad",
)
def b03(v: Views) -> DataFrame:
    return ops.check_alignment(_built(v))


@query("b04_deduplicated_books")
def b04(v: Views) -> DataFrame:
    return ops.deduplicated(_entities(v), floor=0.25, person_floor=0.2, least_string=0.0).drop("vector")
