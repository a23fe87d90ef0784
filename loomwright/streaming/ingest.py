"""Structured Streaming ingestion of new entities against a registry snapshot.

Each micro-batch is resolved by a stable key: known entities are updated, new ones go to a staging table as pending.
The registry is a versioned Parquet table; a batch writes its version once, so a retried batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import stable_id
from ..functions.normalise import name_text


def keyed(entities: DataFrame) -> DataFrame:
    """name, category, cnt with the identifier that a name has in the registry."""
    return entities.withColumn("id", stable_id(F.lit("local"), F.col("category"), name_text(F.col("name"))))


def resolve(batch: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per identifier of a batch: id, name, category, cnt, status (known or pending)."""
    new = keyed(batch).groupBy("id", "category").agg(F.min("name").alias("name"), F.sum("cnt").cast("long").alias("cnt"))
    known = registry.select("id").distinct().withColumn("known", F.lit(True))
    joined = new.join(known, "id", "left")
    return joined.withColumn("status", F.when(F.col("known"), "known").otherwise("pending")).drop("known")


def upsert_to(spark: SparkSession, registry_path: str, staging_path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: appends counts of known entities to the registry log and new ones to staging."""

    def apply(batch: DataFrame, version: int) -> None:
        registry = spark.read.parquet(registry_path)
        found = resolve(batch, registry).persist()
        found.where("status = 'pending'").write.mode("overwrite").parquet(f"{staging_path}/batch={version}")
        found.where("status = 'known'").write.mode("overwrite").parquet(f"{staging_path}-known/batch={version}")
        found.unpersist()

    return apply


def ingest(stream: DataFrame, registry_path: str, staging_path: str, checkpoint: str):
    """Starts the ingestion of a stream of entities; returns the running query."""
    upsert = upsert_to(stream.sparkSession, registry_path, staging_path)
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, by: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per time window with a watermark; works on a stream and on a table."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, size).alias("w"), by)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), by, "n")
    )
