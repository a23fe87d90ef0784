"""Table mutations as new tables: merges, splits, removals, updates and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_into(clusters: DataFrame, mapping: DataFrame, fields: list[str]) -> DataFrame:
    """Clusters after a mapping (cluster_id, keeper): mentions add up, a keeper's empty fields are filled from the
    cluster with most mentions that has them."""
    m = mapping.select(F.col("cluster_id").alias("__c"), "keeper")
    j = clusters.join(m, F.col("cluster_id") == F.col("__c"), "left").withColumn("target", F.coalesce("keeper", "cluster_id"))
    rank = F.struct((F.col("cluster_id") != F.col("target")).cast("int"), -F.col("total_mentions"), F.col("cluster_id"))
    filled = [F.min_by(f, F.when(F.col(f).isNotNull(), rank)).alias(f) for f in fields]
    return j.groupBy(F.col("target").alias("cluster_id")).agg(F.sum("total_mentions").cast("long").alias("total_mentions"), F.count("*").alias("merged"), *filled)


def split_members(members: DataFrame, splits: DataFrame, new_id: Column) -> DataFrame:
    """Members after moving those in splits (cluster_id, entity_id) to clusters of their own; a split never empties a
    cluster."""
    s = splits.select("cluster_id", "entity_id").distinct().withColumn("__split", F.lit(True))
    j = members.join(s, ["cluster_id", "entity_id"], "left")
    left = j.groupBy("cluster_id").agg(F.count_if(F.col("__split").isNull()).alias("__left"))
    j = j.join(left, "cluster_id")
    moved = F.col("__split").isNotNull() & (F.col("__left") > 0)
    return j.withColumn("cluster_id", F.when(moved, new_id).otherwise(F.col("cluster_id"))).drop("__split", "__left")


def remove_members(members: DataFrame, gone: DataFrame, keys: list[str], least_members: int = 1, least_books: int = 1) -> DataFrame:
    """Members without those in gone, and without clusters that then are too small."""
    left = members.join(gone.select(*keys).distinct(), keys, "left_anti")
    good = left.groupBy("cluster_id").agg(F.count("*").alias("n"), F.countDistinct("book_id").alias("k"))
    return left.join(good.where((F.col("n") >= least_members) & (F.col("k") >= least_books)).select("cluster_id"), "cluster_id", "left_semi")


def update(df: DataFrame, changes: DataFrame, key: str, fields: list[str], clear: str | None = None) -> DataFrame:
    """df with fields taken from changes where they are not null there; rows whose `clear` is true lose the fields."""
    c = changes.select(F.col(key).alias("__key"), *(F.col(f).alias(f"__{f}") for f in fields), *([F.col(clear).alias("__clear")] if clear else []))
    j = df.join(c, F.col(key) == F.col("__key"), "left")
    for f in fields:
        new = F.coalesce(f"__{f}", f)
        j = j.withColumn(f, F.when(F.coalesce("__clear", F.lit(False)), None).otherwise(new) if clear else new)
    return j.select(df.columns)


def prune_variants(entities: DataFrame, valid) -> DataFrame:
    """Entities with only the variants for which valid(name, variant) holds, and how many went."""
    kept = F.filter("variants", lambda x: valid(F.col("name"), x))
    return entities.withColumn("__kept", kept).withColumn("dropped", F.size("variants") - F.size("__kept")).withColumn("variants", F.col("__kept")).drop("__kept")


def attach(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Parents with an array of their children's rows, empty where there is none."""
    rest = [c for c in children.columns if c != key]
    nested = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))
    empty = F.array().cast(nested.schema[name].dataType)
    return parents.join(nested, key, "left").withColumn(name, F.coalesce(name, empty))


def integrity(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, bad): the number of rows that break each check; each frame holds the breaking rows."""
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count("*").alias("bad")).select(F.lit(name).alias("check"), "bad")
        out = one if out is None else out.unionByName(one)
    return out


def registry_checks(clusters: DataFrame, index: DataFrame, neighbours: DataFrame) -> dict[str, DataFrame]:
    """Unique ids, the same ids in clusters and index, and neighbours that exist and are not themselves."""
    twice = lambda df: df.groupBy("cluster_id").count().where("count > 1")
    ids = lambda df: df.select("cluster_id").distinct()
    known = ids(clusters)
    return {
        "duplicate cluster ids": twice(clusters),
        "duplicate index ids": twice(index),
        "clusters not in index": ids(clusters).subtract(ids(index)),
        "index not in clusters": ids(index).subtract(ids(clusters)),
        "unknown neighbours": neighbours.join(known, neighbours["nbr"] == known["cluster_id"], "left_anti"),
        "own neighbours": neighbours.where("id = nbr"),
    }
