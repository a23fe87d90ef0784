"""Ranking, numbering and paging. Every order ends in a tie-breaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import cut_lineage


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def suffixed(df: DataFrame, key: str, order: list[Column], name: str, join: str = "-") -> DataFrame:
    """The n-th row of a key, n from 2, gets the key with -n."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__n", n).withColumn(name, F.when(F.col("__n") > 1, F.concat(key, F.lit(join), F.col("__n").cast("string"))).otherwise(F.col(key))).drop("__n")


def collision_suffix(df: DataFrame, base: str, id: str, name: str) -> DataFrame:
    """Every row of a base that several rows have gets its id behind it."""
    n = F.count("*").over(Window.partitionBy(base))
    return df.withColumn(name, F.when(n > 1, F.concat(base, F.lit("-"), F.col(id).cast("string"))).otherwise(F.col(base)))


def global_rank(df: DataFrame, order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """A dense number from 1 in a global order: range partitions are sorted and counted, and only the counts, one row a
    partition, are added up. `order` must not have ties."""
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    # both uses below must see the same partitions, also after a lost executor
    placed = cut_lineage(spread.select("*", F.monotonically_increasing_id().alias("__m")))
    placed = placed.withColumn("__p", F.shiftright("__m", 33)).withColumn("__i", F.col("__m") - F.shiftleft("__p", 33))
    counts = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)))
    joined = placed.join(F.broadcast(before.drop("__n")), "__p")
    return joined.withColumn(name, F.coalesce("__before", F.lit(0)) + F.col("__i") + 1).drop("__p", "__i", "__m", "__before")


def allocate_slugs(df: DataFrame, base: str, category: str, hint: str, order: list[str], name: str = "slug") -> DataFrame:
    """Slugs in order of arrival: base; else base-category if no other row took it; else base-hint; else base-N.

    The rows of one base are numbered among themselves, in Spark; slugs that still collide across bases, because a
    suffixed one equals another base, get a further number.
    """
    w = Window.partitionBy(base).orderBy(*order)
    numbered = df.withColumn("__n", F.row_number().over(w))
    first_category = F.first(category).over(w)
    by_category, by_hint = F.concat_ws("-", base, category), F.concat_ws("-", base, hint)
    wants_category = (F.col("__n") > 1) & (F.col(category) != first_category)
    k = numbered.withColumn("__c", wants_category).withColumn("__nc", F.when(F.col("__c"), F.row_number().over(Window.partitionBy(base, category, "__c").orderBy(*order))))
    k = k.withColumn("__level", F.when(F.col("__n") == 1, 0).when(F.col("__nc") == 1, 1).otherwise(2))
    k = k.withColumn("__nh", F.when(F.col("__level") == 2, F.row_number().over(Window.partitionBy(base, hint, "__level").orderBy(*order))))
    k = k.withColumn("__level", F.when((F.col("__level") == 2) & (F.col("__nh") > 1), 3).otherwise(F.col("__level")))
    number = F.row_number().over(Window.partitionBy(base, "__level").orderBy(*order)) + 1
    slug = F.when(F.col("__level") == 0, F.col(base)).when(F.col("__level") == 1, by_category).when(F.col("__level") == 2, by_hint).otherwise(F.concat_ws("-", base, number.cast("string")))
    out = k.withColumn("__slug", slug).drop("__n", "__c", "__nc", "__nh", "__level")
    again = F.row_number().over(Window.partitionBy("__slug").orderBy(*order))
    return out.withColumn("__again", again).withColumn(name, F.when(F.col("__again") > 1, F.concat(F.col("__slug"), F.lit("-x"), F.col("__again").cast("string"))).otherwise(F.col("__slug"))).drop("__slug", "__again")


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 40, most: int = 100) -> DataFrame:
    """One page of an order, its size clamped to 1..most."""
    size = max(1, min(size, most))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    """total and total_pages, at least 1."""
    return df.agg(F.count("*").alias("total")).select("total", F.greatest(F.ceil(F.col("total") / size), F.lit(1)).cast("long").alias("total_pages"))


def first_k(df: DataFrame, by: list[str], order: list[Column], value: Column, k: int, name: str) -> DataFrame:
    """A row a group with the first k values in an order. Only k rows of a group are ever gathered."""
    first = top_per_group(df.withColumn("__value", value), by, order, k, "__rank")
    listed = F.array_sort(F.collect_list(F.struct(F.col("__rank").alias("r"), F.col("__value").alias("v"))))
    return first.groupBy(*by).agg(F.transform(listed, lambda s: s["v"]).alias(name))


def diverse_sample(df: DataFrame, by: str, key: Column, size: int) -> DataFrame:
    """size rows that cover as many groups as possible: the first row of each group, then others, in the order of key."""
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(by).orderBy(key)))
    return ranked.orderBy((F.col("__rn") > 1).cast("int"), key).limit(size).drop("__rn")
