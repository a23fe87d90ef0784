"""Roll-ups of entities, clusters, books and cross-references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cluster_stats(members: DataFrame, keys: list[str]) -> DataFrame:
    """Books, mentions and members of each cluster."""
    return members.groupBy(*keys).agg(
        F.countDistinct("book_id").alias("book_count"), F.sum("cnt").cast("long").alias("total_mentions"), F.count("*").alias("members")
    )


def aggregate_entities(mentions: DataFrame, order: list[str], contexts: int = 5) -> DataFrame:
    """Entities from raw mentions (name, category, subcategory, context, and the columns of order).

    The key is the trimmed lower-case name of two letters or more. The last mention gives name and categories; the
    first distinct contexts stay; variants are all spellings in order.
    """
    key = F.lower(F.trim("name"))
    last = F.max_by(F.struct("name", "category", "subcategory"), F.struct(*order))
    keyed = mentions.withColumn("key", key).where(F.length("key") >= 2)
    whole = keyed.groupBy("key").agg(last.alias("last"), F.count("*").alias("cnt"), F.array_sort(F.collect_set("name")).alias("variants"))
    # of each distinct context its first place; only the first few of a key are gathered
    places = keyed.groupBy("key", "context").agg(F.min(F.struct(*order)).alias("at"))
    few = places.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("at"))).where(F.col("rank") <= contexts)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "context"))), lambda s: s["context"])
    joined = whole.join(few.groupBy("key").agg(listed.alias("contexts")), "key")
    return joined.select(F.translate("key", " .", "__").alias("id"), "last.*", "cnt", "variants", "contexts")


def merge_entities(members: DataFrame, group: str, order: Column | None = None) -> DataFrame:
    """One entity per group (id, name, category, cnt): the one with the largest count leads, counts add up.

    With an order the largest value of it leads; ties go to the smaller id.
    """
    lead = F.max_by(F.struct("id", "name", "category"), F.struct(F.col("cnt") if order is None else order, -F.col("id")))
    merged = members.groupBy(group).agg(
        lead.alias("lead"), F.sum("cnt").cast("long").alias("cnt"), F.array_sort(F.collect_set("name")).alias("names")
    )
    rest = F.filter("names", lambda n: n != F.col("lead.name"))
    return merged.select(group, "lead.*", "cnt", F.concat(F.array("lead.name"), rest).alias("variants"))


def honorific_merge(entities: DataFrame, stripped: Column, title: Column) -> DataFrame:
    """Merges names that differ by an honorific, but none in a group that has both Mr and Mrs or Ms.

    entities: id, name, category, cnt. Columns: key, category, name (largest count), cnt, merged.
    """
    e = entities.withColumn("key", F.lower(stripped)).withColumn("title", F.lower(title))
    w = Window.partitionBy("key", "category")
    clash = (F.max((F.col("title") == "mr").cast("int")).over(w) + F.max(F.col("title").isin("mrs", "ms").cast("int")).over(w)) == 2
    e = e.withColumn("part", F.when(clash, F.col("id")).otherwise(F.lit(-1)))
    return e.groupBy("key", "category", "part").agg(
        F.max_by("name", F.struct("cnt", -F.col("id"))).alias("name"), F.sum("cnt").cast("long").alias("cnt"), F.count("*").alias("merged")
    ).drop("part")


def surname_merge(entities: DataFrame, surname: Column, min_count: int = 1) -> DataFrame:
    """Persons by surname: total, names, canonical name (largest count, then shortest) and dominant subcategory."""
    e = entities.withColumn("surname", surname).where(F.length(F.regexp_replace("surname", r"[^\p{L}]", "")) >= 3)
    sub = e.groupBy("surname", "subcategory").agg(F.sum("cnt").alias("s"))
    top = sub.groupBy("surname").agg(F.min_by("subcategory", F.struct(-F.col("s"), F.col("subcategory"))).alias("subcategory"))
    people = e.groupBy("surname").agg(
        F.sum("cnt").cast("long").alias("cnt"),
        F.min_by("name", F.struct(-F.col("cnt"), F.length("name"), F.col("name"))).alias("canonical"),
        F.array_sort(F.collect_set("name")).alias("aliases"),
    )
    return people.where(F.col("cnt") >= min_count).join(top, "surname")


def share(df: DataFrame, value: str, by: list[str] | None = None, digits: int = 4, name: str = "pct") -> DataFrame:
    """Adds a column's percentage of its sum, overall or by group.

    The overall sum is one row joined back, not a window over everything.
    """
    if by:
        total = F.sum(value).over(Window.partitionBy(*by))
        return df.withColumn(name, F.round(100 * F.col(value) / total, digits))
    total = df.agg(F.sum(value).alias("__total"))
    return df.crossJoin(F.broadcast(total)).withColumn(name, F.round(100 * F.col(value) / F.col("__total"), digits)).drop("__total")


def bucket_histogram(df: DataFrame, value: str, edges: list[float], labels: list[str]) -> DataFrame:
    """Rows per half-open bucket [edge, next edge); rows outside all buckets count in none."""
    bucket = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels, strict=False))):
        bucket = F.when((F.col(value) >= low) & (F.col(value) < high), label).otherwise(bucket)
    return df.withColumn("bucket", bucket).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def coverage(df: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """Rows and rows with each flag, by group."""
    return df.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in flags.items()))


def dedupe_best(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row per key in an order that has no ties."""
    names = [f"__k{i}" for i in range(len(keys))]
    w = Window.partitionBy(*names).orderBy(*order)
    keyed = df.select("*", *(k.alias(n) for k, n in zip(keys, names, strict=True)))
    return keyed.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", *names)


def upper_median(value: str) -> Column:
    """The element at position n // 2 of the values in falling order."""
    listed = F.sort_array(F.collect_list(value), asc=False)
    return F.element_at(listed, F.floor(F.size(listed) / 2).cast("int") + 1)


def precision_recall(df: DataFrame, truth: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1, 0 where undefined."""
    tp, fp, fn = (F.count_if(c).cast("double") for c in (truth & predicted, ~truth & predicted, truth & ~predicted))
    out = df.groupBy(*(by or [])).agg(tp.alias("__tp"), fp.alias("__fp"), fn.alias("__fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    t, p, n = F.col("__tp"), F.col("__fp"), F.col("__fn")
    return out.select(
        *(by or []),
        F.round(ratio(t, t + p), 6).alias("precision"),
        F.round(ratio(t, t + n), 6).alias("recall"),
        F.round(ratio(2 * t, 2 * t + p + n), 6).alias("f1"),
    )
