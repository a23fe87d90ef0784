"""Search filters and suspicion tests on names, clusters and members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalise import registry_text
from ..functions.similarity import contains_either, string_similarity


def search_names(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows in which any of the columns contains the query, without regard to case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(c).contains(query.lower())
    return df.where(hit)


def initial_of(name: Column) -> Column:
    """The first letter after folding, A to Z, else #."""
    first = F.upper(F.substring(registry_text(name), 1, 1))
    return F.when(first.rlike("^[A-Z]$"), first).otherwise("#")


def suspicious_clusters(members: DataFrame, total_mentions: str | None = None) -> DataFrame:
    """Clusters with the number of reasons for doubt and whether there are two or more.

    members: cluster_id, canonical_name, name, book_id; contexts (array) and a column of mentions if there are any.
    """
    m = members.withColumn("sim", string_similarity(F.col("canonical_name"), F.col("name")))
    per_book = m.groupBy("cluster_id", "book_id").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("sim") < 0.99, F.col("sim"))).alias("s"), F.count_if(F.col("sim") < 0.99).alias("k"),
        F.min("sim").alias("lo"), F.sum(F.length("name")).alias("chars"),
    )
    g = per_book.groupBy("cluster_id").agg(
        F.max("n").alias("same_book"), F.sum("n").alias("members"), F.sum("s").alias("s"), F.sum("k").alias("k"), F.min("lo").alias("lo"), F.sum("chars").alias("chars")
    )
    mean = F.when(F.col("k") > 0, F.col("s") / F.col("k")).otherwise(1.0)
    tests = [
        F.col("same_book") >= 3,
        mean < 0.4,
        (F.col("lo") < 0.15) & (F.col("members") > 2),
        F.col("members") >= 6,
        (F.col("chars") / F.col("members") < 7) & (mean < 0.5),
    ]
    if "contexts" in members.columns:
        words = members.select("cluster_id", F.explode("contexts").alias("c"))
        words = words.select("cluster_id", "c", F.explode(F.filter(F.split(F.lower("c"), r"\s+"), lambda w: F.length(w) > 4)).alias("w"))
        spread = words.groupBy("cluster_id").agg(F.countDistinct("w").alias("words"), F.count_distinct("c").alias("n_contexts"))
        g = g.join(spread, "cluster_id", "left")
        tests.append(F.coalesce((F.col("n_contexts") >= 3) & (F.col("words") > 4 * F.col("n_contexts")), F.lit(False)))
    if total_mentions:
        a = members.select("cluster_id", F.lower("name").alias("n1"))
        b = members.select(F.col("cluster_id").alias("c2"), F.lower("name").alias("n2"))
        pairs = a.join(b, (F.col("cluster_id") == F.col("c2")) & (F.col("n1") < F.col("n2")))
        like = contains_either(F.col("n1"), F.col("n2")) | (string_similarity(F.col("n1"), F.col("n2")) > 0.65)
        good = pairs.where(like).select("cluster_id").distinct().withColumn("translated", F.lit(True))
        totals = members.groupBy("cluster_id").agg(F.sum(total_mentions).alias("mentions"))
        g = g.join(totals, "cluster_id").join(good, "cluster_id", "left")
        rare = (F.col("mentions") <= 20) & (F.col("members") <= 4) & (mean < 0.55)
        tests.append(rare & F.col("translated").isNull())
    reasons = sum((t.cast("int") for t in tests), F.lit(0))
    return g.select("cluster_id", reasons.alias("reasons"), (reasons >= 2).alias("suspicious"))


def suspicious_members(members: DataFrame, floor: float = 0.30, other_floor: float = 0.35) -> DataFrame:
    """Members whose name is unlike the cluster's and unlike every other member's, and neither contains the other."""
    m = members.withColumn("sim", string_similarity(F.col("canonical_name"), F.col("name")))
    other = members.select(F.col("cluster_id").alias("c2"), F.col("name").alias("n2"))
    pairs = members.join(other, (F.col("cluster_id") == F.col("c2")) & (F.col("name") != F.col("n2")))
    best = pairs.groupBy("cluster_id", "name").agg(F.max(string_similarity(F.col("name"), F.col("n2"))).alias("best"))
    inside = contains_either(F.lower("canonical_name"), F.lower("name"))
    found = m.join(best, ["cluster_id", "name"], "left")
    return found.where((F.col("sim") < floor) & (F.coalesce("best", F.lit(0.0)) < other_floor) & ~inside)
