"""Training-set preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import global_rank


def unordered_distinct(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Each pair once, whichever way round."""
    return pairs.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()


def both_directions(pairs: DataFrame, a: str, b: str, *others: str) -> DataFrame:
    return pairs.select(a, b, *others).unionByName(pairs.select(F.col(b).alias(a), F.col(a).alias(b), *others))


def triplets(pairs: DataFrame, negatives: DataFrame, a: str, b: str, seed: int = 0) -> DataFrame:
    """Both directions of each pair with one negative (column `negative`), drawn evenly from the distinct negatives by a
    hash of the pair. Without negatives there are no triplets."""
    pool = negatives.where(F.col("negative").isNotNull()).select("negative").distinct()
    order = [F.md5(F.col("negative").cast("string")), F.col("negative")]
    pool = global_rank(pool, order, "__rank").select("negative", (F.col("__rank") - 1).alias("__slot"))
    n = pool.count()
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", a, b, F.lit(seed))), 1, 15), 16, 10).cast("long") % F.lit(max(n, 1))
    return both_directions(pairs.withColumn("__at", drawn).join(pool, F.col("__at") == F.col("__slot")), a, b, "negative")


def stratified_split(df: DataFrame, label: str, key: str, test: float, name: str = "is_test") -> DataFrame:
    """Marks about a share `test` of each label, in the order of a hash of the key."""
    w = Window.partitionBy(label)
    rank = F.row_number().over(w.orderBy(F.md5(F.col(key).cast("string")), key))
    return df.withColumn("__r", rank).withColumn(name, F.col("__r") <= F.floor(F.count("*").over(w) * test)).drop("__r")


def chat_lines(df: DataFrame, system: str, user: str, answer: str) -> DataFrame:
    """One JSON chat per row: system, user and assistant messages."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(message("system", F.lit(system)), message("user", F.col(user)), message("assistant", F.col(answer)))
    return df.withColumn("line", F.to_json(F.struct(messages.alias("messages"))))
