"""Entity-resolution views of the driver's tables, in Spark and as the common table expressions of the SQL side.

parts stand in for entities, suppliers for books, line items for attestations; clusters group entities of one category
and name; embeddings are entity vectors, their label the category.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Similarity floor of the vector edges; the vectors are random, so it is lower than the operators' defaults.
EDGE_FLOOR = 0.30

BASE_SQL = """
WITH RECURSIVE entity AS (
  SELECT p_partkey AS id, p_name AS name, p_type AS category, p_brand AS subcategory, p_size AS cnt FROM part),
att AS (
  SELECT l_suppkey AS book_id, l_partkey AS entity_id, CAST(sum(l_quantity) AS BIGINT) AS cnt,
         CAST(min(year(l_shipdate)) AS INTEGER) AS year FROM lineitem GROUP BY 1, 2),
book AS (
  SELECT s_suppkey AS book_id, s_name AS title, n_name AS language, CAST(1500 + (s_suppkey * 7) % 400 AS INTEGER) AS year
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
cluster AS (
  SELECT category, name AS canonical_name, min(id) AS cluster_id, min(subcategory) AS subcategory
  FROM entity GROUP BY 1, 2),
member AS (
  SELECT c.cluster_id, c.category, c.canonical_name, e.id AS entity_id, a.book_id, e.name, e.subcategory, a.cnt
  FROM entity e JOIN cluster c ON e.category = c.category AND e.name = c.canonical_name
  JOIN att a ON a.entity_id = e.id),
stats AS (
  SELECT cluster_id, category, canonical_name, count(DISTINCT book_id) AS book_count,
         CAST(sum(cnt) AS BIGINT) AS total_mentions, count(*) AS members
  FROM member GROUP BY 1, 2, 3),
edge AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label AS category,
         round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) AS sim
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
  WHERE list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) >= 0.30),
word AS (
  SELECT doc_id, lang, source, text AS head FROM documents)
"""


class Views:
    """The views of one data directory, and its plain tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, table: str) -> DataFrame:
        if table.startswith("_"):
            raise AttributeError(table)
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    @cached_property
    def entity(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("subcategory"),
            F.col("p_size").alias("cnt"),
        )

    @cached_property
    def att(self) -> DataFrame:
        return self.lineitem.groupBy(F.col("l_suppkey").alias("book_id"), F.col("l_partkey").alias("entity_id")).agg(
            F.sum("l_quantity").cast("long").alias("cnt"), F.min(F.year("l_shipdate")).alias("year")
        )

    @cached_property
    def book(self) -> DataFrame:
        named = self.supplier.join(F.broadcast(self.nation), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
        return named.select(
            F.col("s_suppkey").alias("book_id"),
            F.col("s_name").alias("title"),
            F.col("n_name").alias("language"),
            (F.lit(1500) + (F.col("s_suppkey") * 7) % 400).cast("int").alias("year"),
        )

    @cached_property
    def cluster(self) -> DataFrame:
        return self.entity.groupBy("category", F.col("name").alias("canonical_name")).agg(
            F.min("id").alias("cluster_id"), F.min("subcategory").alias("subcategory")
        )

    @cached_property
    def member(self) -> DataFrame:
        c = self.cluster.select(F.col("category").alias("c_category"), "canonical_name", "cluster_id")
        e = self.entity.join(c, (F.col("category") == F.col("c_category")) & (F.col("name") == F.col("canonical_name")))
        a = self.att.select("book_id", "entity_id", F.col("cnt").alias("a_cnt"))
        return e.join(a, e["id"] == a["entity_id"]).select(
            "cluster_id", "category", "canonical_name", "entity_id", "book_id", "name", "subcategory", F.col("a_cnt").alias("cnt")
        )

    @cached_property
    def stats(self) -> DataFrame:
        from ..operators.aggregates import cluster_stats

        return cluster_stats(self.member, ["cluster_id", "category", "canonical_name"])

    @cached_property
    def edge(self) -> DataFrame:
        from ..operators.neighbours import vector_pairs

        return vector_pairs(self.embeddings, "vec_id", "embedding", "label", EDGE_FLOOR).withColumnRenamed("label", "category")

    @cached_property
    def word(self) -> DataFrame:
        return self.documents.select("doc_id", "lang", "source", F.col("text").alias("head"))


Query = Callable[[Views], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; sql continues BASE_SQL (", x AS (...) SELECT ..." or "SELECT ...")."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = BASE_SQL + sql
        return f

    return add
