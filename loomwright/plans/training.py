"""Training-set preparation (E)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import training as ops
from .views import Views, query


@query("e01_flatten_pairs", "SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT a, b FROM edge UNION ALL SELECT b, a FROM edge)")
def e01(v: Views) -> DataFrame:
    batches = v.edge.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
    return ops.unordered_distinct(batches.select("p.a", "p.b"), "a", "b")


@query("e02_bidirectional", "SELECT a, b FROM edge UNION ALL SELECT b, a FROM edge")
def e02(v: Views) -> DataFrame:
    return ops.both_directions(v.edge, "a", "b")


@query(
    "e02b_triplets",
    ", pool AS (SELECT negative, row_number() OVER (ORDER BY md5(CAST(negative AS VARCHAR)), negative) - 1 AS slot FROM (SELECT DISTINCT vec_id AS negative FROM embeddings)), t AS (SELECT a, b, negative FROM edge JOIN pool ON slot = CAST('0x' || substr(md5(a || '|' || b || '|0'), 1, 15) AS BIGINT) % (SELECT count(*) FROM pool)) SELECT a, b, negative FROM t UNION ALL SELECT b, a, negative FROM t",
)
def e02b(v: Views) -> DataFrame:
    return ops.triplets(v.edge.select("a", "b"), v.embeddings.select(F.col("vec_id").alias("negative")), "a", "b")


@query(
    "e03_stratified_split",
    "SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= floor(count(*) OVER (PARTITION BY quality) * 0.25) AS is_test FROM labels",
)
def e03(v: Views) -> DataFrame:
    return ops.stratified_split(v.labels.select("doc_id", "quality"), "quality", "doc_id", 0.25)


@query(
    "e04_decisions_export",
    "SELECT m.cluster_id, m.entity_id, m.book_id, CASE WHEN g.id IS NOT NULL THEN 'remove' ELSE 'keep' END AS decision FROM member m LEFT JOIN (SELECT id FROM entity WHERE cnt < 5) g ON m.entity_id = g.id",
)
def e04(v: Views) -> DataFrame:
    gone = v.entity.where("cnt < 5").select(F.col("id").alias("gid"))
    j = v.member.join(gone, F.col("entity_id") == F.col("gid"), "left")
    return j.select("cluster_id", "entity_id", "book_id", F.when(F.col("gid").isNotNull(), "remove").otherwise("keep").alias("decision"))


@query("e05_curated_negatives", "SELECT c.cluster_id AS a, d.cluster_id AS b FROM (VALUES ('red gear', 'old bolt'), ('hot rod', 'cold ring')) t(x, y) JOIN cluster c ON c.canonical_name = x JOIN cluster d ON d.canonical_name = y AND c.category = d.category")
def e05(v: Views) -> DataFrame:
    listed = v.spark.createDataFrame([("red gear", "old bolt"), ("hot rod", "cold ring")], "x string, y string")
    c = v.cluster.select(F.col("canonical_name").alias("x"), F.col("cluster_id").alias("a"), "category")
    d = v.cluster.select(F.col("canonical_name").alias("y"), F.col("cluster_id").alias("b"), F.col("category").alias("cat2"))
    return c.join(F.broadcast(listed), "x").join(d, "y").where("category = cat2").select("a", "b")


@query("e06_chat_export", "SELECT id, name || '|' || category AS pair FROM entity")
def e06(v: Views) -> DataFrame:
    lines = ops.chat_lines(v.entity, "Classify the term.", "name", "category")
    part = lambda i: F.get_json_object("line", f"$.messages[{i}].content")
    return lines.select("id", F.concat_ws("|", part(1), part(2)).alias("pair"))


@query("e08_score_curated", "SELECT a, b, greatest(sim, 0.33) AS score FROM edge UNION ALL SELECT a, b + 1, 0.8 FROM edge WHERE category = 2")
def e08(v: Views) -> DataFrame:
    positive = v.edge.select("a", "b", F.greatest("sim", F.lit(0.33)).alias("score"))
    return positive.unionByName(v.edge.where("category = 2").select("a", (F.col("b") + 1).alias("b"), F.lit(0.8).alias("score")))
