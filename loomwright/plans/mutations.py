"""Table mutations (M)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import valid_variant
from ..operators import mutations as ops
from .views import Views, query

_MAP = ", mp AS (SELECT canonical_name, min(cluster_id) AS keeper FROM cluster GROUP BY 1), c AS (SELECT s.cluster_id, keeper, total_mentions, CASE WHEN s.cluster_id % 3 = 0 THEN s.category END AS modern FROM stats s JOIN mp ON s.canonical_name = mp.canonical_name)"


def _mapping(v: Views) -> DataFrame:
    keep = v.cluster.groupBy("canonical_name").agg(F.min("cluster_id").alias("keeper"))
    return v.cluster.join(keep, "canonical_name").select("cluster_id", "keeper")


@query(
    "m01_merge_into",
    _MAP + " SELECT keeper AS cluster_id, CAST(sum(total_mentions) AS BIGINT) AS total_mentions, count(*) AS merged, (list(modern ORDER BY (cluster_id <> keeper)::INT, total_mentions DESC, cluster_id) FILTER (modern IS NOT NULL))[1] AS modern FROM c GROUP BY keeper",
)
def m01(v: Views) -> DataFrame:
    c = v.stats.withColumn("modern", F.when(F.col("cluster_id") % 3 == 0, F.col("category")))
    return ops.merge_into(c, _mapping(v), ["modern"])


@query(
    "m02_split_members",
    ", sp AS (SELECT DISTINCT cluster_id, entity_id FROM member WHERE entity_id % 7 = 0), l AS (SELECT m.cluster_id, count(*) FILTER (sp.entity_id IS NULL) AS k FROM member m LEFT JOIN sp USING (cluster_id, entity_id) GROUP BY 1) SELECT CASE WHEN sp.entity_id IS NOT NULL AND l.k > 0 THEN 1000000 + m.entity_id ELSE m.cluster_id END AS cluster_id, count(*) AS members FROM member m LEFT JOIN sp USING (cluster_id, entity_id) JOIN l USING (cluster_id) GROUP BY 1",
)
def m02(v: Views) -> DataFrame:
    splits = v.member.where("entity_id % 7 = 0")
    done = ops.split_members(v.member, splits, F.lit(1_000_000) + F.col("entity_id"))
    return done.groupBy("cluster_id").agg(F.count("*").alias("members"))


_GONE = ", gone AS (SELECT DISTINCT cluster_id, entity_id FROM member WHERE {w}), k AS (SELECT m.* FROM member m WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.cluster_id = m.cluster_id AND g.entity_id = m.entity_id))"


@query("m03_remove_members", _GONE.format(w="entity_id % 2 = 0") + " SELECT cluster_id, count(*) AS members, count(DISTINCT book_id) AS book_count FROM k GROUP BY 1")
def m03(v: Views) -> DataFrame:
    left = ops.remove_members(v.member, v.member.where("entity_id % 2 = 0"), ["cluster_id", "entity_id"])
    return left.groupBy("cluster_id").agg(F.count("*").alias("members"), F.countDistinct("book_id").alias("book_count"))


@query("m04_verdicts", _GONE.format(w="subcategory <> 'Brand#3'") + " SELECT cluster_id, entity_id, book_id FROM k WHERE cluster_id IN (SELECT cluster_id FROM k GROUP BY 1 HAVING count(*) >= 40 AND count(DISTINCT book_id) >= 35)")
def m04(v: Views) -> DataFrame:
    gone = v.member.where("subcategory <> 'Brand#3'")
    return ops.remove_members(v.member, gone, ["cluster_id", "entity_id"], 40, 35).select("cluster_id", "entity_id", "book_id")


@query("m05_curated_fixes", "SELECT cluster_id, CASE WHEN category = 'PROMO' AND cluster_id % 2 = 0 THEN 'STANDARD' ELSE category END AS category FROM cluster WHERE cluster_id NOT IN (SELECT cluster_id FROM cluster WHERE canonical_name = 'hot rod')")
def m05(v: Views) -> DataFrame:
    gone = v.cluster.where("canonical_name = 'hot rod'").select("cluster_id")
    left = v.cluster.join(gone, "cluster_id", "left_anti").select("cluster_id", "category")
    changes = v.cluster.where("category = 'PROMO' and cluster_id % 2 = 0").select("cluster_id", F.lit("STANDARD").alias("category"))
    return ops.update(left, changes, "cluster_id", ["category"])


@query("m06_clear_fields", "SELECT id, CASE WHEN id % 10 = 0 THEN NULL WHEN id % 10 = 1 THEN 'fixed' ELSE name END AS name FROM entity")
def m06(v: Views) -> DataFrame:
    changes = v.entity.where("id % 10 < 2").select("id", F.when(F.col("id") % 10 == 1, "fixed").alias("name"), (F.col("id") % 10 == 0).alias("wipe"))
    return ops.update(v.entity.select("id", "name"), changes, "id", ["name"], clear="wipe")


@query(
    "m07_prune_variants",
    ", g AS (SELECT category, min(name) AS name, list_sort(list(DISTINCT name)) AS vs FROM entity GROUP BY 1) SELECT category, array_to_string(list_filter(vs, lambda x: x = name OR 1 - levenshtein(x, name) / greatest(length(x), length(name)) >= 0.45), ',') AS variants FROM g",
)
def m07(v: Views) -> DataFrame:
    g = v.entity.groupBy("category").agg(F.min("name").alias("name"), F.array_sort(F.collect_set("name")).alias("variants"))
    return ops.prune_variants(g, valid_variant).select("category", F.array_join("variants", ",").alias("variants"))


@query(
    "m08_apply_enrichment",
    "SELECT c.cluster_id, CASE WHEN c.category = 'PROMO' THEN c.canonical_name || ' plant' WHEN c.category = 'SMALL' THEN c.subcategory END AS linnaean FROM cluster c",
)
def m08(v: Views) -> DataFrame:
    found = v.cluster.select("cluster_id", F.concat("canonical_name", F.lit(" plant")).alias("plant"), F.col("subcategory").alias("person"))
    j = v.cluster.select("cluster_id", "category").join(found, "cluster_id", "left")
    return j.select("cluster_id", F.when(F.col("category") == "PROMO", F.col("plant")).when(F.col("category") == "SMALL", F.col("person")).alias("linnaean"))


@query("m09_transfer", "SELECT e.id, coalesce(o.subcategory, e.subcategory) AS subcategory FROM entity e LEFT JOIN (SELECT name, min(subcategory) AS subcategory FROM entity WHERE id < 100 GROUP BY 1) o ON e.name = o.name")
def m09(v: Views) -> DataFrame:
    old = v.entity.where("id < 100").groupBy("name").agg(F.min("subcategory").alias("subcategory"))
    return ops.update(v.entity.select("id", "name", "subcategory"), old, "name", ["subcategory"]).select("id", "subcategory")


@query("m10_attach_xrefs", "SELECT c.c_custkey AS cluster_id, CAST((SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 300000) AS INTEGER) AS refs FROM customer c")
def m10(v: Views) -> DataFrame:
    refs = v.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("cluster_id"), "o_orderkey")
    done = ops.attach(v.customer.select(F.col("c_custkey").alias("cluster_id")), refs, "cluster_id", "xrefs")
    return done.select("cluster_id", F.size("xrefs").alias("refs"))


@query(
    "m11_integrity",
    "SELECT 'duplicate cluster ids' AS \"check\", CAST(0 AS BIGINT) AS bad UNION ALL SELECT 'duplicate index ids', 0 UNION ALL SELECT 'clusters not in index', count(*) FROM cluster WHERE cluster_id % 11 = 0 UNION ALL SELECT 'index not in clusters', 0 UNION ALL SELECT 'unknown neighbours', count(*) FROM edge WHERE b NOT IN (SELECT cluster_id FROM cluster) UNION ALL SELECT 'own neighbours', 0",
)
def m11(v: Views) -> DataFrame:
    ids = v.cluster.select("cluster_id")
    nbr = v.edge.select(F.col("a").alias("id"), F.col("b").alias("nbr"))
    return ops.integrity(ops.registry_checks(ids, ids.where("cluster_id % 11 <> 0"), nbr))


@query(
    "m12_cleanup_order",
    "SELECT category, count(*) AS n, CAST(sum(total_mentions) AS BIGINT) AS mentions FROM stats WHERE length(canonical_name) > 7 AND cluster_id % 5 <> 0 GROUP BY 1",
)
def m12(v: Views) -> DataFrame:
    # the phases in their order, each a function of the table before it
    phases = [lambda d: d.where(F.length("canonical_name") > 7), lambda d: d.where("cluster_id % 5 <> 0"), lambda d: d.groupBy("category").agg(F.count("*").alias("n"), F.sum("total_mentions").cast("long").alias("mentions"))]
    out = v.stats
    for phase in phases:
        out = phase(out)
    return out
