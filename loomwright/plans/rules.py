"""Rule-based classifiers (C)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as ops
from .views import Views, query


@query(
    "c01_link_type",
    ", p AS (SELECT e.a, e.b, e.sim * 2.6 AS s, x.p_type AS ca, y.p_type AS cb, x.p_size % 2 = y.p_size % 2 AS same FROM edge e JOIN part x ON e.a = x.p_partkey JOIN part y ON e.b = y.p_partkey) SELECT a, b, CASE WHEN same AND s > 0.90 THEN 'orthographic_variant' WHEN NOT same AND s > 0.80 THEN 'same_referent' WHEN ca = cb AND s > 0.75 THEN 'same_referent' ELSE 'conceptual_overlap' END AS kind FROM p",
)
def c01(v: Views) -> DataFrame:
    x = v.part.select(F.col("p_partkey").alias("a"), F.col("p_type").alias("ca"), F.col("p_size").alias("sa"))
    y = v.part.select(F.col("p_partkey").alias("b"), F.col("p_type").alias("cb"), F.col("p_size").alias("sb"))
    j = v.edge.join(x, "a").join(y, "b")
    kind = ops.link_type(F.col("sim") * 2.6, F.col("sa") % 2 == F.col("sb") % 2, F.col("ca"), F.col("cb"), F.lit("X"), F.lit("Y"))
    return j.select("a", "b", kind.alias("kind"))


@query(
    "c02_recipe",
    r"SELECT doc_id, (len(regexp_extract_all(text, '\d+')) >= 3 OR (regexp_matches(text, 'License') AND len(regexp_extract_all(text, '\d+')) >= 1)) AS recipe FROM documents WHERE len(regexp_extract_all(text, '[A-Z]')) < 6",
)
def c02(v: Views) -> DataFrame:
    few = v.documents.where(F.regexp_count("text", F.lit("[A-Z]")) < 6)
    return few.select("doc_id", ops.is_recipe(F.col("text"), r"\d+", "License", ["never said"], F.lit("")).alias("recipe"))


@query(
    "c03_vocabulary_match",
    ", p AS (SELECT e.a, e.b, x.p_name AS n, y.p_name AS m, x.p_type AS c, y.p_type AS d FROM edge e JOIN part x ON e.a = x.p_partkey JOIN part y ON e.b = y.p_partkey) SELECT a, b, c = d AND (n = m OR contains(n, m) OR contains(m, n) OR len(list_filter(range(1, least(length(n), length(m)) + 1), lambda i: starts_with(m, substr(n, 1, CAST(i AS INTEGER))))) / least(length(n), length(m)) >= 0.6) AS good FROM p",
)
def c03(v: Views) -> DataFrame:
    x = v.part.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("n"), F.col("p_type").alias("c"))
    y = v.part.select(F.col("p_partkey").alias("b"), F.col("p_name").alias("m"), F.col("p_type").alias("d"))
    j = v.edge.join(x, "a").join(y, "b")
    return j.select("a", "b", ops.vocabulary_match(F.col("c"), F.col("d"), F.col("n"), F.col("n"), F.col("m"), F.col("m")).alias("good"))


_GROUPS = {"ly": ["the", "and", "that"], "ro": ["que", "de la", "les"], "ge": ["und", "der", "ein"]}


def _hits(words: list[str]) -> str:
    return " + ".join(f"contains(lower(text), '{w}')::INT" for w in words)


@query(
    "c04_relationship",
    f", s AS (SELECT conv_id, turn, {_hits(_GROUPS['ly'])} AS a, {_hits(_GROUPS['ro'])} AS b, {_hits(_GROUPS['ge'])} AS c FROM conversations) SELECT conv_id, turn, CASE WHEN greatest(a, b, c) = 0 THEN 'possible_synonym' WHEN a = greatest(a, b, c) THEN 'ly' WHEN b = greatest(a, b, c) THEN 'ro' ELSE 'ge' END AS label, CAST(CASE WHEN greatest(a, b, c) = 0 THEN 0.4 ELSE least(0.95, round(0.5 + greatest(a, b, c) * 0.15, 6)) END AS DOUBLE) AS confidence FROM s",
)
def c04(v: Views) -> DataFrame:
    r = ops.relationship(F.col("text"), F.lit("PLANT"), F.lit("plant"), _GROUPS)
    return v.conversations.select("conv_id", "turn", r.alias("r")).select("conv_id", "turn", "r.label", "r.confidence")


@query(
    "c05_decision_list",
    """, s AS (SELECT id, id % 13 = 0 AS ocr, id % 11 = 0 AS gen, CASE id % 5 WHEN 0 THEN 'true_synonym' WHEN 1 THEN 'authority_cooccurrence' WHEN 2 THEN 'ingredient_cooccurrence' ELSE 'unclassified' END AS rel, id % 7 <> 0 AS ok, id % 2 = 0 AS recipe, id % 3 = 0 AS spec, id % 4 <> 0 AS matched, id % 6 = 0 AS crossed FROM entity)
    SELECT id, CASE WHEN ocr THEN 'ocr_noise' WHEN gen THEN 'generic_term' WHEN rel = 'true_synonym' THEN rel WHEN NOT ok THEN 'spurious_match' WHEN rel = 'authority_cooccurrence' THEN rel
      WHEN recipe AND rel = 'ingredient_cooccurrence' THEN rel WHEN recipe AND crossed AND spec THEN 'entity_in_recipe' WHEN recipe AND NOT matched AND NOT spec THEN 'ingredient_cooccurrence' WHEN recipe AND matched AND spec THEN 'entity_in_recipe' WHEN recipe THEN 'probable_recipe'
      WHEN crossed AND spec THEN 'probable_link' WHEN matched THEN 'possible_link' ELSE 'needs_review' END AS label FROM s""",
)
def c05(v: Views) -> DataFrame:
    i = F.col("id")
    rel = F.when(i % 5 == 0, "true_synonym").when(i % 5 == 1, "authority_cooccurrence").when(i % 5 == 2, "ingredient_cooccurrence").otherwise("unclassified")
    label = ops.finding_label(i % 13 == 0, i % 11 == 0, rel, i % 7 != 0, i % 2 == 0, i % 3 == 0, i % 4 != 0, i % 6 == 0)
    return v.entity.select("id", label.alias("label"))


_XREF = {"context": ["ring"], "naming": ["gear"], "derivation": ["bolt"], "made": ["plate"]}


@query(
    "c06_xref_type",
    ", s AS (SELECT id, name, CASE id % 4 WHEN 0 THEN 'true_synonym' WHEN 1 THEN 'subtype_relation' WHEN 2 THEN 'probable_link' ELSE 'contested_identity' END AS label FROM entity) SELECT id, CASE WHEN label = 'true_synonym' THEN 'same_referent' WHEN label = 'contested_identity' THEN label WHEN label = 'subtype_relation' AND contains(name, 'plate') THEN 'derivation' WHEN label = 'probable_link' AND contains(name, 'ring') THEN 'conceptual_overlap' WHEN label = 'probable_link' AND contains(name, 'gear') THEN 'cross_linguistic' WHEN label = 'probable_link' AND contains(name, 'bolt') THEN 'derivation' ELSE 'conceptual_overlap' END AS kind FROM s",
)
def c06(v: Views) -> DataFrame:
    i = F.col("id") % 4
    label = F.when(i == 0, "true_synonym").when(i == 1, "subtype_relation").when(i == 2, "probable_link").otherwise("contested_identity")
    return v.entity.select("id", ops.xref_type(label, F.col("name"), _XREF).alias("kind"))


@query("c07_keep_reason", "SELECT cluster_id, CASE WHEN book_count >= 95 THEN 'widely attested' WHEN total_mentions >= 4000 THEN 'often mentioned' WHEN category IN ('PROMO', 'SMALL') THEN 'named kind' ELSE 'default' END AS reason FROM stats")
def c07(v: Views) -> DataFrame:
    reason = F.when(F.col("book_count") >= 95, "widely attested").when(F.col("total_mentions") >= 4000, "often mentioned").when(F.col("category").isin("PROMO", "SMALL"), "named kind").otherwise("default")
    return v.stats.select("cluster_id", reason.alias("reason"))


_VALID = {"ECONOMY": ["Brand#1", "Brand#2"], "PROMO": ["Brand#3", "Brand#4"], "SMALL": ["Brand#5"]}


@query(
    "c08_category_repair",
    """, a AS (SELECT id, category, CASE subcategory WHEN 'Brand#6' THEN 'Brand#1' ELSE subcategory END AS sub FROM entity), b AS (SELECT id, sub, CASE WHEN category IN ('ECONOMY', 'PROMO', 'SMALL') THEN category WHEN sub IN ('Brand#1', 'Brand#2') THEN 'ECONOMY' WHEN sub IN ('Brand#3', 'Brand#4') THEN 'PROMO' WHEN sub = 'Brand#5' THEN 'SMALL' ELSE category END AS cat FROM a)
    SELECT id, cat AS category, CASE WHEN (cat = 'ECONOMY' AND sub IN ('Brand#1', 'Brand#2')) OR (cat = 'PROMO' AND sub IN ('Brand#3', 'Brand#4')) OR (cat = 'SMALL' AND sub = 'Brand#5') THEN sub ELSE 'OTHER_' || cat END AS subcategory FROM b""",
)
def c08(v: Views) -> DataFrame:
    r = ops.repair_category(F.col("category"), F.col("subcategory"), _VALID, {"Brand#6": "Brand#1"})
    return v.entity.select("id", r.alias("r")).select("id", "r.category", "r.subcategory")


@query("c09_reclassification", "SELECT e.id, coalesce(o.sub, 'OTHER_' || e.category) AS subcategory FROM entity e LEFT JOIN (SELECT lower(name) AS k, max(subcategory) AS sub FROM entity WHERE id % 50 = 0 GROUP BY 1) o ON lower(e.name) = o.k")
def c09(v: Views) -> DataFrame:
    overlay = v.entity.where("id % 50 = 0").groupBy(F.lower("name").alias("k")).agg(F.max("subcategory").alias("sub"))
    j = v.entity.join(overlay, F.lower("name") == F.col("k"), "left")
    return j.select("id", F.coalesce("sub", F.concat(F.lit("OTHER_"), "category")).alias("subcategory"))


@query("c10_tier", "SELECT cluster_id, CAST(CASE WHEN cluster_id % 2 = 0 AND category = 'PROMO' AND book_count < 90 THEN 1 WHEN cluster_id % 2 <> 0 AND category = 'SMALL' AND book_count > 50 THEN 3 ELSE 2 END AS INTEGER) AS tier FROM stats")
def c10(v: Views) -> DataFrame:
    confidence = F.when(F.col("category") == "PROMO", "high").when(F.col("category") == "SMALL", "low").otherwise("medium")
    low = ops.tier(F.col("cluster_id") % 2 == 0, confidence, F.when(confidence == "low", F.col("book_count") / 100).otherwise(F.col("book_count") / 180))
    return v.stats.select("cluster_id", low.alias("tier"))


@query("c11_training_label", "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.0 ELSE 0.5 END AS DOUBLE) AS y FROM orders")
def c11(v: Views) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "same_referent").when(F.col("o_orderstatus") == "O", "hard_negative").otherwise("contested_identity")
    return v.orders.select("o_orderkey", ops.training_label(kind).alias("y"))
