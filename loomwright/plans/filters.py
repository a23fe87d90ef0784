"""Filters, predicates and projections (F and P)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import percent_encoded, search_phrase
from ..functions.normalise import registry_text
from ..functions.rules import (
    is_noise_name,
    is_ocr_garbage,
    is_specific_name,
    is_transparent_cognate,
    is_useful_name,
    junk_cluster,
    low_alpha,
    noise_cluster,
    noise_reasons,
    plausible_merge,
    valid_variant,
)
from ..functions.similarity import string_similarity
from ..operators.filters import initial_of, search_names, suspicious_clusters, suspicious_members
from .views import Views, query


@query("f01_min_count", "SELECT id, name, cnt FROM entity WHERE cnt >= 25")
def f01(v: Views) -> DataFrame:
    return v.entity.where("cnt >= 25").select("id", "name", "cnt")


@query("f02_category", "SELECT id, name FROM entity WHERE category = 'PROMO'")
def f02(v: Views) -> DataFrame:
    return v.entity.where("category = 'PROMO'").select("id", "name")


@query(
    "f03_book_membership",
    "SELECT cluster_id FROM (SELECT cluster_id, list(DISTINCT book_id) AS books FROM member GROUP BY 1) WHERE list_contains(books, 7)",
)
def f03(v: Views) -> DataFrame:
    books = v.member.groupBy("cluster_id").agg(F.collect_set("book_id").alias("books"))
    return books.where(F.array_contains("books", F.lit(7).cast("long"))).select("cluster_id")


@query("f04_cross_book", "SELECT cluster_id, CASE WHEN book_count >= 2 THEN 'only' ELSE 'exclude' END AS mode FROM stats")
def f04(v: Views) -> DataFrame:
    return v.stats.select("cluster_id", F.when(F.col("book_count") >= 2, "only").otherwise("exclude").alias("mode"))


_SAMPLES = """
, sample AS (SELECT doc_id, trim(string_split(replace(text, chr(10), ' '), ' ')[1 + CAST(doc_id % 7 AS INTEGER)]) AS name,
                    CAST(doc_id % 30 AS INTEGER) AS mentions FROM documents)
"""


def _samples(v: Views) -> DataFrame:
    words = F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), " ")
    name = F.trim(F.get(words, F.pmod("doc_id", F.lit(7)).cast("int")))
    return v.documents.select("doc_id", name.alias("name"), F.pmod("doc_id", F.lit(30)).cast("int").alias("mentions"))


_NOISE = r"""
, raw AS (SELECT doc_id, coalesce(name, '') AS r, mentions,
    length(regexp_replace(coalesce(name, ''), '[^\p{L}]', '', 'g')) AS letters,
    length(regexp_replace(coalesce(name, ''), '[^\p{N}]', '', 'g')) AS digits,
    length(regexp_replace(coalesce(name, ''), '[\p{L}\p{N}\s]', '', 'g')) AS marks, length(coalesce(name, '')) AS n FROM sample)
, noisy AS (SELECT doc_id, r, mentions, list_filter([
    CASE WHEN regexp_matches(r, '[»«^§|{}†‡¶•☉♀♈〈〉]') THEN 'ocr_noise_char' END,
    CASE WHEN regexp_matches(r, '(?i)\b(fol\.|lib\.|cap\.|timoth\b|regum\b)\b') THEN 'bibliographic_fragment' END,
    CASE WHEN n <= 2 AND mentions < 10 THEN 'very_short_low_count' END,
    CASE WHEN regexp_matches(r, '(?i)^[0-9]{3,4}[a-z]?$') THEN 'year_or_page_token' END,
    CASE WHEN regexp_matches(r, '(?i)\b(janeiro|fevereiro|marco|março|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro|january|february|march|april|may|june|july|august|september|october|november|december)\b') AND digits >= 1 THEN 'date_phrase' END,
    CASE WHEN regexp_matches(r, '[/\\]') AND mentions < 100 THEN 'slash_noise' END,
    CASE WHEN regexp_matches(r, '[£€<>]') THEN 'symbol_noise' END,
    CASE WHEN regexp_matches(r, '^[_''".()\[\]{}]+|[_''".()\[\]{}]+$') THEN 'wrapped_punctuation' END,
    CASE WHEN letters = 0 AND digits > 0 THEN 'numeric_only' END,
    CASE WHEN letters = 0 AND marks >= 2 THEN 'punctuation_only' END,
    CASE WHEN NOT regexp_matches(r, '[A-Za-zÀ-ÿ]') AND mentions < 20 THEN 'non_latin_low_count' END,
    CASE WHEN letters > 0 AND marks / greatest(n, 1) >= 0.35 THEN 'high_punctuation_ratio' END,
    CASE WHEN digits >= 4 AND digits / greatest(n, 1) > 0.45 THEN 'high_digit_ratio' END,
    CASE WHEN regexp_matches(r, '^[\W_].*[\W_]$') AND letters < 3 THEN 'bounded_by_nonword' END], lambda x: x IS NOT NULL) AS reasons FROM raw)
"""


@query("f05_noise_name", _SAMPLES + _NOISE + "SELECT doc_id, (r = '' OR len(reasons) > 0) AS noise FROM noisy")
def f05(v: Views) -> DataFrame:
    return _samples(v).select("doc_id", is_noise_name(F.col("name"), F.col("mentions")).alias("noise"))


@query("f06_noise_reasons", _SAMPLES + _NOISE + "SELECT doc_id, CASE WHEN r = '' THEN 'empty' ELSE array_to_string(reasons, ';') END AS reasons FROM noisy")
def f06(v: Views) -> DataFrame:
    return _samples(v).select("doc_id", F.array_join(noise_reasons(F.col("name"), F.col("mentions")), ";").alias("reasons"))


@query(
    "f07_initial",
    _SAMPLES
    + ", folded AS (SELECT doc_id, upper(substr(strip_accents(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(name, 'Æ', 'AE'), 'æ', 'ae'), 'Œ', 'OE'), 'œ', 'oe'), 'ß', 'ss'), 'Ø', 'O'), 'ø', 'o'), 'Ð', 'D'), 'ð', 'd'), 'Þ', 'Th'), 'þ', 'th')), 1, 1)) AS c FROM sample)"
    " SELECT doc_id, CASE WHEN c BETWEEN 'A' AND 'Z' THEN c ELSE '#' END AS initial FROM folded",
)
def f07(v: Views) -> DataFrame:
    return _samples(v).select("doc_id", initial_of(F.col("name")).alias("initial"))


@query(
    "f08_nested_search",
    "SELECT DISTINCT cluster_id FROM member WHERE contains(lower(canonical_name), 'ring') OR contains(lower(subcategory), '#12')",
)
def f08(v: Views) -> DataFrame:
    nested = v.member.groupBy("cluster_id", "canonical_name").agg(F.collect_set("subcategory").alias("variants"))
    hit = F.lower("canonical_name").contains("ring") | F.exists("variants", lambda x: F.lower(x).contains("#12"))
    return nested.where(hit).select("cluster_id")


@query(
    "f09_book_search",
    "SELECT id, name, category, cnt FROM entity WHERE contains(lower(name), 'gear') AND category = 'SMALL' ORDER BY cnt DESC, id LIMIT 50",
)
def f09(v: Views) -> DataFrame:
    found = search_names(v.entity, "gear", ["name"]).where("category = 'SMALL'")
    return found.orderBy(F.desc("cnt"), "id").limit(50).select("id", "name", "category", "cnt")


@query(
    "f10_prefix_first",
    "SELECT cluster_id, canonical_name FROM stats WHERE contains(canonical_name, 'bolt') ORDER BY CASE WHEN starts_with(canonical_name, 'bolt') THEN 0 ELSE 1 END, book_count DESC, cluster_id LIMIT 8",
)
def f10(v: Views) -> DataFrame:
    found = search_names(v.stats, "bolt", ["canonical_name"])
    return found.orderBy(F.desc(F.col("canonical_name").startswith("bolt")), F.desc("book_count"), "cluster_id").limit(8).select("cluster_id", "canonical_name")


@query(
    "f11_like_or_in",
    "SELECT id, name, cnt FROM entity WHERE name LIKE '%red%' OR id IN (SELECT entity_id FROM att WHERE cnt >= 90) ORDER BY cnt DESC, id LIMIT 100",
)
def f11(v: Views) -> DataFrame:
    v.entity.createOrReplaceTempView("lw_entity")
    v.att.createOrReplaceTempView("lw_att")
    return v.spark.sql(
        "SELECT id, name, cnt FROM lw_entity WHERE name LIKE '%red%' OR id IN (SELECT entity_id FROM lw_att WHERE cnt >= 90) ORDER BY cnt DESC, id LIMIT 100"
    )


@query(
    "f12_junk_cluster",
    "SELECT cluster_id, CASE WHEN canonical_name IN ('old bolt') THEN 'known_junk' WHEN book_count >= 100 THEN 'has_content' WHEN category = 'PROMO' THEN 'has_modern_name' WHEN total_mentions <= 5 THEN 'empty_low_mentions' ELSE 'enough_mentions' END AS reason FROM stats",
)
def f12(v: Views) -> DataFrame:
    modern = F.when(F.col("category") == "PROMO", F.col("canonical_name"))
    reason = junk_cluster(F.col("canonical_name"), F.col("total_mentions"), F.col("book_count") >= 100, modern, ["old bolt"])
    return v.stats.select("cluster_id", reason.alias("reason"))


@query("f13_noise_cluster", _SAMPLES + r"SELECT doc_id FROM sample WHERE NOT ((length(name) <= 2 AND mentions < 10) OR regexp_matches(name, '[^\p{L}]{3,}'))")
def f13(v: Views) -> DataFrame:
    return _samples(v).where(~noise_cluster(F.col("name"), F.col("mentions"))).select("doc_id")


_SIM = """
, pre AS (SELECT lower({a}) AS x, lower({b}) AS y, {keep} FROM {src})
, simd AS (SELECT *, CASE WHEN x = y THEN 1.0 WHEN least(length(x), length(y)) = 0 THEN 0.0 ELSE
  0.5 * len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: substr(x, 1, CAST(i AS INTEGER)) = substr(y, 1, CAST(i AS INTEGER)))) / least(length(x), length(y))
  + 0.3 * len(list_intersect(list_distinct(string_split(x, '')), list_distinct(string_split(y, '')))) / len(list_distinct(list_concat(string_split(x, ''), string_split(y, ''))))
  + 0.2 * least(length(x), length(y)) / greatest(length(x), length(y)) END AS sim FROM pre)
"""


@query(
    "f14_suspicious_cluster",
    ", g AS (SELECT l_suppkey AS gid, p_name AS name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
    ", lead AS (SELECT gid, min(name) AS canonical FROM g GROUP BY 1), j AS (SELECT g.gid, canonical, name FROM g JOIN lead ON g.gid = lead.gid)"
    + _SIM.format(a="canonical", b="name", keep="gid", src="j")
    + ", s AS (SELECT gid, count(*) AS members, min(sim) AS lo, coalesce(avg(CASE WHEN sim < 0.99 THEN sim END), 1.0) AS av, avg(length(y)) AS len FROM simd GROUP BY 1)"
    "SELECT gid, CAST((members >= 3)::INT + (av < 0.4)::INT + (lo < 0.15 AND members > 2)::INT + (members >= 6)::INT + (len < 7 AND av < 0.5)::INT AS INTEGER) AS reasons FROM s",
)
def f14(v: Views) -> DataFrame:
    g = v.lineitem.join(v.part, F.col("l_partkey") == F.col("p_partkey"))
    g = g.select(F.col("l_suppkey").alias("cluster_id"), F.col("p_name").alias("name"), F.col("l_suppkey").alias("book_id")).distinct()
    lead = g.groupBy("cluster_id").agg(F.min("name").alias("canonical_name"))
    found = suspicious_clusters(g.join(lead, "cluster_id"))
    return found.select(F.col("cluster_id").alias("gid"), "reasons")


@query(
    "f15_suspicious_member",
    ", nm AS (SELECT DISTINCT category, name FROM entity), lead AS (SELECT category, min(name) AS canonical FROM nm GROUP BY 1)"
    ", j AS (SELECT nm.category, canonical, name FROM nm JOIN lead ON nm.category = lead.category)"
    + _SIM.format(a="canonical", b="name", keep="category", src="j")
    + ", o AS (SELECT a.category, a.name AS n1, b.name AS n2 FROM nm a JOIN nm b ON a.category = b.category AND a.name <> b.name)"
    + _SIM.format(a="n1", b="n2", keep="category", src="o").replace("pre", "pre2").replace("simd", "simd2")
    + ", best AS (SELECT category, x, max(sim) AS other FROM simd2 GROUP BY 1, 2)"
    "SELECT s.category, s.y AS name FROM simd s JOIN best b ON s.category = b.category AND s.y = b.x WHERE s.sim < 0.30 AND b.other < 0.80 AND NOT contains(s.x, s.y) AND NOT contains(s.y, s.x)",
)
def f15(v: Views) -> DataFrame:
    m = v.entity.select(F.col("category").alias("cluster_id"), "name").distinct()
    lead = m.groupBy("cluster_id").agg(F.min("name").alias("canonical_name"))
    return suspicious_members(m.join(lead, "cluster_id"), 0.30, 0.80).select(F.col("cluster_id").alias("category"), "name")


_NAMES2 = ", nm AS (SELECT DISTINCT name FROM entity), pr AS (SELECT a.name AS a, b.name AS b FROM nm a JOIN nm b ON a.name < b.name AND substr(a.name, 1, 1) = substr(b.name, 1, 1))"


def name_pairs(v: Views) -> DataFrame:
    """Pairs of distinct names with one initial."""
    n = v.entity.select("name", F.substring("name", 1, 1).alias("i")).distinct()
    a, b = n.select(F.col("name").alias("a"), F.col("i")), n.select(F.col("name").alias("b"), F.col("i").alias("j"))
    return a.join(b, (F.col("i") == F.col("j")) & (F.col("a") < F.col("b"))).select("a", "b")


@query(
    "f16_plausible_merge",
    _NAMES2
    + """, t AS (SELECT a, b, string_split(a, ' ') AS wa, string_split(b, ' ') AS wb FROM pr)
    SELECT a, b, (contains(a, b) OR contains(b, a)) OR (
      NOT (len(wa) >= 2 AND len(wb) >= 2 AND wa[1] = wb[1] AND levenshtein(wa[-1], wb[-1]) > greatest(2, least(length(wa[-1]), length(wb[-1])) // 2))
      AND NOT (least(length(a), length(b)) < 8 AND levenshtein(a, b) > greatest(1, least(length(a), length(b)) // 3))) AS ok FROM t""",
)
def f16(v: Views) -> DataFrame:
    return name_pairs(v).select("a", "b", plausible_merge(F.col("a"), F.col("b"), F.lit("PERSON")).alias("ok"))


@query(
    "f17_valid_variant",
    _NAMES2 + " SELECT a, b, CASE WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b)) >= 4 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) >= 0.45 END AS keep FROM pr",
)
def f17(v: Views) -> DataFrame:
    return name_pairs(v).select("a", "b", valid_variant(F.col("a"), F.col("b")).alias("keep"))


@query(
    "f18_useful_name",
    _SAMPLES + "SELECT doc_id, (length(name) >= 3 AND NOT regexp_matches(name, '^[0-9]+$') AND NOT starts_with(lower(name), 'chapter') AND NOT starts_with(lower(name), 'cap.') AND lower(name) NOT IN ('the', 'and', 'for', 'with', 'from', 'that', 'this')) AS useful FROM sample",
)
def f18(v: Views) -> DataFrame:
    return _samples(v).select("doc_id", is_useful_name(F.col("name")).alias("useful"))


@query(
    "f19_ocr_garbage",
    _SAMPLES
    + r"SELECT doc_id, (regexp_matches(name, '[»«^§|{}†‡¶≫≪●◆■□★☆♦♣♠♥]') OR regexp_matches(name, '\b[A-Z]{1,2}\s[A-Z]{1,2}\b|[^\p{L}\p{N}_\s.,;:''\-()]{2,}|\w+\^\w+|\d{3,}') OR length(regexp_replace(name, '[^\p{L}]', '', 'g')) < 2 OR (length(regexp_replace(name, '[^\p{L}]', '', 'g')) < length(name) * 0.3 AND length(name) > 3)) AS garbage, (length(regexp_replace(name, '[^\p{L}]', '', 'g')) / greatest(length(name), 1) < 0.6) AS low_alpha FROM sample WHERE NOT regexp_matches(name, '[^\x00-\x7F]')",
)
def f19(v: Views) -> DataFrame:
    s = _samples(v).where(~F.col("name").rlike(r"[^\x00-\x7F]"))
    return s.select("doc_id", is_ocr_garbage(F.col("name")).alias("garbage"), low_alpha(F.col("name")).alias("low_alpha"))


@query(
    "f20_transparent_cognate",
    _NAMES2
    + ", t AS (SELECT a, b, string_split(a, ' ') AS wa, string_split(b, ' ') AS wb FROM pr) SELECT a, b, (substr(a, 1, 4) = substr(b, 1, 4) AND abs(length(a) - length(b)) <= 3 AND least(length(a), length(b)) >= 4) OR (len(wa) >= 2 AND len(wa) = len(wb) AND len(list_filter(list_zip(wa, wb), lambda p: substr(p[1], 1, 3) = substr(p[2], 1, 3))) >= len(wa) - 1) AS cognate FROM t",
)
def f20(v: Views) -> DataFrame:
    return name_pairs(v).select("a", "b", is_transparent_cognate(F.col("a"), F.col("b")).alias("cognate"))


@query(
    "f21_block_lists",
    ", blocked AS (SELECT a, b FROM edge WHERE (a + b) % 3 = 0) SELECT e.a, e.b FROM edge e WHERE NOT EXISTS (SELECT 1 FROM blocked k WHERE k.a = e.a AND k.b = e.b) AND e.category <> 3",
)
def f21(v: Views) -> DataFrame:
    blocked = v.edge.where("(a + b) % 3 = 0").select(F.col("b").alias("x"), F.col("a").alias("y"))
    pair = blocked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return v.edge.where("category <> 3").join(pair, ["a", "b"], "left_anti").select("a", "b")


@query("f22_band", "SELECT a, b, sim FROM edge WHERE sim BETWEEN 0.32 AND 0.38")
def f22(v: Views) -> DataFrame:
    return v.edge.where(F.col("sim").between(0.32, 0.38)).select("a", "b", "sim")


@query("f23_only_missing", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL")
def f23(v: Views) -> DataFrame:
    labels = v.labels.select(F.col("doc_id").alias("l"), "quality")
    return v.documents.select("doc_id").join(labels, F.col("doc_id") == F.col("l"), "left").where("quality is null").select("doc_id")


@query("f24_recheck", "SELECT cluster_id FROM stats WHERE cluster_id % 10 = 0 OR (category <> 'PROMO' AND total_mentions >= 5000)")
def f24(v: Views) -> DataFrame:
    return v.stats.where("cluster_id % 10 = 0 or (category <> 'PROMO' and total_mentions >= 5000)").select("cluster_id")


@query(
    "f25_specific_name",
    _SAMPLES
    + r"SELECT doc_id, (length(name) >= 4 AND lower(name) NOT IN ('the') AND ((regexp_matches(name, '^\p{Lu}') AND length(name) >= 5) OR regexp_matches(lower(name), '(?:ium|eum|icum|osum|alis|aris|inus|atus|ica|osa|ola)$'))) AS is_specific FROM sample",
)
def f25(v: Views) -> DataFrame:
    return _samples(v).select("doc_id", is_specific_name(F.col("name"), ["the"]).alias("is_specific"))


@query("f26_generic_terms", "SELECT id, name FROM entity WHERE name NOT IN (SELECT name FROM entity GROUP BY name HAVING count(*) >= 35)")
def f26(v: Views) -> DataFrame:
    generic = v.entity.groupBy("name").count().where("count >= 35").select("name")
    return v.entity.join(generic, "name", "left_anti").select("id", "name")


@query(
    "f27_xref_split",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'synonyms' WHEN o_orderstatus = 'O' THEN 'contested' ELSE 'related' END AS part FROM orders",
)
def f27(v: Views) -> DataFrame:
    reverse = F.col("o_orderkey") % 2 == 1
    part = F.when((F.col("o_orderstatus") == "F") & ~reverse, "synonyms").when(F.col("o_orderstatus") == "O", "contested").otherwise("related")
    return v.orders.select("o_orderkey", part.alias("part"))


@query(
    "f28_query_shape",
    r"SELECT conv_id, turn, regexp_matches(lower(text), '^(hi|hello|hey|greetings)\b') AS greeting, regexp_matches(lower(text), '\b(how|what|recipe|prepare)\b') AS procedural FROM conversations",
)
def f28(v: Views) -> DataFrame:
    low = F.lower("text")
    return v.conversations.select(
        "conv_id", "turn", low.rlike(r"^(hi|hello|hey|greetings)\b").alias("greeting"), low.rlike(r"\b(how|what|recipe|prepare)\b").alias("procedural")
    )


@query(
    "p01_projections",
    "SELECT cluster_id, array_to_string(list_sort(list(DISTINCT book_id))[1:5], ',') AS books, array_to_string(list_sort(list(DISTINCT subcategory))[1:20], ',') AS names FROM member GROUP BY 1",
)
def p01(v: Views) -> DataFrame:
    g = v.member.groupBy("cluster_id").agg(F.array_sort(F.collect_set("book_id")).alias("b"), F.array_sort(F.collect_set("subcategory")).alias("n"))
    return g.select("cluster_id", F.array_join(F.slice("b", 1, 5).cast("array<string>"), ",").alias("books"), F.array_join(F.slice("n", 1, 20), ",").alias("names"))


@query("p02_display_name", "SELECT id, coalesce(nullif(CASE WHEN id % 3 = 0 THEN '' ELSE subcategory END, ''), name) AS display FROM entity")
def p02(v: Views) -> DataFrame:
    modern = F.when(F.col("id") % 3 == 0, "").otherwise(F.col("subcategory"))
    return v.entity.select("id", F.coalesce(F.nullif(modern, F.lit("")), "name").alias("display"))


@query(
    "p03_identification_line",
    "SELECT id, CASE WHEN category IN ('SMALL', 'MEDIUM') THEN name || ' (' || subcategory || ')' WHEN category = 'LARGE' THEN name || ', size ' || cnt WHEN category = 'PROMO' THEN subcategory ELSE name END AS line FROM entity",
)
def p03(v: Views) -> DataFrame:
    line = (
        F.when(F.col("category").isin("SMALL", "MEDIUM"), F.concat("name", F.lit(" ("), "subcategory", F.lit(")")))
        .when(F.col("category") == "LARGE", F.concat("name", F.lit(", size "), F.col("cnt").cast("string")))
        .when(F.col("category") == "PROMO", F.col("subcategory"))
        .otherwise(F.col("name"))
    )
    return v.entity.select("id", line.alias("line"))


@query(
    "p04_embedding_text",
    "SELECT cluster_id, canonical_name || ' | ' || lower(category) || ' | ' || array_to_string(list_sort(list(DISTINCT subcategory))[1:20], ', ') AS txt FROM member GROUP BY cluster_id, canonical_name, category",
)
def p04(v: Views) -> DataFrame:
    g = v.member.groupBy("cluster_id", "canonical_name", "category").agg(F.array_sort(F.collect_set("subcategory")).alias("n"))
    return g.select("cluster_id", F.concat_ws(" | ", "canonical_name", F.lower("category"), F.array_join(F.slice("n", 1, 20), ", ")).alias("txt"))


@query(
    "p05_search_metadata",
    "SELECT s.cluster_id, s.canonical_name AS display_name, s.category, s.book_count, s.total_mentions, array_to_string(list_sort(list(DISTINCT m.subcategory))[1:30], '|') AS names FROM stats s JOIN member m ON s.cluster_id = m.cluster_id GROUP BY ALL",
)
def p05(v: Views) -> DataFrame:
    n = v.member.groupBy("cluster_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("subcategory")), 1, 30), "|").alias("names"))
    return v.stats.join(n, "cluster_id").select("cluster_id", F.col("canonical_name").alias("display_name"), "category", "book_count", "total_mentions", "names")


@query(
    "p06_attestation",
    "SELECT a.book_id, a.entity_id, coalesce(e.name, 'unknown') AS local_name, a.cnt, '/books/' || a.book_id || '/entity/' || replace(e.name, ' ', '%20') AS path FROM att a LEFT JOIN entity e ON a.entity_id = e.id",
)
def p06(v: Views) -> DataFrame:
    j = v.att.join(v.entity.select("id", "name"), F.col("entity_id") == F.col("id"), "left")
    path = F.concat(F.lit("/books/"), F.col("book_id").cast("string"), F.lit("/entity/"), percent_encoded(F.col("name")))
    return j.select("book_id", "entity_id", F.coalesce("name", F.lit("unknown")).alias("local_name"), "cnt", path.alias("path"))


@query("p07_overview_fallback", "SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN name END, CASE WHEN id % 3 = 0 THEN subcategory END, category) AS overview FROM entity")
def p07(v: Views) -> DataFrame:
    parts = F.when(F.col("id") % 2 == 0, F.col("name")), F.when(F.col("id") % 3 == 0, F.col("subcategory")), F.col("category")
    return v.entity.select("id", F.coalesce(*parts).alias("overview"))


@query(
    "p08_search_url",
    ", w AS (SELECT p_partkey AS id, string_split(p_name || ' of ' || lower(p_type), ' ') AS w FROM part) SELECT id, '%22' || array_to_string(w[greatest((len(w) - 3) // 2 + 1, 1):greatest((len(w) - 3) // 2 + 1, 1) + 2], '%20') || '%22' AS q FROM w",
)
def p08(v: Views) -> DataFrame:
    return v.entity.select("id", search_phrase(F.concat("name", F.lit(" of "), F.lower("category"))).alias("q"))
