"""Joins (J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import char_jaccard
from ..operators import joins as ops
from ..operators.neighbours import all_cosines, nearest, nearest_queries, shared_counts, triangles
from .filters import _SIM
from .views import EDGE_FLOOR, Views, query

_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


def vectors(v: Views) -> DataFrame:
    """Vector entities: book_id, id, name, category, vector; every vector's name is a part's."""
    e = v.embeddings.select("vec_id", "embedding", "label")
    names = v.part.select("p_partkey", "p_name")
    return e.join(names, F.col("vec_id") == F.col("p_partkey")).select(
        (F.col("vec_id") % 5).alias("book_id"), F.col("vec_id").alias("id"), F.col("p_name").alias("name"), F.col("label").cast("string").alias("category"), F.col("embedding").alias("vector")
    )


_VEC = ", vec AS (SELECT vec_id % 5 AS book_id, vec_id AS id, p_name AS name, CAST(label AS VARCHAR) AS category, embedding AS vector FROM embeddings JOIN part ON vec_id = p_partkey)"


def _similar_sql(on: str, floor: float, least: float) -> str:
    pairs = f", p AS (SELECT a.id AS a, b.id AS b, a.name AS na, b.name AS nb, {_DOT.format(a='a.vector', b='b.vector')} AS dp FROM vec a JOIN vec b ON a.category = b.category AND {on})"
    sim = _SIM.format(a="na", b="nb", keep="a, b, dp", src="p")
    return _VEC + pairs + sim + f"SELECT a, b, round(dp, 6) AS sim, round(sim, 6) AS string_sim FROM simd WHERE dp >= {floor} - CASE WHEN sim > 0.5 THEN 0.05 ELSE 0 END AND sim >= {least}"


@query("j01_within_book", _similar_sql("a.book_id = b.book_id AND a.id < b.id", 0.25, 0.0))
def j01(v: Views) -> DataFrame:
    pairs = ops.similar_pairs(vectors(v), same_book=True, floor=0.25, person_floor=0.2, ease=0.05, least_string=0.0, guard=False)
    return pairs.select("a", "b", F.round("sim", 6).alias("sim"), F.round("string_sim", 6).alias("string_sim"))


@query("j02_cross_book", _similar_sql("a.book_id < b.book_id", 0.30, 0.0))
def j02(v: Views) -> DataFrame:
    pairs = ops.similar_across_books(vectors(v), floor=0.30, person_floor=0.25, ease=0.05)
    return pairs.select("a", "b", F.round("sim", 6).alias("sim"), F.round("string_sim", 6).alias("string_sim"))


_KNN = f"""
, s AS (SELECT vec_id AS id, embedding AS e, label FROM embeddings WHERE vec_id % 50 = 0), t AS (SELECT vec_id AS nbr, embedding AS e, label FROM embeddings)
, knn AS (SELECT id, nbr, s.label AS la, t.label AS lb, round({_DOT.format(a='s.e', b='t.e')}, 4) AS sim FROM s JOIN t ON id <> nbr)
, top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, nbr) AS rank FROM knn QUALIFY rank <= 10)
"""


def asked_and_rows(v: Views) -> tuple[DataFrame, DataFrame]:
    """The stated query set, every vector whose id is divisible by 50, and all vectors."""
    e = v.embeddings
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), "embedding", "label")
    return asked, e.select(F.col("vec_id").alias("nbr"), "embedding", F.col("label").alias("nbr_label"))


def top_neighbours(v: Views, k: int) -> DataFrame:
    return nearest(*asked_and_rows(v), "id", "nbr", "embedding", k)


@query("j03_knn_post_filter", _KNN + "SELECT id, nbr, sim, CAST(rank AS INTEGER) AS rank FROM top WHERE la = lb")
def j03(v: Views) -> DataFrame:
    asked, rows = asked_and_rows(v)
    named = top_neighbours(v, 10).join(asked.select("id", "label"), "id").join(rows.select("nbr", "nbr_label"), "nbr")
    return named.where("label = nbr_label").select("id", "nbr", "sim", "rank")


_BOTH = (
    _KNN
    + ", back AS (SELECT *, row_number() OVER (PARTITION BY nbr ORDER BY sim DESC, id) AS r2 FROM knn QUALIFY r2 <= 10)"
    ", both_ways AS (SELECT id, nbr, sim FROM (SELECT id, nbr, sim FROM top UNION ALL SELECT id, nbr, sim FROM back) QUALIFY row_number() OVER (PARTITION BY least(id, nbr), greatest(id, nbr) ORDER BY sim DESC, id, nbr) = 1)"
)


def _both_ways(v: Views) -> DataFrame:
    back = nearest_queries(*asked_and_rows(v), "id", "nbr", "embedding", 10).select("id", "nbr", "sim")
    union = top_neighbours(v, 10).select("id", "nbr", "sim").unionByName(back)
    return ops.best_unordered(union, "id", "nbr", "sim")


@query("j04_bidirectional_union", _BOTH + "SELECT id, nbr, sim FROM both_ways")
def j04(v: Views) -> DataFrame:
    return _both_ways(v)


@query("j05_greedy_matching")
def j05(v: Views) -> DataFrame:
    return ops.greedy_matching(_both_ways(v), "id", "nbr", "sim")


@query(
    "j06_outer_merge",
    ", a AS (SELECT entity_id, cnt FROM att WHERE book_id = 1), b AS (SELECT entity_id, cnt FROM att WHERE book_id = 2) SELECT coalesce(CAST(a.entity_id AS VARCHAR), 'book2_' || b.entity_id) AS key, coalesce(a.cnt, 0) + coalesce(b.cnt, 0) AS total, (a.cnt IS NOT NULL)::INT + (b.cnt IS NOT NULL)::INT AS book_count FROM a FULL OUTER JOIN b ON a.entity_id = b.entity_id",
)
def j06(v: Views) -> DataFrame:
    a = v.att.where("book_id = 1").select("entity_id", F.col("cnt").alias("ca"))
    b = v.att.where("book_id = 2").select(F.col("entity_id").alias("eb"), F.col("cnt").alias("cb"))
    j = a.join(b, F.col("entity_id") == F.col("eb"), "full")
    return j.select(
        F.coalesce(F.col("entity_id").cast("string"), F.concat(F.lit("book2_"), F.col("eb").cast("string"))).alias("key"),
        (F.coalesce("ca", F.lit(0)) + F.coalesce("cb", F.lit(0))).alias("total"),
        (F.col("ca").isNotNull().cast("int") + F.col("cb").isNotNull().cast("int")).alias("book_count"),
    )


@query(
    "j07_member_book",
    "SELECT a.entity_id, a.book_id, coalesce(b.title, 'Book ' || a.book_id) AS title, b.year FROM att a LEFT JOIN (SELECT * FROM book WHERE book_id % 2 = 0) b ON a.book_id = b.book_id",
)
def j07(v: Views) -> DataFrame:
    b = v.book.where("book_id % 2 = 0").select(F.col("book_id").alias("bid"), "title", "year")
    j = v.att.select("entity_id", "book_id").join(b, F.col("book_id") == F.col("bid"), "left")
    return j.select("entity_id", "book_id", F.coalesce("title", F.concat(F.lit("Book "), F.col("book_id").cast("string"))).alias("title"), "year")


@query("j08_singletons", "SELECT id FROM entity e WHERE NOT EXISTS (SELECT 1 FROM att a WHERE a.entity_id = e.id AND a.cnt >= 50)")
def j08(v: Views) -> DataFrame:
    members = v.att.where("cnt >= 50").select(F.col("entity_id").alias("id"))
    return ops.singletons(v.entity.select("id"), members, ["id"])


@query(
    "j09_entity_page",
    "SELECT e.id, b.title, b.year, a.cnt FROM entity e JOIN att a ON a.entity_id = e.id JOIN book b ON a.book_id = b.book_id WHERE e.name = 'red gear' ORDER BY b.year, b.title",
)
def j09(v: Views) -> DataFrame:
    e = v.entity.where("name = 'red gear'").select("id")
    j = e.join(v.att.select("entity_id", "book_id", "cnt"), F.col("id") == F.col("entity_id")).join(v.book, "book_id")
    return j.select("id", "title", "year", "cnt").orderBy("year", "title")


@query("j10_book_entities", "SELECT e.id, e.name, a.cnt FROM att a JOIN entity e ON a.entity_id = e.id WHERE a.book_id = 3 ORDER BY a.cnt DESC, e.id")
def j10(v: Views) -> DataFrame:
    j = v.att.where("book_id = 3").join(v.entity.select("id", "name"), F.col("entity_id") == F.col("id"))
    return j.select("id", "name", "cnt").orderBy(F.desc("cnt"), "id")


_ASK = ", ask AS (SELECT p_partkey AS q, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 2) ELSE split_part(p_name, ' ', 1) END AS slug FROM part)"


def _asked(v: Views) -> DataFrame:
    words = F.split("p_name", " ")
    slug = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, words[1]).otherwise(words[0])
    return v.part.select(F.col("p_partkey").alias("q"), slug.alias("slug"))


@query(
    "j11_slug_lookup",
    _ASK
    + ", full_names AS (SELECT name, min(id) AS id FROM entity GROUP BY 1), firsts AS (SELECT split_part(name, ' ', 1) AS name, min(id) AS id FROM entity GROUP BY 1) SELECT q, coalesce(f.id, g.id) AS id, CASE WHEN f.id IS NOT NULL THEN 1 WHEN g.id IS NOT NULL THEN 2 END AS tier FROM ask LEFT JOIN full_names f ON slug = f.name LEFT JOIN firsts g ON slug = g.name",
)
def j11(v: Views) -> DataFrame:
    full = v.entity.groupBy(F.col("name").alias("k")).agg(F.min("id").alias("id"))
    first = v.entity.groupBy(F.split("name", " ")[0].alias("k")).agg(F.min("id").alias("id"))
    a = _asked(v).join(full.select(F.col("k").alias("k1"), F.col("id").alias("v1")), F.col("slug") == F.col("k1"), "left")
    a = a.join(first.select(F.col("k").alias("k2"), F.col("id").alias("v2")), F.col("slug") == F.col("k2"), "left")
    tier = F.when(F.col("v1").isNotNull(), 1).when(F.col("v2").isNotNull(), 2)
    return a.select("q", F.coalesce("v1", "v2").alias("id"), tier.alias("tier"))


@query(
    "j12_id_remap",
    ", old AS (SELECT id, lower(name) AS k, category FROM entity WHERE id % 2 = 0), new AS (SELECT lower(name) AS k, category, max(id) AS nid FROM entity WHERE id % 2 = 1 GROUP BY 1, 2) SELECT old.id, nid FROM old JOIN new ON old.k = new.k AND old.category = new.category",
)
def j12(v: Views) -> DataFrame:
    old = v.entity.where("id % 2 = 0").select("id", F.lower("name").alias("k"), "category")
    new = v.entity.where("id % 2 = 1").groupBy(F.lower("name").alias("k"), "category").agg(F.max_by("id", "id").alias("nid"))
    return old.join(new, ["k", "category"]).select("id", "nid")


_SNAPSHOTS = """
, nc AS (SELECT cluster_id AS id, category, canonical_name AS name, CASE WHEN cluster_id % 5 = 0 THEN 'Q' || (cluster_id % 30) END AS wd, CASE WHEN cluster_id % 3 = 0 THEN split_part(canonical_name, ' ', 2) END AS modern, total_mentions AS m FROM stats)
, nm AS (SELECT cluster_id AS id, category, book_id, entity_id, [name, split_part(name, ' ', 2)] AS names FROM member)
, oc AS (SELECT min(id) AS id, category, subcategory, min(name) AS name, CASE WHEN min(id) % 4 = 0 THEN 'Q' || (min(id) % 30) END AS wd, CASE WHEN min(id) % 2 = 0 THEN max(name) END AS modern, min(id) % 3 <> 1 AS truth, CAST(sum(cnt) AS BIGINT) AS m FROM entity GROUP BY category, subcategory)
, om AS (SELECT o.id, e.category, a.book_id + CASE WHEN a.entity_id % 3 = 0 AND length(e.category) % 2 = 0 THEN 0 ELSE 1000000 END AS book_id, a.entity_id, [e.name, split_part(e.name, ' ', 1)] AS names FROM entity e JOIN oc o ON e.category = o.category AND e.subcategory = o.subcategory JOIN att a ON a.entity_id = e.id WHERE e.id % 7 <> 0)
"""
_ALIASES = """
, {c}n AS (SELECT DISTINCT id, category, book_id, entity_id, trim(regexp_replace(lower(unnest(names)), '[^a-z0-9]+', ' ', 'g')) AS n FROM {c}m)
, {c}a AS (SELECT id, category, n AS alias FROM {c}n WHERE n <> '' UNION SELECT id, category, lower(name) FROM {c}c UNION SELECT id, category, lower(modern) FROM {c}c WHERE modern IS NOT NULL)
"""
_MIGRATION = (
    _SNAPSHOTS
    + _ALIASES.format(c="n")
    + _ALIASES.format(c="o")
    + """
, s1 AS (SELECT n.id AS new_id, o.id AS old_id, 1000.0 AS score FROM nc n JOIN oc o ON n.wd = o.wd AND n.category = o.category AND o.truth QUALIFY row_number() OVER (PARTITION BY n.id ORDER BY o.m DESC, o.id) = 1)
, pts AS (SELECT n.id AS new_id, o.id AS old_id, 1 AS i, 0 AS k FROM nm n JOIN om o ON n.book_id = o.book_id AND n.entity_id = o.entity_id AND n.category = o.category
  UNION ALL SELECT n.id, o.id, 0, 1 FROM nn n JOIN xn o ON n.book_id = o.book_id AND n.n = o.n AND n.category = o.category WHERE n.n <> '')
, w AS (SELECT new_id, old_id, sum(i) AS i, sum(k) AS k, 3 * sum(i) + sum(k) AS w FROM pts GROUP BY 1, 2)
, t2 AS (SELECT w.* FROM w JOIN oc o ON o.id = old_id QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY w DESC, k DESC, i DESC, o.m DESC, old_id) = 1)
, sh AS (SELECT t2.new_id, count(*) AS x FROM t2 JOIN na a ON a.id = new_id JOIN xa b ON b.id = old_id AND a.alias = b.alias GROUP BY 1)
, cl AS (SELECT t2.new_id FROM t2 JOIN nc n ON n.id = new_id WHERE EXISTS (SELECT 1 FROM xa b WHERE b.id = old_id AND b.alias = lower(n.name)))
, s2 AS (SELECT t2.new_id, old_id, w + 0.1 * coalesce(x, 0) AS score FROM t2 LEFT JOIN sh ON sh.new_id = t2.new_id
  WHERE w >= 3 OR k >= 2 OR (k >= 1 AND i >= 1) OR (k = 1 AND coalesce(x, 0) >= 1 AND t2.new_id IN (SELECT new_id FROM cl)))
, s3 AS (SELECT new_id, old_id, 50.0 + c AS score FROM (SELECT a.id AS new_id, o.id AS old_id, count(*) AS c, any_value(o.m) AS m FROM na a JOIN oc o ON a.alias = lower(o.modern) AND a.category = o.category GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY c DESC, m DESC, old_id) = 1)
, s4 AS (SELECT new_id, old_id, 10.0 + c AS score FROM (SELECT a.id AS new_id, b.id AS old_id, count(*) AS c FROM na a JOIN xa b ON a.alias = b.alias AND a.category = b.category GROUP BY 1, 2) JOIN oc o ON o.id = old_id
  QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY c DESC, o.m DESC, old_id) = 1 AND c >= 2)
, prop AS (SELECT * FROM (SELECT 0 AS pri, 'wikidata' AS strategy, * FROM s1 UNION ALL SELECT 1, 'member_overlap', * FROM s2 UNION ALL SELECT 2, 'modern_name', * FROM s3 UNION ALL SELECT 3, 'alias_match', * FROM s4) QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY pri) = 1)
SELECT p.new_id, p.old_id, p.strategy, CAST(round(p.score, 6) AS DOUBLE) AS score FROM prop p JOIN oc o ON o.id = p.old_id AND o.truth JOIN nc n ON n.id = p.new_id
QUALIFY row_number() OVER (PARTITION BY p.old_id ORDER BY p.pri, round(p.score, 6) DESC, n.m DESC, p.new_id) = 1
"""
).replace(", on AS", ", xn AS").replace("FROM on WHERE", "FROM xn WHERE").replace(", oa AS", ", xa AS")


def _snapshots(v: Views) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """New and old clusters with their members; the old ones group the entities otherwise, and partly in other books."""
    word = lambda c, k: F.split(c, " ")[k]
    id = F.col("cluster_id")
    wd = lambda k: F.when(id % k == 0, F.concat(F.lit("Q"), (id % 30).cast("string")))
    new = v.stats.select(
        id, "category", "canonical_name", wd(5).alias("wikidata_id"), F.when(id % 3 == 0, word("canonical_name", 1)).alias("modern_name"), "total_mentions"
    )
    new_members = v.member.select(id, "book_id", "entity_id", F.array("name", word("name", 1)).alias("names"))
    g = v.entity.groupBy("category", "subcategory").agg(F.min("id").alias("cluster_id"), F.min("name").alias("canonical_name"), F.max("name").alias("last"), F.sum("cnt").cast("long").alias("total_mentions"))
    old = g.select(id, "category", "canonical_name", wd(4).alias("wikidata_id"), F.when(id % 2 == 0, F.col("last")).alias("modern_name"), "total_mentions", (id % 3 != 1).alias("has_truth"))
    of = v.entity.where("id % 7 <> 0").join(g.select("category", "subcategory", "cluster_id"), ["category", "subcategory"])
    a = v.att.select("book_id", F.col("entity_id"))
    book = F.col("book_id") + F.when((F.col("entity_id") % 3 == 0) & (F.length("category") % 2 == 0), 0).otherwise(1_000_000)
    old_members = of.join(a, F.col("id") == F.col("entity_id")).select(id, book.alias("book_id"), "entity_id", F.array("name", word("name", 0)).alias("names"))
    return new, new_members, old, old_members


@query("j13_migration", _MIGRATION)
def j13(v: Views) -> DataFrame:
    return ops.migration_matches(*_snapshots(v))


_FOUND = """
, ix AS (SELECT DISTINCT lower(canonical_name) AS k, cluster_id AS v FROM cluster UNION SELECT DISTINCT lower(subcategory), cluster_id FROM member)
, f AS (SELECT p_partkey AS id, lower(trim(CASE p_partkey % 6 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || '.,' WHEN 2 THEN replace(p_name, 's', 'ſ') WHEN 3 THEN replace(p_name, 'f', 'ƒ') WHEN 4 THEN ' ' || p_brand || '!' ELSE replace(replace(p_name, 's', 'ſ'), 'f', 'ƒ') END)) AS key FROM part)
, t AS (SELECT id, 1 AS tier, key AS form FROM f UNION ALL SELECT id, 2, regexp_replace(key, '[.,;:!?''"]+$', '') FROM f UNION ALL SELECT id, 3, replace(key, 'ſ', 's') FROM f UNION ALL SELECT id, 4, replace(key, 'ƒ', 'f') FROM f UNION ALL SELECT id, 5, replace(key, 'ﬁ', 'fi') FROM f UNION ALL SELECT id, 6, replace(key, 'ﬂ', 'fl') FROM f)
, ks AS (SELECT k, list(v ORDER BY v) AS vs FROM ix GROUP BY 1)
, hit AS (SELECT id, min(tier) AS tier FROM t JOIN ks ON form = k GROUP BY 1)
SELECT f.id, hit.tier, array_to_string(ks.vs, ',') AS clusters FROM f LEFT JOIN hit ON f.id = hit.id LEFT JOIN t ON t.id = f.id AND t.tier = hit.tier LEFT JOIN ks ON ks.k = t.form
"""


@query("j14_name_index", _FOUND)
def j14(v: Views) -> DataFrame:
    names = v.cluster.select(F.lower("canonical_name").alias("k"), F.col("cluster_id").alias("v"))
    names = names.unionByName(v.member.select(F.lower("subcategory").alias("k"), F.col("cluster_id").alias("v"))).distinct()
    ix = names.groupBy("k").agg(F.array_sort(F.collect_list("v")).alias("v"))
    kind, old = F.col("p_partkey") % 6, lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    found = F.when(kind == 0, F.upper("p_name")).when(kind == 1, F.concat("p_name", F.lit(".,"))).when(kind == 2, old(F.col("p_name"), "s", "ſ"))
    found = found.when(kind == 3, old(F.col("p_name"), "f", "ƒ")).when(kind == 4, F.concat(F.lit(" "), "p_brand", F.lit("!"))).otherwise(old(old(F.col("p_name"), "s", "ſ"), "f", "ƒ"))
    f = v.part.select(F.col("p_partkey").alias("id"), found.alias("found"))
    return ops.tiered_lookup(f, ix, ops.name_tiers(F.col("found")), "k", "v").select("id", "tier", F.array_join("v", ",").alias("clusters"))


@query(
    "j15_unambiguous_names",
    "SELECT name FROM (SELECT canonical_name AS name, cluster_id FROM cluster UNION ALL SELECT canonical_name || ' ' || subcategory, cluster_id FROM member) WHERE length(name) >= 4 GROUP BY name HAVING count(DISTINCT cluster_id) = 1",
)
def j15(v: Views) -> DataFrame:
    long = v.member.select(F.concat_ws(" ", "canonical_name", "subcategory").alias("name"), "cluster_id")
    g = v.cluster.select(F.col("canonical_name").alias("name"), "cluster_id").unionByName(long).where("length(name) >= 4").groupBy("name")
    # the smallest and the largest suffice: no list of a name's clusters
    return g.agg(F.min("cluster_id").alias("lo"), F.max("cluster_id").alias("hi")).where("lo = hi").select("name")


#: Names of several words and parts of names, with the cluster that each stands for.
_TERMS = [("the", 0), ("that", 1), ("une", 2), ("der", 3), ("para", 4), ("the and", 5), ("en la", 0), ("und der", 1), ("de", 2), ("de la", 3), ("la que", 4), ("of the", 5), ("and the", 0), ("der und", 2)]


@query(
    "j16_dictionary_tagging",
    f", dict(term, c) AS (VALUES {', '.join(map(str, _TERMS))})"
    r", pats AS (SELECT o.c AS own, '(?i)\b(' || string_agg(d.term, '|' ORDER BY length(d.term) DESC, d.term) || ')\b' AS p FROM (SELECT DISTINCT c FROM dict) o JOIN dict d ON d.c <> o.c GROUP BY 1)"
    ", hits AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, p))) AS term FROM documents JOIN pats ON own = doc_id % 6)"
    " SELECT doc_id, hits.term, c AS cluster, count(*) AS n FROM hits JOIN dict ON hits.term = dict.term GROUP BY 1, 2, 3",
)
def j16(v: Views) -> DataFrame:
    from ..operators.text import tag_terms

    docs = v.documents.select("doc_id", "text", (F.col("doc_id") % 6).cast("int").alias("own"))
    tagged = tag_terms(docs, v.spark.createDataFrame(_TERMS, "term string, value int"), exclude="own")
    return tagged.groupBy("doc_id", "term", F.col("value").alias("cluster")).agg(F.count("*").alias("n"))


_CITED = r"""
, words AS (SELECT w AS person, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS w FROM benchmark) WHERE length(w) >= 3 GROUP BY 1)
, top AS (SELECT person, row_number() OVER (ORDER BY n DESC, person) AS r, '(?i)(^|[^\p{L}\p{N}_])(' || person || ')($|[^\p{L}\p{N}_])' AS p FROM words ORDER BY n DESC, person LIMIT 60)
, ex AS (SELECT person, r, item_id, text FROM benchmark JOIN top ON regexp_matches(text, p))
, hits AS (SELECT least(ex.person, o.person) AS source, greatest(ex.person, o.person) AS target, ex.r, item_id FROM ex JOIN top o ON ex.person <> o.person AND regexp_matches(text, o.p))
SELECT source, target, count(*) AS weight, array_to_string(list(item_id ORDER BY r, item_id)[1:3], ',') AS samples FROM hits GROUP BY 1, 2
"""


@query("j17_co_citation", _CITED)
def j17(v: Views) -> DataFrame:
    words = v.benchmark.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("person")).where("length(person) >= 3")
    persons = words.groupBy("person").count().withColumn("name", F.col("person")).withColumn("aliases", F.array(F.initcap("person")))
    patterns = ops.person_patterns(persons.withColumn("variants", F.lit(None).cast("array<string>")))
    named = patterns.orderBy(F.desc("count"), "person").limit(60).select("person", "pattern")
    # the excerpts of a person are the items that name it; the sample shown is the item's number
    ex = v.benchmark.join(F.broadcast(named), F.expr("text rlike pattern")).select("person", F.col("item_id").alias("pos"), "text")
    numbered = v.benchmark.groupBy("text").agg(F.min("item_id").alias("no"))
    edges = ops.co_citations(ex, patterns)
    shown = edges.select("source", "target", "weight", F.posexplode("excerpts").alias("k", "text")).join(numbered, "text")
    samples = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "no"))), lambda s: s["no"].cast("string")), ",")
    return shown.groupBy("source", "target", "weight").agg(samples.alias("samples"))


_FOLD = "trim(regexp_replace(strip_accents(replace(replace(replace(lower({}), 'ſ', 's'), 'ﬁ', 'fi'), 'ﬂ', 'fl')), '\\s+', ' ', 'g'))"
_EXCERPTS = """
, w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)
, ask AS (SELECT 10 * item_id AS id, text FROM benchmark UNION ALL SELECT 10 * item_id + 1, array_to_string(w[1:5], ' ') || ' zz zz zz zz zz zz zz' FROM w
  UNION ALL SELECT 10 * item_id + 2, 'zz zz zz zz zz zz zz ' || array_to_string(w[-5:], ' ') FROM w UNION ALL SELECT 10 * item_id + 3, array_to_string(w[3:8], ' ') FROM w
  UNION ALL SELECT 10 * item_id + 4, array_to_string(w[4:5], ' ') FROM w UNION ALL SELECT 10 * item_id + 5, array_to_string(w[6:8], ' ') FROM w)
"""


def _excerpts(v: Views) -> DataFrame:
    """Whole items, items of which only one end stands on a page, and short ones."""
    w, zz = F.split("text", " "), "zz zz zz zz zz zz zz"
    part = lambda at, n: F.array_join(F.slice(w, at, n), " ")
    kinds = [F.col("text"), F.concat(part(1, 5), F.lit(" " + zz)), F.concat(F.lit(zz + " "), part(-5, 5)), part(3, 6), part(4, 2), part(6, 3)]
    return v.benchmark.select("item_id", F.posexplode(F.array(*kinds)).alias("k", "text")).select((10 * F.col("item_id") + F.col("k")).alias("id"), "text")


@query(
    "j18_excerpt_page",
    _EXCERPTS
    + f", a AS (SELECT id, {_FOLD.format('text')} AS t, string_split({_FOLD.format('text')}, ' ') AS w FROM ask), p AS (SELECT doc_id, {_FOLD.format('text')} AS t FROM documents)"
    + """
, chunk AS (SELECT id, 1 AS tier, array_to_string(CASE WHEN len(w) >= 8 THEN w[len(w) // 2 - 2 : len(w) // 2 + 3] WHEN len(w) >= 4 THEN w[2 : least(5, len(w))] ELSE w END, ' ') AS c FROM a WHERE length(t) >= 15
  UNION ALL SELECT id, 2, array_to_string(w[1:5], ' ') FROM a WHERE length(t) >= 15 AND len(w) >= 5 UNION ALL SELECT id, 3, array_to_string(w[-5:], ' ') FROM a WHERE length(t) >= 15 AND len(w) >= 5)
, hit AS (SELECT id, tier, min(doc_id) AS page FROM chunk JOIN p ON length(t) > 10 AND contains(t, c) GROUP BY 1, 2)
SELECT id, CAST(tier AS INTEGER) AS tier, page FROM hit QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier) = 1
""",
)
def j18(v: Views) -> DataFrame:
    from ..operators.text import containing_page

    return containing_page(_excerpts(v), v.documents.select(F.col("doc_id").alias("page"), "text"), "id")


@query("j19_leaf_page", "SELECT a.entity_id, a.book_id, b.year AS printed FROM att a LEFT JOIN book b ON a.book_id = b.book_id")
def j19(v: Views) -> DataFrame:
    b = v.book.select("book_id", F.col("year").alias("printed"))
    return v.att.select("entity_id", "book_id").join(b, "book_id", "left")


@query(
    "j20_label_validation",
    ", t AS (SELECT id, lower(name) AS n, lower(subcategory) AS s, lower(category) AS c FROM entity) SELECT id, (n = c OR contains(n, c) OR contains(c, n) OR len(list_intersect(list_distinct(string_split(n, '')), list_distinct(string_split(c, '')))) / len(list_distinct(list_concat(string_split(n, ''), string_split(c, '')))) > 0.4) AS valid FROM t",
)
def j20(v: Views) -> DataFrame:
    n, c = F.lower("name"), F.lower("category")
    return v.entity.select("id", ((n == c) | n.contains(c) | c.contains(n) | (char_jaccard(n, c) > 0.4)).alias("valid"))


@query("j21_first_match", "SELECT e.id, min(c.cluster_id) AS cluster_id FROM entity e LEFT JOIN cluster c ON e.name = c.canonical_name GROUP BY e.id")
def j21(v: Views) -> DataFrame:
    first = v.cluster.groupBy("canonical_name").agg(F.min("cluster_id").alias("cluster_id"))
    return v.entity.select("id", "name").join(first, F.col("name") == F.col("canonical_name"), "left").select("id", "cluster_id")


@query(
    "j22_variant_pruning",
    ", m AS (SELECT cluster_id, list_sort(list(DISTINCT subcategory)) AS vs FROM member GROUP BY 1), clean AS (SELECT list(DISTINCT subcategory) AS ok FROM entity WHERE cnt >= 49) SELECT cluster_id, array_to_string(list_filter(vs, lambda x: list_contains(ok, x)), ',') AS variants FROM m, clean",
)
def j22(v: Views) -> DataFrame:
    clean = v.entity.where("cnt >= 49").agg(F.collect_set("subcategory").alias("ok"))  # the distinct brands
    m = v.member.groupBy("cluster_id").agg(F.array_sort(F.collect_set("subcategory")).alias("vs"))
    kept = F.filter("vs", lambda x: F.array_contains("ok", x))
    return m.crossJoin(F.broadcast(clean)).select("cluster_id", F.array_join(kept, ",").alias("variants"))


@query(
    "j23_curated_match",
    ", cur AS (SELECT category, name, min(id) AS pos FROM entity WHERE id % 5 = 0 GROUP BY 1, 2), byname AS (SELECT name, min(pos) AS pos FROM cur GROUP BY 1) SELECT e.id, coalesce(a.pos, b.pos) AS pos FROM entity e LEFT JOIN cur a ON e.category = a.category AND e.name = a.name LEFT JOIN byname b ON e.name = b.name",
)
def j23(v: Views) -> DataFrame:
    cur = v.entity.where("id % 5 = 0").groupBy("category", "name").agg(F.min("id").alias("p1"))
    by_name = cur.groupBy("name").agg(F.min("p1").alias("p2"))
    j = v.entity.select("id", "category", "name").join(cur, ["category", "name"], "left").join(by_name, "name", "left")
    return j.select("id", F.coalesce("p1", "p2").alias("pos"))


_WC = ", m AS (SELECT DISTINCT cnt AS cluster_id, id % 7 AS book_id, name FROM entity)"


def _by_size(v: Views) -> DataFrame:
    return v.entity.select(F.col("cnt").alias("cluster_id"), (F.col("id") % 7).alias("book_id"), "name").distinct()


@query(
    "j24_within_cluster_pairs",
    _WC + "SELECT DISTINCT least(a.name, b.name) AS name_a, greatest(a.name, b.name) AS name_b FROM m a JOIN m b ON a.cluster_id = b.cluster_id AND a.book_id < b.book_id AND a.name <> b.name",
)
def j24(v: Views) -> DataFrame:
    return ops.within_cluster_pairs(_by_size(v))


@query(
    "j25_hard_negatives",
    ", n AS (SELECT canonical_name AS name, cluster_id, category, substr(lower(canonical_name), 1, 3) AS p FROM cluster), j AS (SELECT a.name AS name_a, b.name AS name_b, a.cluster_id AS cluster_id_a, b.cluster_id AS cluster_id_b, round(levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)), 6) AS dist, a.category = b.category AS same FROM n a JOIN n b ON a.p = b.p AND a.cluster_id < b.cluster_id) SELECT name_a, name_b, cluster_id_a, cluster_id_b, dist, round((1 - dist) * CASE WHEN same THEN 1.2 ELSE 1.0 END, 6) AS score FROM j WHERE dist BETWEEN 0.12 AND 0.45 AND NOT contains(name_a, name_b) AND NOT contains(name_b, name_a)",
)
def j25(v: Views) -> DataFrame:
    return ops.hard_negatives(v.cluster.select(F.col("canonical_name").alias("name"), "cluster_id", "category"))


@query(
    "j26_shared_books",
    ", m AS (SELECT DISTINCT cluster_id, book_id, category FROM member) SELECT a.book_id AS book_a, b.book_id AS book_b, count(*) AS shared, count(*) FILTER (a.category = 'PROMO') AS promo FROM m a JOIN m b ON a.cluster_id = b.cluster_id AND a.book_id < b.book_id GROUP BY 1, 2",
)
def j26(v: Views) -> DataFrame:
    m = v.member.select("cluster_id", "book_id", "category").distinct()
    found = shared_counts(m, "book_id", "cluster_id", "category", "PROMO")
    return found.select(F.col("x").alias("book_a"), F.col("y").alias("book_b"), "shared", F.col("special").alias("promo"))


_NN = ", k AS (SELECT a AS id, b AS nbr, sim FROM edge UNION ALL SELECT b, a, sim FROM edge)"


def _neighbours(v: Views) -> DataFrame:
    e = v.edge
    return e.select(F.col("a").alias("id"), F.col("b").alias("nbr"), "sim").unionByName(e.select(F.col("b").alias("id"), F.col("a").alias("nbr"), "sim"))


@query(
    "j27_neighbour_links",
    _NN + "SELECT DISTINCT x.id, least(x.nbr, y.nbr) AS a, greatest(x.nbr, y.nbr) AS b FROM k x JOIN k y ON x.id = y.id AND x.nbr < y.nbr JOIN edge e ON e.a = x.nbr AND e.b = y.nbr WHERE e.sim > 0.3",
)
def j27(v: Views) -> DataFrame:
    if not v.embeddings.where("vec_id is not null").groupBy("vec_id").count().where("count > 1").limit(1).count():
        return triangles(v.embeddings, "vec_id", "embedding", "label", EDGE_FLOOR, 0.3)
    # an id of several vectors has edges in several blocks
    k = _neighbours(v).select("id", "nbr")
    pairs = k.join(k.select("id", F.col("nbr").alias("nbr2")), "id").where("nbr < nbr2")
    links = v.edge.where("sim > 0.3").select(F.col("a").alias("nbr"), F.col("b").alias("nbr2"))
    return pairs.join(links, ["nbr", "nbr2"], "left_semi").select("id", F.col("nbr").alias("a"), F.col("nbr2").alias("b")).distinct()


@query("j28_ego_network", "SELECT a, b, sim FROM edge WHERE a = (SELECT min(a) FROM edge) OR b = (SELECT min(a) FROM edge)")
def j28(v: Views) -> DataFrame:
    ego = v.edge.agg(F.min("a").alias("ego"))
    return v.edge.join(F.broadcast(ego), (F.col("a") == F.col("ego")) | (F.col("b") == F.col("ego"))).select("a", "b", "sim")


@query(
    "j29_alias_resolution",
    "SELECT id, CASE WHEN name = 'red gear' THEN 'crimson gear' WHEN name = 'old bolt' THEN 'bolt' ELSE name END AS person FROM entity WHERE name NOT IN ('hot rod')",
)
def j29(v: Views) -> DataFrame:
    alias = v.spark.createDataFrame([("red gear", "crimson gear"), ("old bolt", "bolt")], "alias string, person string")
    left = v.entity.join(v.spark.createDataFrame([("hot rod",)], "name string"), "name", "left_anti")
    j = left.join(F.broadcast(alias), F.col("name") == F.col("alias"), "left")
    return j.select("id", F.coalesce("person", "name").alias("person"))


@query(
    "j30_registry_scores",
    ", s AS (SELECT lower(canonical_name) AS k, max(book_count) AS score FROM stats GROUP BY 1) SELECT e.id, coalesce(a.score, b.score, 0) AS score FROM entity e LEFT JOIN s a ON lower(e.subcategory) = a.k LEFT JOIN s b ON lower(e.name) = b.k",
)
def j30(v: Views) -> DataFrame:
    s = v.stats.groupBy(F.lower("canonical_name").alias("k")).agg(F.max("book_count").alias("score"))
    a, b = s.select(F.col("k").alias("ka"), F.col("score").alias("sa")), s.select(F.col("k").alias("kb"), F.col("score").alias("sb"))
    j = v.entity.join(a, F.lower("subcategory") == F.col("ka"), "left").join(b, F.lower("name") == F.col("kb"), "left")
    return j.select("id", F.coalesce("sa", "sb", F.lit(0)).alias("score"))


@query("j31_citation_validation", "SELECT id FROM entity WHERE id IN (SELECT entity_id FROM att WHERE cnt >= 80) ORDER BY id LIMIT 8")
def j31(v: Views) -> DataFrame:
    cited = v.att.where("cnt >= 80").select(F.col("entity_id").alias("id"))
    return v.entity.select("id").join(cited, "id", "left_semi").orderBy("id").limit(8)


@query(
    "j32_near_duplicate_clusters",
    ", c AS (SELECT cluster_id, canonical_name AS n, category, list(DISTINCT book_id) AS books FROM member GROUP BY 1, 2, 3) SELECT a.cluster_id AS a, b.cluster_id AS b, round(1 - levenshtein(a.n, b.n) / greatest(length(a.n), length(b.n)), 6) AS sim FROM c a JOIN c b ON a.category = b.category AND a.cluster_id < b.cluster_id WHERE round(1 - levenshtein(a.n, b.n) / greatest(length(a.n), length(b.n)), 6) >= 0.7 AND len(list_intersect(a.books, b.books)) > 0",
)
def j32(v: Views) -> DataFrame:
    c = v.member.groupBy("cluster_id", "canonical_name", "category").agg(F.collect_set("book_id").alias("books"), F.collect_set("name").alias("names"))
    return ops.near_duplicate_clusters(c, floor=0.7, place_floor=0.75)


@query(
    "j33_key_merges",
    "SELECT category, canonical_name AS k, arg_max(cluster_id, total_mentions * 100000 - cluster_id) AS primary_id, count(*) AS merged FROM (SELECT category, split_part(canonical_name, ' ', 2) AS canonical_name, cluster_id, total_mentions FROM stats) GROUP BY 1, 2",
)
def j33(v: Views) -> DataFrame:
    s = v.stats.withColumn("k", F.split("canonical_name", " ")[1])
    lead = F.max_by("cluster_id", F.struct("total_mentions", -F.col("cluster_id")))
    return s.groupBy("category", "k").agg(lead.alias("primary_id"), F.count("*").alias("merged"))


@query(
    "j34_full_cosine",
    f"SELECT a.vec_id AS a, b.vec_id AS b, round({_DOT.format(a='a.embedding', b='b.embedding')} / (sqrt({_DOT.format(a='a.embedding', b='a.embedding')}) * sqrt({_DOT.format(a='b.embedding', b='b.embedding')})), 5) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0",
)
def j34(v: Views) -> DataFrame:
    # a stated query set against all rows
    a = v.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    b = v.embeddings.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return all_cosines(a, b, "a", "b", "x", "y")


@query(
    "j35_expert_labels",
    "SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'REVIEW' WHEN l.quality = (d.n_chars > 500)::INT THEN 'AGREE' ELSE 'DISAGREE' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def j35(v: Views) -> DataFrame:
    l = v.labels.select(F.col("doc_id").alias("lid"), "quality")  # noqa: E741
    j = v.documents.select("doc_id", "n_chars").join(l, F.col("doc_id") == F.col("lid"), "left")
    agree = F.col("quality") == (F.col("n_chars") > 500).cast("int")
    return j.select("doc_id", F.when(F.col("quality").isNull(), "REVIEW").when(agree, "AGREE").otherwise("DISAGREE").alias("status"))


@query("j36_pair_lookup", "SELECT p.a, p.b, e.sim FROM (SELECT a, b FROM edge UNION ALL SELECT a, b + 1 FROM edge) p LEFT JOIN edge e ON p.a = e.a AND p.b = e.b")
def j36(v: Views) -> DataFrame:
    e = v.edge.select("a", "b")
    asked = e.unionByName(e.select("a", (F.col("b") + 1).alias("b")))
    return asked.join(v.edge.select("a", "b", "sim"), ["a", "b"], "left")


@query(
    "j37_marked_excerpts",
    ", x AS (SELECT conv_id, turn, text, substr(text, 1, 100) AS k FROM conversations WHERE length(text) >= 80 AND regexp_matches(lower(text), '(^|[^\\p{L}])(the|que|und)([^\\p{L}]|$)')) SELECT conv_id, turn FROM x QUALIFY row_number() OVER (PARTITION BY k ORDER BY conv_id, turn) = 1",
)
def j37(v: Views) -> DataFrame:
    x = v.conversations.where((F.length("text") >= 80) & F.lower("text").rlike(r"(^|[^\p{L}])(the|que|und)([^\p{L}]|$)"))
    order = Window.partitionBy(F.substring("text", 1, 100)).orderBy("conv_id", "turn")
    return x.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("conv_id", "turn")


@query("j38_load_by_id", "SELECT book_id, title, language, year FROM book WHERE book_id = 42")
def j38(v: Views) -> DataFrame:
    return v.book.where("book_id = 42")
