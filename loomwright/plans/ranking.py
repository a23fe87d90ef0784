"""Ranking (W), sorts and paging (L), set operations (U)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ranking as ops
from ..operators.aggregates import dedupe_best
from .joins import _DOT, _KNN, top_neighbours
from .views import Views, query


@query(
    "w01_top_k_neighbours",
    f", k AS (SELECT a.vec_id AS id, b.vec_id AS nbr, round({_DOT.format(a='a.embedding', b='b.embedding')}, 4) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0) SELECT id, nbr, sim, CAST(row_number() OVER (PARTITION BY id ORDER BY sim DESC, nbr) AS INTEGER) AS rank FROM k QUALIFY rank <= 15",
)
def w01(v: Views) -> DataFrame:
    return top_neighbours(v, 15)


@query(
    "w02_top_per_book_category",
    "SELECT book_id, category, cluster_id, CAST(row_number() OVER (PARTITION BY book_id, category ORDER BY t DESC, cluster_id) AS INTEGER) AS rank FROM (SELECT book_id, category, cluster_id, sum(cnt) AS t FROM member GROUP BY 1, 2, 3) QUALIFY rank <= 3",
)
def w02(v: Views) -> DataFrame:
    t = v.member.groupBy("book_id", "category", "cluster_id").agg(F.sum("cnt").alias("t"))
    return ops.top_per_group(t, ["book_id", "category"], [F.desc("t"), F.col("cluster_id")], 3).drop("t")


@query(
    "w03_top_per_category",
    "SELECT category, cluster_id, count(*) OVER (PARTITION BY category) AS group_size, CAST(row_number() OVER (PARTITION BY category ORDER BY total_mentions DESC, cluster_id) AS INTEGER) AS rank FROM stats QUALIFY rank <= 8",
)
def w03(v: Views) -> DataFrame:
    s = v.stats.withColumn("group_size", F.count("*").over(Window.partitionBy("category")))
    return ops.top_per_group(s, ["category"], [F.desc("total_mentions"), F.col("cluster_id")], 8).select("category", "cluster_id", "group_size", "rank")


@query("w04_max_member", "SELECT cluster_id, book_id, entity_id, cnt FROM member QUALIFY row_number() OVER (PARTITION BY cluster_id, book_id ORDER BY cnt DESC, entity_id) = 1")
def w04(v: Views) -> DataFrame:
    return ops.top_per_group(v.member, ["cluster_id", "book_id"], [F.desc("cnt"), F.col("entity_id")], 1).select("cluster_id", "book_id", "entity_id", "cnt")


@query("w05_top_pairs", "SELECT a, b, category, sim FROM (SELECT * FROM edge QUALIFY row_number() OVER (PARTITION BY category ORDER BY sim DESC, a, b) <= 5) ORDER BY sim DESC, a, b LIMIT 20")
def w05(v: Views) -> DataFrame:
    top = ops.top_per_group(v.edge, ["category"], [F.desc("sim"), F.col("a"), F.col("b")], 5).drop("rank")
    return top.orderBy(F.desc("sim"), "a", "b").limit(20)


@query("w06_keep_first", "SELECT a, b, sim FROM edge QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) = 1")
def w06(v: Views) -> DataFrame:
    return dedupe_best(v.edge, [F.col("a")], [F.desc("sim"), F.col("b")]).select("a", "b", "sim")


@query("w07_duplicate_suffix", "SELECT id, CASE WHEN row_number() OVER (PARTITION BY name ORDER BY id) > 1 THEN name || '-' || row_number() OVER (PARTITION BY name ORDER BY id) ELSE name END AS k FROM entity")
def w07(v: Views) -> DataFrame:
    return ops.suffixed(v.entity, "name", [F.col("id")], "k").select("id", "k")


@query("w08_global_rank", "SELECT cluster_id, row_number() OVER (ORDER BY book_count DESC, total_mentions DESC, cluster_id) AS rank_id FROM stats")
def w08(v: Views) -> DataFrame:
    return ops.global_rank(v.stats, [F.desc("book_count"), F.desc("total_mentions"), F.col("cluster_id")], "rank_id").select("cluster_id", "rank_id")


@query("w09_allocated_slugs")
def w09(v: Views) -> DataFrame:
    e = v.entity.select("id", F.replace("name", F.lit(" "), F.lit("-")).alias("base"), F.lower("category").alias("category"), F.lower(F.replace("subcategory", F.lit("#"), F.lit(""))).alias("hint"))
    return ops.allocate_slugs(e, "base", "category", "hint", ["id"]).select("id", "slug")


@query("w10_collision_slug", "SELECT cluster_id, CASE WHEN count(*) OVER (PARTITION BY canonical_name) > 1 THEN replace(canonical_name, ' ', '-') || '-' || cluster_id ELSE replace(canonical_name, ' ', '-') END AS slug FROM cluster")
def w10(v: Views) -> DataFrame:
    c = v.cluster.withColumn("base", F.replace("canonical_name", F.lit(" "), F.lit("-")))
    return ops.collision_suffix(c, "base", "cluster_id", "slug").select("cluster_id", "slug")


@query("w11_id_uniquifier", "SELECT id, replace(name, ' ', '_') || CASE WHEN row_number() OVER (PARTITION BY name ORDER BY id) > 1 THEN '_' || row_number() OVER (PARTITION BY name ORDER BY id) ELSE '' END AS uid FROM entity")
def w11(v: Views) -> DataFrame:
    e = v.entity.withColumn("base", F.replace("name", F.lit(" "), F.lit("_")))
    return ops.suffixed(e, "base", [F.col("id")], "uid", "_").select("id", "uid")


@query("w12_prev_next", "SELECT id, lag(id) OVER (PARTITION BY category ORDER BY id) AS prev, lead(id) OVER (PARTITION BY category ORDER BY id) AS next FROM entity")
def w12(v: Views) -> DataFrame:
    w = Window.partitionBy("category").orderBy("id")
    return v.entity.select("id", F.lag("id").over(w).alias("prev"), F.lead("id").over(w).alias("next"))


@query("w13_first_k", "SELECT category, array_to_string(list(name ORDER BY id)[1:5], ',') AS names FROM entity GROUP BY 1")
def w13(v: Views) -> DataFrame:
    return ops.first_k(v.entity, ["category"], [F.col("id")], F.col("name"), 5, "names").withColumn("names", F.array_join("names", ","))


@query(
    "w14_connected_or_top",
    "SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT a FROM edge UNION SELECT b FROM edge) OR vec_id IN (SELECT vec_id FROM embeddings ORDER BY label DESC, vec_id LIMIT 20)",
)
def w14(v: Views) -> DataFrame:
    ends = v.edge.select(F.explode(F.array("a", "b")).alias("vec_id"))
    top = v.embeddings.orderBy(F.desc("label"), "vec_id").limit(20).select("vec_id")
    return v.embeddings.select("vec_id").join(ends.unionByName(top).distinct(), "vec_id", "left_semi")


@query("w15_best_result", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def w15(v: Views) -> DataFrame:
    return dedupe_best(v.orders, [F.col("o_custkey")], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query(
    "w16_diverse_sample",
    ", r AS (SELECT id, category, (id * 7919) % 1009 AS k, row_number() OVER (PARTITION BY category ORDER BY (id * 7919) % 1009, id) AS rn FROM entity) SELECT id, category FROM r ORDER BY (rn > 1)::INT, k, id LIMIT 8",
)
def w16(v: Views) -> DataFrame:
    e = v.entity.withColumn("k", F.struct((F.col("id") * 7919 % 1009).alias("k"), "id"))
    return ops.diverse_sample(e, "category", F.col("k"), 8).select("id", "category")


@query("w17_related_clusters", _KNN + "SELECT id, nbr, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= 8 AND nbr IN (SELECT vec_id FROM embeddings WHERE label <> 3)")
def w17(v: Views) -> DataFrame:
    alive = v.embeddings.where("label <> 3").select(F.col("vec_id").alias("nbr"))
    return top_neighbours(v, 8).join(alive, "nbr", "left_semi").select("id", "nbr", "rank")


@query("l01_browse_order", "SELECT cluster_id FROM stats ORDER BY book_count DESC, total_mentions DESC, canonical_name, cluster_id LIMIT 60")
def l01(v: Views) -> DataFrame:
    order = [F.desc("book_count"), F.desc("total_mentions"), F.collate("canonical_name", "UNICODE"), F.col("cluster_id")]
    return v.stats.orderBy(*order).limit(60).select("cluster_id")


@query("l02_relevance_order", "SELECT cluster_id, round(length(canonical_name) / 20, 6) AS score FROM stats ORDER BY score DESC, total_mentions DESC, cluster_id LIMIT 25")
def l02(v: Views) -> DataFrame:
    scored = v.stats.withColumn("score", F.round(F.length("canonical_name") / 20, 6))
    return scored.orderBy(F.desc("score"), F.desc("total_mentions"), "cluster_id").limit(25).select("cluster_id", "score")


@query("l03_alphabetical", "SELECT cluster_id, canonical_name FROM stats ORDER BY canonical_name, cluster_id LIMIT 50")
def l03(v: Views) -> DataFrame:
    return v.stats.orderBy(F.collate("canonical_name", "UNICODE"), "cluster_id").limit(50).select("cluster_id", "canonical_name")


@query("l04_paging", "SELECT id, (SELECT count(*) FROM entity) AS total, (SELECT greatest(CAST(ceil(count(*) / 40.0) AS BIGINT), 1) FROM entity) AS total_pages FROM entity ORDER BY id LIMIT 40 OFFSET 80")
def l04(v: Views) -> DataFrame:
    return ops.page(v.entity.select("id"), [F.col("id")], number=3, size=40).crossJoin(F.broadcast(ops.page_count(v.entity, 40)))


@query("l05_attestation_paging", "SELECT a.book_id, a.entity_id, a.cnt, b.year FROM att a JOIN book b ON a.book_id = b.book_id WHERE a.entity_id = 11 ORDER BY a.cnt DESC, b.year, a.book_id LIMIT 20")
def l05(v: Views) -> DataFrame:
    j = v.att.where("entity_id = 11").select("book_id", "entity_id", "cnt").join(v.book.select("book_id", "year"), "book_id")
    return ops.page(j, [F.desc("cnt"), F.col("year"), F.col("book_id")], 1, 20)


@query("l06_top_n", "SELECT a, b, sim FROM edge ORDER BY sim DESC, a, b LIMIT 20")
def l06(v: Views) -> DataFrame:
    return v.edge.orderBy(F.desc("sim"), "a", "b").limit(20).select("a", "b", "sim")


@query("l07_show_more", "SELECT cluster_id FROM stats ORDER BY cluster_id LIMIT 100")
def l07(v: Views) -> DataFrame:
    return v.stats.orderBy("cluster_id").limit(100).select("cluster_id")


@query("l08_books_by_key", "SELECT book_id, year FROM book ORDER BY year, book_id LIMIT 30")
def l08(v: Views) -> DataFrame:
    return v.book.orderBy("year", "book_id").limit(30).select("book_id", "year")


@query("l09_top_matches", "SELECT a, b FROM edge ORDER BY sim DESC, a, b LIMIT 50")
def l09(v: Views) -> DataFrame:
    return v.edge.orderBy(F.desc("sim"), "a", "b").limit(50).select("a", "b")


@query("l10_cluster_view", "SELECT cluster_id, canonical_name, book_count FROM stats WHERE book_count >= 2 ORDER BY book_count DESC, total_mentions DESC, cluster_id")
def l10(v: Views) -> DataFrame:
    return v.stats.where("book_count >= 2").orderBy(F.desc("book_count"), F.desc("total_mentions"), "cluster_id").select("cluster_id", "canonical_name", "book_count")


@query("l11_top_connections", "SELECT n, count(*) AS degree FROM (SELECT a AS n FROM edge UNION ALL SELECT b FROM edge) GROUP BY 1 ORDER BY degree DESC, n LIMIT 15")
def l11(v: Views) -> DataFrame:
    return v.edge.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "n").limit(15)


@query("u01_union_dedupe", "SELECT DISTINCT book_id, entity_id FROM (SELECT book_id, entity_id FROM att WHERE cnt > 30 UNION ALL SELECT book_id, entity_id FROM att WHERE year = 1995)")
def u01(v: Views) -> DataFrame:
    a = v.att
    return a.where("cnt > 30").select("book_id", "entity_id").unionByName(a.where("year = 1995").select("book_id", "entity_id")).dropDuplicates()


_SETS = ", s AS (SELECT category, list(DISTINCT name) FILTER (cnt < 20) AS x, list(DISTINCT name) FILTER (cnt > 35) AS y FROM entity GROUP BY 1)"


def _two_sets(v: Views) -> DataFrame:
    return v.entity.groupBy("category").agg(
        F.collect_set(F.when(F.col("cnt") < 20, F.col("name"))).alias("x"), F.collect_set(F.when(F.col("cnt") > 35, F.col("name"))).alias("y")
    )


@query("u02_variant_union", _SETS + "SELECT category, CAST(len(list_distinct(list_concat(x, y))) AS INTEGER) AS n FROM s")
def u02(v: Views) -> DataFrame:
    return _two_sets(v).select("category", F.size(F.array_union("x", "y")).alias("n"))


@query("u03_intersect", _SETS + "SELECT category, array_to_string(list_sort(list_intersect(x, y)), ',') AS shared FROM s")
def u03(v: Views) -> DataFrame:
    return _two_sets(v).select("category", F.array_join(F.array_sort(F.array_intersect("x", "y")), ",").alias("shared"))


@query("u04_difference", "SELECT name FROM entity WHERE category = 'SMALL' AND cnt < 10 EXCEPT SELECT name FROM entity WHERE category = 'LARGE' AND cnt < 10")
def u04(v: Views) -> DataFrame:
    e = v.entity.where("cnt < 10")
    return e.where("category = 'SMALL'").select("name").subtract(e.where("category = 'LARGE'").select("name"))


@query(
    "u05_curated_first",
    ", p AS (SELECT 0 AS pri, a, b, CAST(1 AS DOUBLE) AS s FROM edge WHERE (a + b) % 4 = 0 UNION ALL SELECT 1, b, a, sim FROM edge) SELECT least(a, b) AS a, greatest(a, b) AS b, CAST(pri AS INTEGER) AS pri, CAST(s AS DOUBLE) AS s FROM p QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY pri) = 1",
)
def u05(v: Views) -> DataFrame:
    curated = v.edge.where("(a + b) % 4 = 0").select(F.lit(0).alias("pri"), "a", "b", F.lit(1.0).alias("s"))
    auto = v.edge.select(F.lit(1).alias("pri"), F.col("b").alias("a"), F.col("a").alias("b"), F.col("sim").alias("s"))
    both = curated.unionByName(auto).select("pri", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s")
    return dedupe_best(both, [F.col("a"), F.col("b")], [F.col("pri")])


@query("u06_exclusion", "SELECT id FROM entity WHERE id NOT IN (SELECT entity_id FROM att WHERE cnt >= 60)")
def u06(v: Views) -> DataFrame:
    return v.entity.select("id").join(v.att.where("cnt >= 60").select(F.col("entity_id").alias("id")), "id", "left_anti")
