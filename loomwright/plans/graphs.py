"""Graph and clustering operators (G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as ops
from ..operators.joins import near_duplicate_clusters
from ..operators.neighbours import knn_graph
from .joins import _DOT
from .views import Views, query



def _components_sql(tail: str) -> str:
    both = ", both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge), walk(node, seen) AS (SELECT a, a FROM both_ways UNION SELECT w.node, e.b FROM walk w JOIN both_ways e ON w.seen = e.a), comp AS (SELECT node, min(seen) AS component FROM walk GROUP BY 1)"
    return both + tail


def _named(v: Views) -> DataFrame:
    comp = ops.connected_components(v.edge)
    p = v.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("cnt"))
    return comp.join(p, F.col("node") == F.col("id")).select("component", "id", (F.col("id") % 5).alias("book_id"), "name", "cnt")


_NAMED = ", m AS (SELECT component, p_partkey AS id, p_partkey % 5 AS book_id, p_name AS name, p_size AS cnt FROM comp JOIN part ON node = p_partkey), lead AS (SELECT component, arg_max(id, cnt * 100000 - id) AS pid FROM m GROUP BY 1), j AS (SELECT m.*, pid, p.name AS pname FROM m JOIN lead USING (component) JOIN m p ON p.id = pid)"
_ALIKE = """(CASE WHEN name = pname THEN 1.0 ELSE 0.5 * len(list_filter(range(1, least(length(name), length(pname)) + 1), lambda i: starts_with(pname, substr(name, 1, CAST(i AS INTEGER))))) / least(length(name), length(pname))
  + 0.3 * len(list_intersect(list_distinct(string_split(name, '')), list_distinct(string_split(pname, '')))) / len(list_distinct(list_concat(string_split(name, ''), string_split(pname, ''))))
  + 0.2 * least(length(name), length(pname)) / greatest(length(name), length(pname)) END)"""


@query("g01_components", _components_sql(" SELECT node, component FROM comp"))
def g01(v: Views) -> DataFrame:
    return ops.connected_components(v.edge)


@query("g02_star_within", _components_sql(_NAMED + f" SELECT component, id, pid AS primary_id FROM j WHERE id = pid OR {_ALIKE} >= 0.4"))
def g02(v: Views) -> DataFrame:
    return ops.star_within(_named(v), 0.4).select("component", "id", "primary_id")


@query(
    "g03_star_across",
    _components_sql(
        _NAMED
        + f", k AS (SELECT j.component, j.id, j.book_id FROM j LEFT JOIN edge e ON e.a = least(id, pid) AND e.b = greatest(id, pid) WHERE id = pid OR name = pname OR (e.sim >= 0.31 AND {_ALIKE} >= 0.2)) SELECT component, id FROM k WHERE component IN (SELECT component FROM k GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT book_id) >= 2)"
    ),
)
def g03(v: Views) -> DataFrame:
    order = F.col("cnt") * F.lit(100_000).cast("long") - F.col("id")
    # "old plate" lies within "cold plate", but the SQL ties equal names only
    return ops.star_across(_named(v), v.edge, 0.31, 0.2, 0.99, 0.2, order, within=False).select("component", "id")


@query("g04_edges_inside", _components_sql(" SELECT x.component, e.a, e.b, round(e.sim, 3) AS sim FROM edge e JOIN comp x ON e.a = x.node JOIN comp y ON e.b = y.node WHERE x.component = y.component"))
def g04(v: Views) -> DataFrame:
    members = ops.connected_components(v.edge).withColumnRenamed("node", "id")
    return ops.edges_inside(v.edge, members)


@query("g05_near_duplicate_merge")
def g05(v: Views) -> DataFrame:
    c = v.member.groupBy("cluster_id", "canonical_name", "category").agg(F.collect_set("book_id").alias("books"), F.collect_set("name").alias("names"))
    return ops.merge_near_duplicates(v.stats.select("cluster_id", "total_mentions"), near_duplicate_clusters(c, 0.85, 0.85))


@query("g06_average_linkage")
def g06(v: Views) -> DataFrame:
    return ops.average_linkage(v.embeddings, "label", "vec_id", "embedding", 0.7)


@query("g07_knn_graph")
def g07(v: Views) -> DataFrame:
    """Of all rows, by the index; its recall is tested against brute force."""
    near = knn_graph(v.embeddings, "vec_id", "nbr", "embedding", 15)
    return near.groupBy(F.least("vec_id", "nbr").alias("a"), F.greatest("vec_id", "nbr").alias("b")).agg(F.max("sim").alias("sim"), F.count("*").alias("directions"))


@query(
    "g08_co_citation_graph",
    ", o AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS s FROM lineitem), w AS (SELECT a.s AS x, b.s AS y, count(*) AS weight FROM o a JOIN o b ON a.k = b.k AND a.s < b.s GROUP BY 1, 2 HAVING count(*) >= 10) SELECT n, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS strength FROM (SELECT x AS n, weight FROM w UNION ALL SELECT y, weight FROM w) GROUP BY 1",
)
def g08(v: Views) -> DataFrame:
    o = v.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("s")).distinct()
    e = ops.person_edges(o, "k", "s", least=10)
    ends = e.select(F.explode(F.array("source", "target")).alias("n"), "weight")
    return ends.groupBy("n").agg(F.count("*").alias("degree"), F.sum("weight").cast("long").alias("strength"))


@query(
    "g09_pair_graph",
    ", p AS (SELECT e.a AS ord, x.p_name AS ta, x.p_type AS la, y.p_name AS tb, y.p_type AS lb, e.b FROM edge e JOIN part x ON e.a = x.p_partkey JOIN part y ON e.b = y.p_partkey), t AS (SELECT ta AS term, la AS lang, ord * 10000 + b AS o FROM p UNION ALL SELECT tb, lb, (ord * 10000 + b) + 0.5 FROM p) SELECT term, arg_min(lang, o) AS lang, CAST(count(DISTINCT CAST(floor(o / 10000) AS BIGINT) % 5) AS INTEGER) AS sources FROM t GROUP BY 1",
)
def g09(v: Views) -> DataFrame:
    p = v.part.select("p_partkey", "p_name", "p_type")
    x = p.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("term_a"), F.col("p_type").alias("lang_a"))
    y = p.select(F.col("p_partkey").alias("b"), F.col("p_name").alias("term_b"), F.col("p_type").alias("lang_b"))
    pairs = v.edge.join(x, "a").join(y, "b").withColumn("order", F.struct("a", "b"))
    pairs = pairs.withColumn("source_a", F.col("a") % 5).withColumn("source_b", F.col("a") % 5)
    return ops.pair_graph_nodes(pairs, "order").select("term", "lang", F.size("sources").alias("sources"))


@query("g10_reverse_edges", "SELECT a, b, sim, false AS is_reverse FROM edge UNION ALL SELECT b, a, sim, true FROM edge WHERE sim >= 0.31")
def g10(v: Views) -> DataFrame:
    return ops.with_reverse(v.edge.select("a", "b", "sim"), "a", "b", F.col("sim") >= 0.31)
