"""Building an alignment of books and its registry: from book entities to clusters, identifiers, index and checks.

Relations stay normalised (entities, edges, members, clusters, attestations); nesting happens at the sink only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import stable_id, stable_key
from ..functions.normalise import slug
from ..functions.rules import is_noise_name
from .aggregates import cluster_stats
from .graph import connected_components, edges_inside, star_across
from .joins import cut_lineage, similar_across_books, similar_within_book
from .mutations import integrity
from .ranking import allocate_slugs, global_rank, suffixed


@dataclass
class Alignment:
    """clusters: cluster_id, stable_key, canonical_name, category, book_count, total_mentions, members.
    members: cluster_id, book_id, id, name, category, cnt. edges: cluster_id, a, b, sim."""

    clusters: DataFrame
    members: DataFrame
    edges: DataFrame


def deduplicated(entities: DataFrame, **floors: float) -> DataFrame:
    """Entities (key, book_id, id, name, category, cnt, vector) after merges inside each book: the largest one of each
    merge stays, with the sum of the counts."""
    pairs = similar_within_book(entities.withColumn("id", F.col("key")), **floors)
    label = connected_components(pairs.select("a", "b"))
    grouped = entities.join(label, F.col("key") == F.col("node"), "left").withColumn("group", F.coalesce("component", "key"))
    lead = F.max_by(F.struct("key", "book_id", "id", "name", "category", "vector"), F.struct("cnt", -F.col("key")))
    return grouped.groupBy("group").agg(lead.alias("e"), F.sum("cnt").cast("long").alias("cnt")).select("e.*", "cnt")


def build_alignment(entities: DataFrame, floor: float = 0.84, person_floor: float = 0.80, ease: float = 0.03, star: dict[str, float] | None = None) -> Alignment:
    """Clusters across books of entities (key, book_id, id, name, category, cnt, vector); key is unique over all books.

    Matches between books are joined on their category, components are validated against their largest member, and
    clusters are numbered by books, then mentions, then key.
    """
    keyed = cut_lineage(entities.withColumn("id", F.col("key")))
    matches = cut_lineage(similar_across_books(keyed, floor, person_floor, ease).select("a", "b", "sim"))
    label = connected_components(matches)
    named = label.join(keyed, F.col("node") == F.col("key")).select("component", "id", "book_id", "name", "category", "cnt")
    kept = cut_lineage(star_across(named, matches, **(star or {})))
    members = kept.select(F.col("component").alias("cluster"), "book_id", "id", "name", "category", "cnt")
    lead = F.max_by(F.struct("name", "category"), F.struct("cnt", -F.col("id")))
    heads = members.groupBy("cluster").agg(lead.alias("lead"), F.collect_set("name").alias("names"))
    stats = cluster_stats(members, ["cluster"])
    clusters = heads.join(stats, "cluster").select(
        "cluster", F.col("lead.name").alias("canonical_name"), F.col("lead.category").alias("category"), "names", "book_count", "total_mentions", "members"
    )
    ranked = global_rank(clusters, [F.desc("book_count"), F.desc("total_mentions"), F.col("cluster")], "cluster_id")
    ranked = ranked.withColumn("key_base", stable_key(F.col("category"), F.col("names")))
    ranked = cut_lineage(suffixed(ranked, "key_base", [F.col("cluster_id")], "stable_key").drop("key_base"))
    ids = ranked.select("cluster", "cluster_id")
    inside = edges_inside(matches, kept.select("id", "component")).withColumnRenamed("component", "cluster")
    return Alignment(ranked.drop("cluster", "names"), members.join(ids, "cluster").drop("cluster"), inside.join(ids, "cluster").drop("cluster"))


def build_registry(alignment: Alignment, entities: DataFrame) -> DataFrame:
    """Every cluster, and every entity that is in none: id, slug, canonical_name, category, book_count, total_mentions,
    is_aligned, noise."""
    c = alignment.clusters.select(
        stable_id(F.lit("cluster"), "stable_key").alias("id"), "canonical_name", "category", "book_count", "total_mentions",
        F.lit(True).alias("is_aligned"), F.lit("alignment").alias("hint"),
    )
    alone = entities.join(alignment.members.select(F.col("id").alias("key")), "key", "left_anti")
    local = alone.select(
        stable_id(F.lit("local"), F.col("book_id").cast("string"), F.col("key").cast("string")).alias("id"),
        F.col("name").alias("canonical_name"), "category", F.lit(1).cast("long").alias("book_count"), F.col("cnt").cast("long").alias("total_mentions"),
        F.lit(False).alias("is_aligned"), F.concat(F.lit("b"), F.col("book_id").cast("string")).alias("hint"),
    )
    rows = c.unionByName(local).withColumn("base", slug(F.col("canonical_name"))).withColumn("kind", F.lower("category"))
    rows = rows.withColumn("first", (~F.col("is_aligned")).cast("int"))
    named = allocate_slugs(rows, "base", "kind", "hint", ["first", "id"])
    return named.withColumn("noise", is_noise_name(F.col("canonical_name"), F.col("total_mentions"))).drop("base", "kind", "hint", "first")


def attestations(registry_members: DataFrame, books: DataFrame) -> DataFrame:
    """Members with their books' titles, or a stand-in title."""
    b = books.select(F.col("book_id").alias("__b"), "title", "year")
    j = registry_members.join(b, F.col("book_id") == F.col("__b"), "left").drop("__b")
    return j.withColumn("title", F.coalesce("title", F.concat(F.lit("Book "), F.col("book_id").cast("string"))))


def check_alignment(alignment: Alignment) -> DataFrame:
    """(check, bad) of the invariants that every build must keep."""
    clusters, members, edges = alignment.clusters, alignment.members, alignment.edges
    ids, owners = clusters.select("cluster_id"), members.select("cluster_id").distinct()
    ends = edges.select(F.explode(F.array("a", "b")).alias("id"))
    twice = lambda df, c: df.groupBy(c).count().where("count > 1")
    return integrity(
        {
            "duplicate cluster ids": twice(clusters, "cluster_id"),
            "duplicate stable keys": twice(clusters, "stable_key"),
            "clusters without members": ids.subtract(owners),
            "members without a cluster": owners.subtract(ids),
            "members in two clusters": twice(members, "id"),
            "clusters of one book": clusters.where("book_count < 2"),
            "edges to strangers": ends.join(members.select("id"), "id", "left_anti"),
            "edges to oneself": edges.where("a = b"),
        }
    )
