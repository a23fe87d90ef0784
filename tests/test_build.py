"""End-to-end builds: invariants of alignment and registry."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomwright.operators import registry
from loomwright.plans import build
from loomwright.plans.views import Views


@pytest.fixture(scope="module")
def built(spark, sf_dir):
    return build._built(Views(spark, sf_dir)), build._entities(Views(spark, sf_dir))


def test_invariants_hold(built):
    assert all(r["bad"] == 0 for r in registry.check_alignment(built[0]).collect())


def test_registry_has_every_entity_once(built):
    alignment, entities = built
    reg = registry.build_registry(alignment, entities)
    clusters, members = alignment.clusters.count(), alignment.members.count()
    assert reg.count() == clusters + entities.count() - members
    assert reg.select("slug").distinct().count() == reg.count() == reg.select("id").distinct().count()
    assert reg.agg(F.sum("total_mentions")).first()[0] == entities.agg(F.sum("cnt")).first()[0]


def test_identifiers_survive_a_rebuild(spark, sf_dir, built):
    again = build._built(Views(spark, sf_dir))
    mine = {(r["stable_key"], r["cluster_id"]) for r in built[0].clusters.collect()}
    assert mine == {(r["stable_key"], r["cluster_id"]) for r in again.clusters.collect()}


def test_merges_inside_books_keep_mentions(built):
    entities = built[1]
    merged = registry.deduplicated(entities, floor=0.25, person_floor=0.2, least_string=0.0)
    assert merged.count() <= entities.count()
    assert merged.agg(F.sum("cnt")).first()[0] == entities.agg(F.sum("cnt")).first()[0]


def test_equal_entities_are_one_cluster(spark):
    rows = [(i, i % 3, i, n, "PERSON", 5, v) for i, (n, v) in enumerate([("Galen", [1.0, 0.0]), ("Galeno", [0.99, 0.1]), ("Galenus", [0.98, 0.15]), ("Ovid", [0.0, 1.0])])]
    e = spark.createDataFrame(rows, "key long, book_id long, id long, name string, category string, cnt long, vector array<double>")
    c = registry.build_alignment(e)
    assert [(r["canonical_name"], r["book_count"], r["total_mentions"]) for r in c.clusters.collect()] == [("Galen", 3, 15)]
