"""Operators on small invented rows and against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomwright.functions import normalise, rules
from loomwright.functions.similarity import string_similarity
from loomwright.operators import aggregates, graph, joins, mutations, ranking, text
from loomwright.sources import providers
from loomwright.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("a", "b", "category", "ok"),
    [
        ("Duarte Barbosa", "Duarte Pacheco", "PERSON", False),
        ("June", "July", "CONCEPT", False),
        ("Body", "Bones", "CONCEPT", False),
        ("Root", "Roots", "PLANT", True),
        ("canela", "canela fina", "PLANT", True),
        ("cheiro", "cheyro", "CONCEPT", True),
    ],
)
def test_plausible_merge(spark, a, b, category, ok):
    assert one(spark, rules.plausible_merge(F.lit(a), F.lit(b), F.lit(category))) is ok


@pytest.mark.parametrize(("name", "variant", "keep"), [("Galen", "Ga", False), ("Galen", "galen", True), ("cheiro", "cheyro", True), ("rose", "violet", False)])
def test_valid_variant(spark, name, variant, keep):
    assert one(spark, rules.valid_variant(F.lit(name), F.lit(variant))) is keep


@pytest.mark.parametrize("name", ["»x", "12", "1652", "fol.3", "α", "[abc", ""])
def test_noise_names(spark, name):
    assert one(spark, rules.is_noise_name(F.lit(name), F.lit(1))) is True


def test_clean_name_is_no_noise(spark):
    assert one(spark, rules.is_noise_name(F.lit("Galen of Pergamon"), F.lit(1))) is False


def test_normalisers_differ(spark):
    s = F.lit("  Æther-Straße  é ")
    assert one(spark, normalise.registry_text(s)) == "aether-strasse e"
    assert one(spark, normalise.slug(F.lit("Água Forte!"))) == "agua-forte"
    assert one(spark, normalise.plain_slug(F.lit("Água"))) == "gua"
    assert one(spark, normalise.slug(F.lit("日本"))) == "entity"
    assert one(spark, normalise.surname(F.lit("Dr. Ana da Silva,"))) == "silva"


def test_similarity_of_empty_and_equal(spark):
    assert one(spark, string_similarity(F.lit("a"), F.lit(""))) == 0.0
    assert one(spark, string_similarity(F.lit("Ab"), F.lit("aB"))) == 1.0
    assert one(spark, string_similarity(F.lit(None).cast("string"), F.lit("a"))) is None


def test_greedy_matching_equals_sequential(spark):
    rng = random.Random(5)
    pairs = [(a, b, rng.choice([0.1, 0.5, 0.9])) for a in range(25) for b in range(25) if rng.random() < 0.3]
    used_a, used_b, want = set(), set(), set()
    for a, b, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), want.add((a, b))
    got = joins.greedy_matching(spark.createDataFrame(pairs, "a long, b long, sim double")).collect()
    assert {(r["a"], r["b"]) for r in got} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)]
    up = {n: n for e in edges for n in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}


def test_components_without_edges(spark):
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_slugs_are_unique(spark):
    rows = [(1, "mercury", "substance", "b1"), (2, "mercury", "object", "b1"), (3, "mercury", "substance", "b2"), (4, "mercury", "substance", "b2"), (5, "mercury-object", "x", "b1")]
    got = ranking.allocate_slugs(spark.createDataFrame(rows, "id long, base string, category string, hint string"), "base", "category", "hint", ["id"]).collect()
    slugs = {r["id"]: r["slug"] for r in got}
    assert slugs[1] == "mercury" and slugs[2] == "mercury-object" and slugs[3] == "mercury-b2" and slugs[4] == "mercury-2"
    assert len(set(slugs.values())) == 5


def test_honorific_conflict(spark):
    rows = [(1, "Mr. Galton", "PERSON", 5), (2, "Mrs. Galton", "PERSON", 1), (3, "Mr. Hume", "PERSON", 2), (4, "Hume", "PERSON", 7)]
    e = spark.createDataFrame(rows, "id long, name string, category string, cnt long")
    title = F.regexp_extract("name", r"(?i)^(mr|mrs|ms)\.?\s", 1)
    got = {(r["name"], r["cnt"]) for r in aggregates.honorific_merge(e, normalise.strip_honorific(F.col("name")), title).collect()}
    assert got == {("Mr. Galton", 5), ("Mrs. Galton", 1), ("Hume", 9)}


def test_chunks_cover_and_overlap():
    body = " ".join(f"Sentence number {i} ends here." for i in range(400))
    parts = list(text.chunk_text(body, strip=False, least=0))
    assert parts[0][1] == 0 and all(b[1] < a[1] + len(a[2]) for a, b in zip(parts, parts[1:], strict=False))
    assert parts[-1][1] + len(parts[-1][2]) == len(body)
    assert list(text.chunk_text("")) == [] and list(text.chunk_text("short")) == []


def test_mentions_keep_apart():
    found = text.find_mentions("canela e canela fina, " + "x" * 60 + " Canela", ["canela", "canela fina"])
    assert [(o, t) for o, t, _ in found] == [(9, "canela fina"), (82 + 1, "canela")] or [t for _, t, _ in found] == ["canela fina", "canela"]


def test_json_repair():
    assert text.repair_json('Sure {"a": [1, 2') == '{"a": [1, 2]}'
    assert text.repair_json('{"a": "b}"} tail') == '{"a": "b}"}'
    assert text.repair_json("none") is None and text.repair_json("") is None


def test_split_never_empties(spark):
    m = spark.createDataFrame([(1, 10, 1), (2, 20, 1), (2, 21, 2)], "cluster_id long, entity_id long, book_id long")
    s = spark.createDataFrame([(1, 10), (2, 20)], "cluster_id long, entity_id long")
    got = {(r["entity_id"], r["cluster_id"]) for r in mutations.split_members(m, s, F.lit(100) + F.col("entity_id")).collect()}
    assert got == {(10, 1), (20, 120), (21, 2)}


def test_merges_preserve_counts(spark):
    c = spark.createDataFrame([(1, 5, None), (2, 9, "x"), (3, 1, "y")], "cluster_id long, total_mentions long, modern string")
    m = spark.createDataFrame([(1, 1), (2, 1)], "cluster_id long, keeper long")
    got = {r["cluster_id"]: (r["total_mentions"], r["modern"]) for r in mutations.merge_into(c, m, ["modern"]).collect()}
    assert got == {1: (14, "x"), 3: (1, "y")}


def test_provider_failure_gives_nulls(spark):
    def broken(keys):
        raise OSError("no network")

    got = providers.ask(spark.createDataFrame([("a",), (None,)], "k string"), "k", broken).collect()
    assert [r["answer"] for r in got] == [None, None]


def test_streaming_ingest(spark, tmp_path):
    registry = spark.createDataFrame([("rose", "PLANT", 1)], "name string, category string, cnt long")
    ingest.keyed(registry).write.parquet(str(tmp_path / "registry"))
    spark.createDataFrame([("Rose", "PLANT", 4), ("lily", "PLANT", 2)], registry.schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(registry.schema).parquet(str(tmp_path / "in"))
    ingest.ingest(stream, str(tmp_path / "registry"), str(tmp_path / "staging"), str(tmp_path / "ck")).awaitTermination(60)
    assert [r["name"] for r in spark.read.parquet(str(tmp_path / "staging")).collect()] == ["lily"]
    assert [r["cnt"] for r in spark.read.parquet(str(tmp_path / "staging-known")).collect()] == [4]


def test_entry_points_import():
    import __spark_entry__

    assert len(__spark_entry__.queries()) >= len(__spark_entry__.oracle_sql()) > 150
