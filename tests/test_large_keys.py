"""Queries against their SQL on small invented tables that the driver's smallest ones have nothing like."""

from __future__ import annotations

import time

import duckdb
import numpy as np
import pytest

from loomwright.operators import graph, neighbours
from loomwright.plans import registry

from .test_queries import plain

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture
def both(spark, tmp_path):
    """Rows of a query and of its SQL over tables given as SQL, sorted."""

    def run(name: str, **tables: str) -> tuple[list, list]:
        con = duckdb.connect()
        for table, sql in tables.items():
            con.execute(f"copy ({sql}) to '{tmp_path}/{table}.parquet' (format parquet)")
            con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
        df, want = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLES[name])
        at = [list(want.columns).index(c) for c in df.columns]
        mine = sorted((tuple(plain(x) for x in r) for r in df.collect()), key=repr)
        return mine, sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)

    run.folder = str(tmp_path)
    return run


PART = "SELECT CAST(k AS BIGINT) AS p_partkey, n AS p_name, 'Brand#1' AS p_brand, t AS p_type, CAST(s AS INTEGER) AS p_size"


def test_ids_from_100000_on_lead_as_in_sql(both):
    rows = "(500000, 'bolt', 'PROMO', 3), (7, 'bolt', 'PROMO', 2), (8, 'gear', 'PROMO', 2), (90000, 'gear', 'PROMO', 3), (4, 'a|b', 'c', 1), (5, 'b', 'c|a', 1), (6, NULL, 'x', 1), (9, 'x', NULL, 1)"
    mine, theirs = both("a02_entity_merge", part=f"{PART} FROM (VALUES {rows}) v(k, n, t, s)")
    assert mine == theirs and ("PROMO", "bolt", 7, 5) in mine


@pytest.mark.parametrize("far", [0, 500_000])
def test_a_name_within_another_ties_only_by_an_edge(both, far):
    # 1 leads unless ids are far apart; 2 and 4 hang on 3, which has an edge to both leads
    rows = f"({1 + far}, 'cold plate', 'x', 9), (2, 'old plate', 'x', 5), (3, 'cold bolt', 'x', 6), (4, 'cold plate', 'x', 5)"
    vectors = f"({1 + far}, [1.0, 0, 0]), (2, [0.2, 0.98, 0]), (3, [0.6, 0.6, 0.53]), (4, [0, 0, 1.0])"
    mine, theirs = both(
        "g03_star_across",
        part=f"{PART} FROM (VALUES {rows}) v(k, n, t, s)",
        embeddings=f"SELECT CAST(k AS BIGINT) AS vec_id, CAST(e AS FLOAT[]) AS embedding, CAST(1 AS INTEGER) AS label FROM (VALUES {vectors}) v(k, e)",
    )
    assert mine == theirs and len(mine) in (3, 4)


@pytest.mark.parametrize("lead, sizes", [("large gear", "9"), ("hot rod", "9"), ("", "9"), ("large gear", "NULL")])
def test_names_at_the_floor_tie_as_in_sql(both, lead, sizes):
    # "large gear" and "hot rod" are a hair under the floor of 0.2, as the SQL adds; 1 leads, if it has a size
    names = ["large gear", "hot rod", "Large Gear", "HOT ROD", "", "cold plate", "xq", None, "large gear"]
    rows = ", ".join(f"({i + 2}, {'NULL' if n is None else repr(n)}, 'x', 5)" for i, n in enumerate(names))
    vectors = "CASE k WHEN 1 THEN [1.0, 0.5, 0] ELSE [0.9, 0.1, k / 20] END"
    mine, theirs = both(
        "g03_star_across",
        part=f"{PART} FROM (VALUES (1, '{lead}', 'x', {sizes}), {rows}) v(k, n, t, s)",
        embeddings=f"SELECT CAST(k AS BIGINT) AS vec_id, CAST({vectors} AS FLOAT[]) AS embedding, CAST(1 AS INTEGER) AS label FROM range(1, 11) v(k)",
    )
    assert mine == theirs and len(mine) > 2


@pytest.mark.parametrize("name", ["v01_cosine", "v02_cosine_smoothed", "v03_dot", "v04_cosine_raw"])
def test_scores_of_all_pairs_in_packs(both, spark, name):
    # the vectors of a label are up to 4 packs, one is null and one zero, and labels are null too; no lambda runs per pair
    rows = "SELECT CAST(i AS BIGINT) AS vec_id, CAST(CASE i WHEN 5 THEN NULL WHEN 6 THEN [0, 0, 0, 0] ELSE [(hash(i) % 97) / 64 - 0.7, (hash(i * 3) % 89) / 64 - 0.7, 0.3, 0.1] END AS FLOAT[]) AS embedding, CAST(CASE WHEN i < 600 THEN 1 WHEN i < 700 THEN 2 END AS INTEGER) AS label FROM range(720) t(i)"
    mine, theirs = both(name, embeddings=rows)
    assert len(mine) == 600 * 599 // 2 + 100 * 99 // 2 and mine == theirs
    assert "MapInArrow" in QUERIES[name](spark, both.folder)._jdf.queryExecution().executedPlan().toString()


def test_shared_places_of_many_books(both, spark):
    # 700 books in 3 packs; a few clusters hold nearly all, most hold a few; one id stands for clusters of two categories
    part = f"{PART} FROM (SELECT i AS k, 'n' || (i // 2) AS n, CASE i % 3 WHEN 0 THEN 'PROMO' WHEN 1 THEN 'x' END AS t, 1 AS s FROM range(400) r(i) UNION ALL SELECT 30, 'again', 'x', 1)"
    line = "SELECT CAST(hash(i) % 700 AS BIGINT) AS l_suppkey, CAST(CASE WHEN i % 3 = 0 THEN 30 + i % 4 ELSE hash(i * 7) % 400 END AS BIGINT) AS l_partkey, 1.0::DOUBLE AS l_quantity, TIMESTAMP '2000-01-01' AS l_shipdate FROM range(6000) r(i)"
    mine, theirs = both("j26_shared_books", part=part, lineitem=line)
    assert mine == theirs and len(mine) > 50_000 and any(r[3] for r in mine)
    plan = QUERIES["j26_shared_books"](spark, both.folder)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "book_id" not in plan  # no join of books with books


def test_linkage_of_a_large_block_copies_and_rows_without_vectors(spark):
    from .test_matching import naive_linkage

    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 6)) + 2 * rng.normal(size=(5, 6))[rng.integers(0, 5, 90)]
    x[10:20] = x[9]
    rows = [(1, i, [float(v) for v in x[i]]) for i in range(90)] + [(1, 1000, None), (1, 1001, [0.0] * 6), (1, 1002, [0.0] * 6)]
    many = rng.normal(size=(6000, 16))  # one component, whose matrix of all pairs took cubic time
    rows += [(2, 2000 + i, [float(v) for v in many[i]]) for i in range(6000)]
    df = spark.createDataFrame(rows, "block int, id long, vector array<double>")
    start = time.time()
    got = {r["id"]: r["cluster"] for r in graph.average_linkage(df, "block", "id", "vector", 0.4).collect()}
    assert time.time() - start < 60 and len(got) == 6093
    assert {k: v for k, v in got.items() if k < 90} == naive_linkage(x, list(range(90)), 0.4)
    assert all(got[k] == k for k in (1000, 1001, 1002))


@pytest.mark.parametrize("again", [False, True])
def test_links_of_neighbours_in_packs(both, spark, again):
    # 600 vectors of one label in 3 packs, products at the floor itself, a null vector, and ids that occur twice
    e = "SELECT CAST(i AS BIGINT) AS vec_id, CAST(CASE WHEN i = 5 THEN NULL WHEN i < 30 THEN [0.5, 0.6, 0, 0] WHEN i < 40 THEN [0.6, 0, 0, 0] ELSE [(hash(i) % 97) / 97 - 0.5, (hash(i * 3) % 89) / 89 - 0.5, (hash(i * 5) % 83) / 83 - 0.5, 0.1] END AS FLOAT[]) AS embedding, CAST(CASE WHEN i < 600 THEN 1 WHEN i < 700 THEN 2 END AS INTEGER) AS label FROM range(720) t(i)"
    twice = " UNION ALL SELECT CAST(50 + i * 3 AS BIGINT), CAST([0.6, 0.6, 0, 0] AS FLOAT[]), CAST(1 + i % 2 AS INTEGER) FROM range(6) s(i)"
    mine, theirs = both("j27_neighbour_links", embeddings=e + twice * again)
    assert mine == theirs and len(mine) > 1000
    if not again:
        plan = QUERIES["j27_neighbour_links"](spark, both.folder)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "nbr" not in plan  # no join of edges with edges


def test_graph_of_neighbours_sends_no_row_to_each_cell(spark):
    x = np.random.default_rng(4).normal(size=(2000, 16))
    x[100:400] = x[100]  # copies, whose neighbours are the smallest keys
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    graph_ = neighbours.knn_graph(df, "id", "nbr", "vector", 5, sample=500, block=64, block_mb=1, recall=1.0)
    x = x.astype(np.float32).astype(float)
    sim = np.round(x @ x.T, 4)
    found: dict = {}
    for r in graph_.collect():
        found.setdefault(r["id"], []).append((r["rank"], r["nbr"]))
    want = lambda i: sorted((j for j in range(2000) if j != i), key=lambda j: (-sim[i, j], j))[:5]
    share = [len({n for _, n in found[i]} & set(want(i))) / 5 for i in range(0, 2000, 7)]
    assert np.mean(share) >= 0.95 and all(len(found[i]) == 5 for i in range(2000))
    plan = graph_._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Join" not in plan


VECTOR = "SELECT CAST(i AS BIGINT) AS vec_id, CAST(CASE WHEN i IN (5, 50) THEN NULL WHEN i IN (6, 100) THEN [0, 0, 0, 0] WHEN i IN (7, 150) THEN [0.5, 0.25] WHEN i IN (8, 200) THEN [NULL, 0.5, NULL, 1] WHEN i = 9 THEN [] WHEN i IN (10, 250) THEN [NULL, NULL, NULL, NULL] WHEN i = 11 THEN ['inf'::FLOAT, NULL, 1, 1] WHEN i = 12 THEN [1, 2, 3, 4, 5] WHEN i = 13 THEN [1] ELSE [(hash(i) % 97) / 64 - 0.7, (hash(i * 3) % 89) / 64 - 0.7, 0.3, 0.1] END AS FLOAT[]) AS embedding, CAST(1 AS INTEGER) AS label FROM range(-300, 1500) t(i) UNION ALL SELECT * FROM (VALUES (NULL, [1, 0, 0, 0], 1), (50, [1, 0, 0, 0], 1), (400, [0, 0.5, 0, 0], 1)) w(k, e, l)"


def test_cosines_with_all_rows_of_any_vectors(both):
    # several tiles; vectors that are null, zero, empty, shorter, longer, hold nulls or infinity; ids below 0, null and twice
    mine, theirs = both("j34_full_cosine", embeddings=VECTOR)
    assert len(mine) > 60_000 and mine == theirs


def test_a_written_cosine_takes_a_few_bytes(spark, tmp_path):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(7000, 16)).tolist())], "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    QUERIES["j34_full_cosine"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out").count()
    assert rows == 140 * 6999
    assert sum(p.stat().st_size for p in tmp_path.glob("out/*.parquet")) < 4 * rows


def test_a_written_score_takes_a_few_bytes(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    QUERIES["v03_dot"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out").count()
    assert rows == 4000 * 3999 // 2
    assert sum(p.stat().st_size for p in tmp_path.glob("out/*.parquet")) < 4 * rows


def test_scores_in_packs_by_rising_keys(spark):
    # packs and tiles far smaller than blocks; ids that occur twice lie in one pack or in two
    rng = np.random.default_rng(6)
    keys = [int(k) for k in rng.integers(-60, 60, 150)]
    rows = [(k, [float(v) for v in rng.integers(-9, 10, 4) / 4], i % 3 if i % 50 else None) for i, k in enumerate(keys)]
    got = neighbours.block_scores(spark.createDataFrame(rows, "id long, v array<float>, g int"), "id", "v", "g", lambda d, x, y: d, pack=8, tile=3)
    want = [(a, b, plain(np.dot(x, y))) for a, x, g in rows for b, y, h in rows if g == h and g is not None and a < b]
    assert sorted((r["a"], r["b"], plain(r["sim"])) for r in got.collect()) == sorted(want)


def test_a_written_link_takes_half_a_byte(spark, tmp_path):
    # near each other by and large, and many more rows than vectors
    rng = np.random.default_rng(7)
    x = rng.normal(size=(330, 64)) + 0.8 * rng.normal(size=64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i * 11, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    QUERIES["j27_neighbour_links"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out").count()
    x = x.astype(np.float32).astype(float)
    near = (x @ x.T >= 0.3) & ~np.eye(330, dtype=bool)
    assert rows == np.einsum("ij,jk,ki->", *[near.astype(int)] * 3) // 2 and rows > 1_000_000
    assert sum(p.stat().st_size for p in tmp_path.glob("out/*.parquet")) < 0.6 * rows
