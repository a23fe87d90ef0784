"""Matching, tagging and neighbour operators against brute force on small invented rows."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.operators import graph, joins, neighbours, prompts, ranking, text
from loomwright.plans.sources import s11
from loomwright.plans.views import Views


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("floor", [0.6, 0.7, 0.83, 0.95])
def test_edit_candidates_miss_no_near_pair(spark, floor):
    rng = random.Random(int(floor * 100))
    names = ["".join(rng.choice("abc ") for _ in range(rng.randrange(1, 14))) for _ in range(150)] + ["aaaaaa", "aaaaaaa", "aa", "ab", "a", "a"]
    rows = [(i, n, "xy"[i % 2]) for i, n in enumerate(names)]
    got = {tuple(r) for r in joins.edit_candidates(spark.createDataFrame(rows, "id long, name string, cat string"), "id", "name", "cat", floor).collect()}
    near = {(a, b) for a, na, ca in rows for b, nb, cb in rows if a < b and ca == cb and 1 - distance(na, nb) / max(len(na), len(nb)) >= floor}
    assert near <= got and all(a < b for a, b in got)


def naive_linkage(x: np.ndarray, keys: list[int], threshold: float) -> dict[int, int]:
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d, groups = 1 - x @ x.T, [[i] for i in range(len(x))]
    while len(groups) > 1:
        best = min(((np.mean([d[i, j] for i in a for j in b]), m, n) for m, a in enumerate(groups) for n, b in enumerate(groups) if m < n), key=lambda t: t[0])
        if best[0] > threshold:
            break
        groups[best[1]] += groups.pop(best[2])
    return {keys[i]: min(keys[j] for j in g) for g in groups for i in g}


def test_average_linkage_equals_naive(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 8))
    x = centre[rng.integers(0, 6, 60)] + rng.normal(scale=0.45, size=(60, 8))
    rows = [(i % 2, i, [float(v) for v in x[i]]) for i in range(60)]
    df = spark.createDataFrame(rows, "block int, id long, vector array<double>")
    for threshold in (0.1, 0.3, 0.7):
        got = {r["id"]: r["cluster"] for r in graph.average_linkage(df, "block", "id", "vector", threshold).collect()}
        want = {}
        for b in (0, 1):
            at = [i for i in range(60) if i % 2 == b]
            want |= naive_linkage(x[at], at, threshold)
        assert got == want


def vectors(spark, n=1500, dim=24, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) + 1.5 * rng.normal(size=(12, dim))[rng.integers(0, 12, n)]
    x = np.float32(x / np.linalg.norm(x, axis=1, keepdims=True))
    x[7] = x[9]  # ties
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").repartition(5)


def best_of(x, i, k):
    sim = np.round(x.astype(np.float64) @ x[i].astype(np.float64), 4)
    order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-sim[j], j))[:k]
    return [(j, sim[j]) for j in order]


@pytest.mark.parametrize("block_mb", [64, 0.002])
def test_exact_search_equals_brute_force(spark, block_mb):
    x, df = vectors(spark)
    asked, rows = df.where("id % 50 = 0"), df.withColumnRenamed("id", "nbr")
    args = {"block_mb": block_mb} if block_mb == 64 else {"block_mb": 1, "sample": 40}
    got = neighbours.nearest(asked, rows, "id", "nbr", "vector", 7, **args).collect()
    for i in range(0, 1500, 50):
        assert [(r["nbr"], round(r["sim"], 4)) for r in sorted((r for r in got if r["id"] == i), key=lambda r: r["rank"])] == best_of(x, i, 7)
    back = neighbours.nearest_queries(asked, rows, "id", "nbr", "vector", 3).collect()
    q = x[::50].astype(np.float64)
    for j in (1, 7, 50, 333):
        sim = np.round(q @ x[j].astype(np.float64), 4)
        want = sorted((50 * k for k in range(30) if 50 * k != j), key=lambda k: (-sim[k // 50], k))[:3]
        assert [r["id"] for r in sorted((r for r in back if r["nbr"] == j), key=lambda r: r["rank"])] == want


def test_index_holds_every_row_and_recalls(spark):
    x, df = vectors(spark, 3000)
    got = neighbours.knn_graph(df, "id", "nbr", "vector", 10, sample=1000, block=128).collect()
    found: dict = {}
    for r in got:
        found.setdefault(r["id"], set()).add(r["nbr"])
    assert set(found) == set(range(3000)) and all(len(n) == 10 for n in found.values())
    recall = np.mean([len(found[i] & {j for j, _ in best_of(x, i, 10)}) / 10 for i in range(0, 3000, 50)])
    assert recall >= 0.9


def test_index_recalls_on_the_given_vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    x = {r["vec_id"]: np.array(r["embedding"]) for r in rows.collect()}
    ids, m = sorted(x), np.stack([x[i] for i in sorted(x)])
    sim = np.round(m @ m.T, 4)
    found: dict = {}
    for r in neighbours.knn_graph(rows, "vec_id", "nbr", "embedding", 15, block=16).collect():
        found.setdefault(r["vec_id"], set()).add(r["nbr"])
    share = [len(found[i] & {ids[j] for j in sorted((j for j in range(len(ids)) if j != k), key=lambda j: (-sim[k, j], j))[:15]}) / 15 for k, i in enumerate(ids)]
    assert np.mean(share) >= 0.9


def test_neighbours_of_odd_tables(spark):
    schema = "id long, vector array<float>"
    empty = spark.createDataFrame([], schema)
    one = spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None)], schema)
    for df in (empty, one):
        assert neighbours.nearest(df, df.withColumnRenamed("id", "nbr"), "id", "nbr", "vector", 3).count() == 0
        assert neighbours.knn_graph(df, "id", "nbr", "vector", 3).count() == 0
        assert neighbours.nearest_queries(df, df.withColumnRenamed("id", "nbr"), "id", "nbr", "vector", 3).count() == 0


def test_terms_are_tagged_longest_first(spark):
    terms = [("red gear", 1), ("gear", 2), ("gear box", 3), ("RED", 4), ("c++", 5), ("é", 6)]
    docs = [(1, "Red gear box, gears and gear_x; a GEAR.", 9), (2, "gear box", 3), (3, None, 1), (4, "red  gear redgear c++x c++ é", 4), (5, "", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, own int")
    got = text.tag_terms(df, spark.createDataFrame(terms, "term string, value int"), exclude="own").collect()
    want = []
    for k, t, own in docs:
        use = sorted((x for x, v in terms if v != own), key=len, reverse=True)
        pattern = re.compile(r"\b(" + "|".join(map(re.escape, use)) + r")\b", re.IGNORECASE | re.ASCII)
        want += [(k, m.start(), m[0].lower()) for m in pattern.finditer(t or "")]
    assert sorted((r["doc_id"], r["offset"], r["term"]) for r in got) == sorted(want)
    assert text.tag_terms(df, spark.createDataFrame([], "term string, value int")).count() == 0


def find_page(excerpt: str, pages: list[tuple[int, str]]):
    """The rule in plain Python, on texts that are normalised already."""
    words = excerpt.split(" ")
    if len(excerpt) < 15:
        return None
    n = len(words)
    chunks = [words[n // 2 - 3 : n // 2 + 3] if n >= 8 else words[1 : min(5, n)] if n >= 4 else words]
    chunks += [words[:5], words[-5:]] if n >= 5 else []
    for tier, chunk in enumerate(chunks, 1):
        for page, body in pages:
            if len(body) > 10 and " ".join(chunk) in body:
                return tier, page
    return None


def test_pages_of_excerpts_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice([2, 5, 9, 17]))) for _ in range(60)]
    pages = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 40, 80])))) for i in range(40)]
    asked = []
    for _ in range(300):
        body = rng.choice(pages)[1]
        a = rng.randrange(max(1, len(body) - 5))
        piece = body[a : a + rng.randrange(8, 90)].strip()  # words at the edges may be cut
        asked.append(" ".join(piece.split(" ")) if rng.random() < 0.6 else " ".join([*piece.split(" ")[: rng.randrange(1, 7)], *("zz" for _ in range(rng.randrange(9)))]))
    asked += ["", "alpha", pages[3][1]]
    df = spark.createDataFrame(list(enumerate(asked)), "id long, text string")
    got = {r["id"]: (r["tier"], r["page"]) for r in text.containing_page(df, spark.createDataFrame(pages, "page long, text string"), "id").collect()}
    assert got == {i: f for i, t in enumerate(asked) if (f := find_page(t, pages))}
    assert {t for t, _ in got.values()} >= {1, 2}


def propose(new, new_members, old, old_members):
    """Migration in plain Python."""
    norm = lambda s: " ".join(re.findall("[a-z0-9]+", (s or "").lower()))
    names = lambda m: {norm(n) for n in m[3]} - {""}
    aliases = lambda c, ms: ({norm(c[2]), norm(c[4])} - {""}).union(*(names(m) for m in ms if m[0] == c[0]))
    mentions = {c[0]: c[5] for c in old}
    proposals = []
    for c in new:
        mine, found = aliases(c, new_members), None
        same = [o for o in old if o[1] == c[1]]
        by_id = [o[0] for o in same if c[3] and o[3] == c[3] and o[6]]
        if by_id:
            found = 0, max(by_id, key=lambda o: (mentions[o], -o)), 1000.0
        if not found:
            score: dict = {}
            for m in (m for m in new_members if m[0] == c[0]):
                for o in same:
                    for x in (x for x in old_members if x[0] == o[0] and x[1] == m[1]):
                        w = score.setdefault(o[0], [0, 0])
                        w[0] += x[2] == m[2]
                        w[1] += len(names(x) & names(m))
            score = {o: (3 * i + n, n, i) for o, (i, n) in score.items() if i or n}
            if score:
                o = max(score, key=lambda o: (*score[o], mentions[o], -o))
                w, n, i = score[o]
                theirs = aliases(next(x for x in old if x[0] == o), old_members)
                k = len(mine & theirs)
                if w >= 3 or n >= 2 or n >= 1 and i >= 1 or n == 1 and k >= 1 and norm(c[2]) in theirs:
                    found = 1, o, w + 0.1 * k
        if not found:
            hits = {o[0]: 1 for o in same if norm(o[4]) and norm(o[4]) in mine}
            if hits:
                found = 2, max(hits, key=lambda o: (mentions[o], -o)), 51.0
        if not found:
            hits = {o[0]: k for o in same if (k := len(mine & aliases(o, old_members)))}
            if hits:
                o = max(hits, key=lambda o: (hits[o], mentions[o], -o))
                found = (3, o, 10.0 + hits[o]) if hits[o] >= 2 else None
        if found and next(o for o in old if o[0] == found[1])[6]:
            proposals.append((*found, c))
    out, used = [], set()
    for at, o, s, c in sorted(proposals, key=lambda p: (p[0], -round(p[2], 6), -p[3][5], p[3][0])):
        if o not in used:
            used.add(o)
            out.append((c[0], o, ["wikidata", "member_overlap", "modern_name", "alias_match"][at], round(s, 6)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_migration_equals_plain_python(spark, seed):
    rng = random.Random(seed)
    words = ["rose", "Lily", "oak", "red-oak", "elm", "ivy", "fig", "yew", "ash", "bay"]

    def clusters(base, n, truth):
        c = [(base + i, rng.choice("PQ"), f"{rng.choice(words)} {rng.choice(words)}", rng.choice([None, None, None, "Q1", "Q2"]), rng.choice([None, None, rng.choice(words)]), rng.randrange(50), *([rng.random() < 0.7] if truth else [])) for i in range(n)]
        m = [(x[0], rng.randrange(12), rng.randrange(40), rng.sample(words, rng.randrange(0, 3)) + [x[2]] * (rng.random() < 0.5)) for x in c for _ in range(rng.randrange(0, 3))]
        return c, m

    (new, nm), (old, om) = clusters(0, 25, False), clusters(100, 20, True)
    kind = "cluster_id long, category string, canonical_name string, wikidata_id string, modern_name string, total_mentions long"
    member = "cluster_id long, book_id long, entity_id long, names array<string>"
    got = joins.migration_matches(spark.createDataFrame(new, kind), spark.createDataFrame(nm, member), spark.createDataFrame(old, kind + ", has_truth boolean"), spark.createDataFrame(om, member))
    assert sorted(tuple(r) for r in got.collect()) == propose(new, nm, old, om)


def test_person_patterns_and_co_citations(spark):
    people = [("galen", "Galen", ["Galen of Pergamon"], ["Galeno", "ga"], 9), ("x", "X", None, None, 8), ("ibn3", "Ibn", None, None, 7), ("paré", "A. Paré", ["Paré"], None, 5), ("avicenna", "Avicenna", None, ["avi"], 3)]
    patterns = joins.person_patterns(spark.createDataFrame(people, "person string, name string, aliases array<string>, variants array<string>, count long"))
    assert {r["person"] for r in patterns.collect()} == {"galen", "paré", "avicenna"}
    ex = [("galen", 1, "as PARÉ says"), ("galen", 2, "Paréx and galenus"), ("paré", 1, "galeno wrote"), ("paré", 2, "galen, Avicenna"), ("paré", 3, "Galen again"), ("paré", 4, "GALEN once more"), ("avicenna", 1, None)]
    got = {(r["source"], r["target"]): (r["weight"], r["excerpts"]) for r in joins.co_citations(spark.createDataFrame(ex, "person string, pos int, text string"), patterns).collect()}
    assert got == {("galen", "paré"): (5, ["as PARÉ says", "galeno wrote", "galen, Avicenna"]), ("avicenna", "paré"): (1, ["galen, Avicenna"])}
    top = joins.co_citations(spark.createDataFrame(ex, "person string, pos int, text string"), patterns, top_n=2)
    assert [r["source"] for r in top.collect()] == ["galen"]


def test_lead_sentences(spark):
    long = "First one here. Second? third stays with it. Fourth! Fifth. Sixth. Seventh. Eighth is cut"
    rows = [(1, f"short line\n{long}\n\nanother short"), (2, "tiny"), (3, None), (4, "A sentence that never ends but is long enough to stay")]
    got = {r["id"]: r["x"] for r in spark.createDataFrame(rows, "id int, t string").select("id", text.lead_sentences(F.col("t")).alias("x")).collect()}
    assert got[1] == "First one here. Second? third stays with it. Fourth! Fifth. Sixth. Seventh."
    assert got[2] == "" and got[3] is None and got[4] == rows[3][1]


def test_hashed_embeddings_depend_on_the_text_alone(spark, sf_dir):
    rows = s11(Views(spark, sf_dir)).collect()
    by_text: dict = {}
    entity = {r["id"]: (r["name"], r["category"], r["subcategory"]) for r in Views(spark, sf_dir).entity.collect()}
    assert {r["id"] for r in rows} == set(entity)
    for r in rows:
        v = np.array(r["embedding"])
        assert abs(np.linalg.norm(v) - 1) < 1e-5
        assert np.array_equal(by_text.setdefault(entity[r["id"]], v), v)
    a, b = list(by_text.values())[:2]
    assert not np.array_equal(a, b)


def test_system_prompt_states_its_limits(spark):
    one = spark.range(1).select(prompts.fallback_profile(F.lit("The College of Physicians"), F.lit("Pharmacopoeia"), F.lit(None), F.lit(1618)).alias("p"))
    entities = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(c).alias("category"), F.lit(k).alias("count")) for n, c, k in [("rose", "PLANT", 3), ("oak", "PLANT", 9), ("gout", "DISEASE", 2)]))
    said = one.select(prompts.system_prompt(F.col("p"), F.lit("Pharmacopoeia"), F.lit(1618), F.array(F.lit("Take of roses")), entities).alias("s")).first()["s"]
    assert "Knowledge ends in 1618" in said and "An institution speaks" in said and "- DISEASE (1 total): gout (2)\n- PLANT (2 total): oak (9), rose (3)" in said and '> "Take of roses"' in said


@pytest.mark.parametrize(("reply", "sure", "cited"), [(None, "low", []), ("no json", "low", []), ('{"response": "", "confidence": "high", "evidence_used": [{"entity_name": "ROSE"}, {"entity_id": "zz"}]}', "high", ["e1"])])
def test_replies_are_validated(spark, reply, sure, cited):
    ev = "array(named_struct('id','e1','category','PLANT','canonical_name','rose','local_name','rosa','names',array('rose'),'count',1L,'contexts',array('a|b'),'excerpts',cast(null as array<string>)))"
    df = spark.createDataFrame([(reply,)], "r string").withColumn("e", F.expr(ev))
    v = df.select(prompts.validated(prompts.parsed_reply(F.col("r")), F.col("e"), F.lit("a remedy for gout?")).alias("v")).first()["v"]
    assert v["confidence"] == sure and [u["entity_id"] for u in v["evidence_used"]] == cited
    assert v["response"].endswith("| rosa | PLANT | a/b |") and v["modern_note"] == ""


def test_first_k_gathers_k(spark):
    rows = [(i % 3, (i * 7) % 20, f"v{i}") for i in range(20)]
    got = ranking.first_k(spark.createDataFrame(rows, "g int, o int, v string"), ["g"], [F.col("o")], F.col("v"), 4, "vs").collect()
    assert {r["g"]: r["vs"] for r in got} == {g: [v for _, o, v in sorted((x for x in rows if x[0] == g), key=lambda x: x[1])][:4] for g in range(3)}


def test_near_duplicates_merge_into_the_largest(spark):
    rng = random.Random(3)
    names = [rng.choice(["cheiro", "cheyro", "cheir", "canela", "canella", "canelas", "goa", "gao"]) for _ in range(60)]
    rows = [(i, n, "PLACE" if i % 5 == 0 else "PLANT", rng.sample(range(6), rng.randrange(1, 3)), [n, rng.choice("xyz")]) for i, n in enumerate(names)]
    mentions = [(i, rng.randrange(8)) for i in range(60)]
    pairs = joins.near_duplicate_clusters(spark.createDataFrame(rows, "cluster_id long, canonical_name string, category string, books array<int>, names array<string>"))
    got = {r["cluster_id"]: r["keeper"] for r in graph.merge_near_duplicates(spark.createDataFrame(mentions, "cluster_id long, total_mentions long"), pairs).collect()}
    up = list(range(60))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in rows:
        for b in rows:
            sim = 1 - distance(a[1], b[1]) / max(len(a[1]), len(b[1]))
            if a[0] < b[0] and a[2] == b[2] and round(sim, 6) >= (0.85 if a[2] == "PLACE" else 0.83) and (set(a[3]) & set(b[3]) or sim == 1 and set(a[4]) & set(b[4])):
                up[find(a[0])] = find(b[0])
    groups: dict = {}
    for i in range(60):
        groups.setdefault(find(i), []).append(i)
    want = {i: min(g, key=lambda k: (-mentions[k][1], k)) for g in groups.values() if len(g) > 1 for i in g}
    assert got == want and len(set(want.values())) < len(want)
