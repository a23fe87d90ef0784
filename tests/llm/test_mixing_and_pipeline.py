"""Mixing (op2) against brute force, and the pipeline's stages in order."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomwright.llm import mixing
from loomwright.llm.tokenise import tokenizer_path

from .conftest import DOCS
from .test_dedup import brute, components


def n_tokens(text):
    return len(re.findall(r"[^ \t\n\x0b\f\r]+", text or ""))


def test_exponent_meets_entropy_and_repetition():
    shares = [0.7, 0.1, 0.1, 0.05, 0.05]
    a = mixing.solve_exponent(shares, 1.0, 0.95, 100)
    assert abs(mixing.entropy(mixing.weights_at(shares, a)) - 0.95) < 1e-6
    a = mixing.solve_exponent(shares, 1.0, 0.99, 1.5)
    assert max(w / s for w, s in zip(mixing.weights_at(shares, a), shares, strict=True)) <= 1.5 + 1e-9
    assert mixing.solve_exponent([0.5, 0.5], 1.0, 0.9, 4) == 1.0 and mixing.solve_exponent([1.0], 1.0, 0.9, 4) == 1.0


@pytest.mark.parametrize("budget", [None, 700, 20_000, 60_000])
def test_quotas_are_met(spark, clean, budget):
    df = spark.createDataFrame(clean, DOCS).repartition(3)
    got = mixing.mixed(df, budget_tokens=budget, max_repeat=10.0, block_tokens=300).collect()
    size = {r[0]: n_tokens(r[1]) for r in clean}
    total = Counter()
    for r in clean:
        total[r[3]] += size[r[0]]
    live = [s for s in total if total[s]]
    shares = [total[s] / sum(total.values()) for s in live]
    b = sum(total.values()) if budget is None else budget
    weight = mixing.weights_at(shares, mixing.solve_exponent(shares, b / sum(total.values()), 0.95, 10.0))
    used = Counter()
    for g in got:
        assert g["mix_tokens"] == size[g["doc_id"]]
        used[g["source"]] += g["mix_tokens"]
    for s, w in zip(live, weight, strict=True):
        quota = round(w * b)
        longest = max(size[r[0]] for r in clean if r[3] == s)
        assert quota - longest < used[s] <= quota
        copies = Counter(g["doc_id"] for g in got if g["source"] == s)
        whole = quota // total[s]
        assert all(whole <= copies[r[0]] <= whole + 1 for r in clean if r[3] == s and size[r[0]])
        assert len({(g["doc_id"], g["mix_epoch"]) for g in got if g["source"] == s}) == sum(copies.values())
    assert all(0 <= g["mix_at"] <= 1 for g in got)


def test_more_sources_than_the_driver_takes(spark, clean):
    """The same mixture whether the exponent is solved on the driver or by aggregations."""
    df = spark.createDataFrame(clean, DOCS).repartition(3)
    key = lambda r: (r["doc_id"], r["mix_epoch"], r["mix_block"], round(r["mix_weight"], 9), round(r["mix_at"], 6))
    few, many = (sorted(map(key, mixing.mixed(df, max_sources=m, max_repeat=3.0, block_tokens=300).collect())) for m in (100, 2))
    assert few == many and few


def test_epochs_are_other_permutations(spark):
    rows = [(i, f"word{i} and more", "en", "s", 1) for i in range(200)]
    got = mixing.mixed(spark.createDataFrame(rows, DOCS), budget_tokens=1200, block_tokens=30, max_repeat=2.0).collect()
    order = [[g["mix_block"] for g in sorted((g for g in got if g["mix_epoch"] == e), key=lambda g: g["mix_at"])] for e in (0, 1)]
    assert len(got) == 400 and order[0] != order[1] and sorted(order[0]) == sorted(order[1])


def test_mixing_odd_tables(spark, docs, rows, empty, all_null, clashing):
    assert mixing.mixed(empty).count() == 0
    assert mixing.mixed(all_null).count() == 3
    done = mixing.mixed(clashing)
    assert set(clashing.columns) <= set(done.columns)
    assert mixing.stage(spark, clashing, "").columns == clashing.columns
    assert not math.isnan(done.agg(F.sum("mix_weight")).first()[0])


def test_op2_query(spark, tables, clean):
    """Weights, quotas and epochs of the query against brute force."""
    got = mixing.op2_mixing(spark, tables)
    assert "text" not in got.columns
    rows, size, total = got.collect(), {r[0]: n_tokens(r[1]) for r in clean}, Counter()
    for r in clean:
        total[r[3]] += size[r[0]]
    live = [s for s in total if total[s]]
    shares = [total[s] / sum(total.values()) for s in live]
    a = mixing.solve_exponent(shares, 1.0, 0.95, 2.0)
    raw = [s**a for s in shares]
    for s, weight in zip(live, (r / sum(raw) for r in raw), strict=True):
        mine = [g for g in rows if g["source"] == s]
        quota = round(weight * sum(total.values()))
        used = sum(g["mix_tokens"] for g in mine)
        assert all(abs(g["mix_weight"] - weight) < 1e-9 and g["mix_tokens"] == size[g["doc_id"]] for g in mine)
        assert quota - max(size[r[0]] for r in clean if r[3] == s) < used <= quota
        copies = Counter(g["doc_id"] for g in mine if size[g["doc_id"]])
        assert max(copies.values()) - min(copies[r[0]] for r in clean if r[3] == s and size[r[0]]) <= 1
        assert max(copies.values()) <= math.ceil(2.0)
    none = [s for s in total if not total[s]]
    assert Counter(g["doc_id"] for g in rows if g["source"] in none) == Counter(r[0] for r in clean if r[3] in none)


def test_stages_in_order(spark, tables, clean):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    seen = [tuple(r) for r in stage["near_dedup"](spark, docs, tables).collect()]
    assert {r[0] for r in seen} == {c for _, c in components(sorted(clean), 5).values()}
    cut = stage["substring_dedup"](spark, spark.createDataFrame(seen, DOCS), tables)
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {k: t for k, (t, _) in brute(seen).items()}
    packed = stage["packing"](spark, cut, tables)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = sum(len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in cut.collect())
    assert packed.agg(F.sum("length")).first()[0] == want


def test_pipeline_runs(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert out.count() > 0 and corpus_pipeline.ORACLE_SQL is None
    full = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.first("window").alias("w")).where("n <> w").count()
    assert full == 0
