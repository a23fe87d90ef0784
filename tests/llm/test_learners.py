"""Toxicity (op5), language (op9) and quality (op3): held-out accuracy, folds and odd tables."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwright.llm import language, quality, toxicity
from loomwright.llm.linear import fit_dense_logistic, fit_sparse_logistic, sigmoid

from .conftest import DOCS, prose


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    """Documents of which some are insulting, and some are junk."""
    rng, docs, labels = random.Random(4), [], []
    for i in range(400):
        lang = "en" if i % 3 else "de"
        words = prose(rng, lang, rng.choice([20, 80, 300])).split()
        toxic, junk = i % 6 == 1, i % 5 == 2
        if junk:
            words = [w for w in words for _ in range(8)][: len(words)]
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["moronic", "worthless", "idiot"]))
        docs.append((i, " ".join(words), lang, f"s{i % 5}", 0))
        if i % 4:
            labels.append((i, int(not junk), int(toxic)))
    docs = [(a, b, c, d, len(b)) for a, b, c, d, _ in docs]
    path = tmp_path_factory.mktemp("labelled")
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), {d: (q, t) for d, q, t in labels}, {r[0]: r[2] for r in docs}


def fold(key, n):
    return zlib.crc32(str(key).encode()) % n


def test_logistic_regressions_agree():
    rng = np.random.default_rng(0)
    x = (rng.random((300, 6)) < 0.4).astype(float)
    y = (x @ np.array([2.0, -1, 0, 0, 1, 0]) + rng.normal(0, 0.5, 300) > 0.7).astype(float)
    r, c = np.nonzero(x)
    w, b = fit_sparse_logistic(r, c, np.ones(len(r)), y, 6, 1e-2, steps=3000)
    d = fit_dense_logistic(x, y, np.full(300, 1 / 300), 1e-2)
    assert np.allclose(w, d[:6], atol=0.05) and abs(b - d[6]) < 0.05
    assert ((sigmoid(x @ w + b) > 0.5) == y).mean() > 0.85


def test_toxicity_finds_insults(spark, labelled):
    path, truth, _ = labelled
    got = toxicity.op5_toxicity(spark, path).collect()
    assert len(got) == 400 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["predicted"] == truth[r["doc_id"]][1] for r in held)


def test_held_out_labels_are_not_learnt(spark, labelled):
    path, _, _ = labelled
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    assert a == {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, turned).collect()}


def test_toxicity_of_odd_tables(spark, labelled, docs, rows, empty, all_null, clashing):
    path, _, _ = labelled
    labels = spark.read.parquet(f"{path}/labels.parquet")
    base = spark.read.parquet(f"{path}/documents.parquet")
    model = toxicity.fit(*toxicity.training_sample(base, labels, 5, 0, 1500, 3000, 12_000_000))
    assert toxicity.scored(empty, model).count() == 0
    assert len({r["score"] for r in toxicity.scored(all_null, model).collect()}) == 1
    done = toxicity.scored(clashing, model)
    assert sorted(done.columns) == sorted(clashing.columns) and done.where("score is null").count() == 0 and done.count() == len(rows)
    none = toxicity.toxicity(docs, labels.where("toxic = 0")).collect()
    assert all(r["score"] < 0.5 for r in none)
    assert toxicity.toxicity(docs, labels.limit(0)).where("score <> 0.5").count() == 0


@pytest.mark.parametrize("kind", ["none", "one toxic", "no clean", "null"])
def test_toxic_stage_without_a_model_keeps_all(spark, tmp_path, docs, rows, kind):
    """Where nothing can be learnt nothing is rejected."""
    labels = {"none": [], "one toxic": [(1, 1, 1)] + [(i, 1, 0) for i in range(2, 40)], "no clean": [(i, 1, 1) for i in range(40)], "null": [(i, None, None) for i in range(40)]}[kind]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = toxicity.stage(spark, docs, str(tmp_path))
    assert kept.count() == len(rows) and kept.columns == docs.columns


def plain_grams(text):
    """Folded n-grams of a text: lower-case letters and marks, anything else a single space."""
    import unicodedata

    folded = " " + "".join((c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] in "LM" else " " for c in text) + " "
    while "  " in folded:
        folded = folded.replace("  ", " ")
    return {folded[i : i + n] for n in toxicity.ORDERS for i in range(len(folded) - n + 1)}


def test_toxicity_model_equals_plain_counts():
    """Vocabulary, log-count ratios and scores against dictionaries of n-grams and a dense regression."""
    rng = random.Random(2)
    texts, y = [], []
    for i in range(120):
        words = prose(rng, "de" if i % 3 == 0 else "en", rng.randrange(5, 40)).split()
        if i % 4 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["Idiot!", "MORONIC", "wörthless"]))
        texts.append(" ".join(words))
        y.append(float(i % 4 == 0))
    y = np.array(y)
    model = toxicity.fit(texts, y)
    grams = [plain_grams(t) for t in texts]
    n1, n0 = y.sum(), (1 - y).sum()
    count = {}
    for g, t in zip(grams, y, strict=True):
        for x in g:
            c = count.setdefault(x, [0, 0])
            c[int(t)] += 1
    often = {x: c for x, c in count.items() if c[1] >= max(2, min(5, int(n1) // 40))}

    def z(c):
        both = (c[1] + c[0] + 1) / (n1 + n0 + 2)
        return abs(c[1] / n1 - c[0] / n0) / np.sqrt(both * (1 - both) * (1 / n1 + 1 / n0))

    least = min(4.0, sorted(map(z, often.values()))[-min(len(often), 50)])
    vocabulary = sorted(x for x, c in often.items() if z(c) >= least - 1e-12)
    assert len(vocabulary) == len(model.keys)
    ratio = np.array([np.log(((count[x][1] + 1) / (n1 + 2)) / ((count[x][0] + 1) / (n0 + 2))) for x in vocabulary])
    rows, cols = map(np.array, zip(*((i, k) for i, g in enumerate(grams) for k, x in enumerate(vocabulary) if x in g), strict=True))
    w, b = fit_sparse_logistic(rows, cols, ratio[cols], y, len(vocabulary), 1e-4)
    want = sigmoid(np.bincount(rows, (w * ratio)[cols], len(texts)) + b)
    assert np.allclose(model.score(pa.array(texts), toxicity.sieve_of(model.keys)), want, atol=1e-4)


def test_toxic_stage_keeps_clean_documents(spark, labelled):
    path, truth, _ = labelled
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = toxicity.stage(spark, docs, path)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns
    assert all((k in ids) == (not t) for k, (_, t) in truth.items())


def test_languages_are_told_apart(spark, labelled):
    path, _, langs = labelled
    got = language.op9_language(spark, path).collect()
    assert len(got) == 400 and all(r["held_out"] == (fold(r["doc_id"], 4) == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.97


def test_language_of_odd_tables(spark, docs, empty, all_null, clashing):
    assert language.languages(empty).count() == 0
    assert {(r["lang_pred"], r["score"]) for r in language.languages(all_null).collect()} == {("und", 0.0)}
    got = language.languages(clashing).collect()
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert by[75] == by[76] == by[77] == by[78] == "und" and by[0] in ("en", "de")
    assert all(0 <= r["score"] <= 1 for r in got)


def test_letters_of_any_script():
    texts = ["a", "1!", "\U0001f600", "\U00010400", "\u0301", "日", None, ""]
    assert language.has_letter(pa.array(texts)).tolist() == [True, False, False, True, False, True, False, False]


def test_kernel_is_symmetric_and_normed():
    x, letters = language.spectra(pa.array(["the river", "der fluss", "the river", "123"]))
    k = x @ x.T
    assert np.allclose(k, k.T) and np.allclose(np.diag(k)[:3], 1, atol=1e-5) and np.isclose(k[0, 2], 1, atol=1e-5)
    assert letters.tolist() == [True, True, True, False]


def plain_spectrum(text):
    import unicodedata

    folded = " " + "".join((c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] in "LM" else " " for c in text) + " "
    while "  " in folded:
        folded = folded.replace("  ", " ")
    return {n: {folded[i : i + n] for i in range(len(folded) - n + 1)} for n in language.BUCKETS}


def test_kernels_equal_sets_of_n_grams(labelled, spark):
    """Hashed presence kernels against cosines of the n-gram sets themselves."""
    path, _, _ = labelled
    texts = [r["text"][:400] for r in spark.read.parquet(f"{path}/documents.parquet").limit(40).collect()]
    x, _ = language.spectra(pa.array(texts))
    sets = [plain_spectrum(t) for t in texts]
    cos = lambda a, b: len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1))
    want = np.array([[np.mean([cos(a[n], b[n]) for n in language.BUCKETS]) for b in sets] for a in sets])
    assert np.abs(x @ x.T - want).max() < 0.05  # some n-grams share a bucket


def test_language_model_equals_exact_kernel_ridge(labelled, spark):
    """With every text a landmark, Nystroem features and the primal solution are kernel ridge regression itself."""
    path, _, langs = labelled
    rows = spark.read.parquet(f"{path}/documents.parquet").where("doc_id < 60").orderBy("doc_id").collect()
    texts, names = [r["text"] for r in rows], [r["lang"] for r in rows]
    ridge = 1e-3
    model = language.fit(texts, names, landmarks=1000, ridge=ridge)
    x = language.spectra(pa.array(texts))[0].astype(np.float64)
    k = x @ x.T
    n = len(texts)
    h = np.eye(n) - 1 / n
    y = np.where(np.array(names)[:, None] == np.array(sorted(set(names)))[None, :], 1.0, -1.0)
    alpha = np.linalg.solve(h @ k @ h + ridge * n * np.eye(n), y - y.mean(axis=0))
    other = spark.read.parquet(f"{path}/documents.parquet").where("doc_id >= 60").limit(50).collect()
    z = language.spectra(pa.array([r["text"] for r in other]))[0].astype(np.float64)
    centred = (z @ x.T - k.mean(axis=0)) @ h
    want = centred @ alpha + y.mean(axis=0)
    got = (z @ model.landmarks.T.astype(np.float64)) @ model.weights + model.centre
    assert np.abs(got - want).max() < 0.02
    assert [sorted(set(names))[i] for i in got.argmax(axis=1)] == [langs[r["doc_id"]] for r in other]


def test_rare_languages_stay_within_bounds(spark):
    rows = [(i, f"word{i} and more of it", f"l{i % 40}") for i in range(400)]
    texts, langs = language.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 4, 2, 3000, 12_000_000, 120_000, 7)
    assert len(set(langs)) == 7 and len(language.fit(texts, langs, landmarks=4).landmarks) == 7


def test_quality_picks_equal_a_pool_in_memory(spark, labelled):
    """Co-training over all documents in Spark against the same rounds over arrays."""
    path, _, _ = labelled
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    got = {r["doc_id"]: (r["score"], r["text_score"], r["meta_score"]) for r in quality.quality(docs, labels, per_round=7, rounds=4).collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    key = {r["doc_id"]: r["k"] for r in docs.select("doc_id", F.xxhash64("doc_id").alias("k")).collect()}
    rows = {r["doc_id"]: r for r in docs.collect()}

    def features(ids):
        text = quality.text_features(pa.array([rows[i]["text"] for i in ids], pa.string())).astype(np.float32).astype(float)
        meta = quality.meta_features([rows[i]["lang"] for i in ids], [rows[i]["source"] for i in ids], [rows[i]["n_chars"] for i in ids])
        meta[:, -2] = meta[:, -2].astype(np.float32)
        return text, meta

    learn = sorted((i for i in rows if fold(i, 5)), key=lambda i: (key[i], i))
    train, free = [i for i in learn if i in known], [i for i in learn if i not in known]
    model = quality.co_train(*features(train), np.array([known[i] for i in train], float), *features(free), rounds=4, per_round=7)
    ids = sorted(rows)
    want = np.column_stack(model.score(*features(ids)))
    assert np.abs(np.array([got[i] for i in ids]) - want).max() < 1e-6


def test_quality_of_held_out_documents(spark, labelled):
    path, truth, _ = labelled
    got = quality.op3_quality(spark, path).collect()
    assert len(got) == 400 and all(0 <= r[c] <= 1 for r in got for c in ("score", "text_score", "meta_score"))
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]][0] for r in held]) > 0.95


def test_views_teach_each_other():
    rng = np.random.default_rng(3)
    y = (rng.random(600) < 0.5).astype(float)
    text, meta = rng.normal(0, 1, (600, 3)), np.zeros((600, 4))
    text[:, 0] += 3 * (2 * y - 1)
    meta[np.arange(600), (y + 2 * (rng.random(600) < 0.5)).astype(int)] = 1
    few = np.arange(20)
    alone = quality.co_train(text[few], meta[few], y[few], text[:0], meta[:0])
    taught = quality.co_train(text[few], meta[few], y[few], text[20:], meta[20:])
    right = lambda m: ((m.score(text[20:], meta[20:])[0] >= 0.5) == y[20:]).mean()
    assert right(taught) >= right(alone) - 0.01 and right(taught) > 0.97


def test_quality_of_odd_tables(spark, labelled, docs, rows, empty, all_null, clashing):
    path, _, _ = labelled
    labels = spark.read.parquet(f"{path}/labels.parquet")
    assert quality.quality(empty, labels).count() == 0
    assert quality.quality(all_null, labels).count() == 3
    assert quality.quality(clashing, labels.limit(0)).where("score <> 0.5").count() == 0
    assert quality.quality(docs, labels).where("score is null").count() == 0
