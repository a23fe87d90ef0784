"""Quality scores by co-training a text view and a page-metadata view.

Two logistic regressions are fitted on labelled documents: one sees statistics of the text alone, the other sees
metadata alone (language, source, recorded length). Over several rounds each scores all unlabelled documents, and the
ones that it is most sure of enter the *other's* training set with its answer. Afterwards each view's log odds are
calibrated on labelled documents that neither was fitted on, and a second small regression on those documents combines
them. All documents are then scored in Arrow batches.

Features are taken from the texts once and stored, some hundred bytes a document. Fitting runs on the driver over a
bounded, hash-ordered sample of labelled documents (max_labelled) and the pseudo-labels, at most per_round a round, view
and label; the candidates for those are ranked in Spark, over all unlabelled documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, bound_batches, id_crc, read_table, remove, slices, store
from .linear import fit_dense_logistic, sigmoid

BUCKETS = 64
_KINDS = np.zeros(256, np.int64)  # lower case and bytes beyond ASCII, upper case, digit, space, line feed, stop, other mark
_KINDS[65:91], _KINDS[48:58], _KINDS[[9, 11, 12, 13, 32]], _KINDS[10] = 1, 2, 3, 4
_KINDS[[33, 46, 63, 44]] = 5
_KINDS[[i for i in range(128) if chr(i).isprintable() and not chr(i).isalnum() and chr(i) not in " !.?,"]] = 6


def text_features(column: pa.Array) -> np.ndarray:
    """Shares of kinds of characters and words, and lengths, of each text; zeros for a null or empty one."""
    w = Words(column)
    rows, size = len(column), np.diff(w.byte_offs)
    counts = np.zeros((rows, 7))
    row = np.repeat(np.arange(rows), size)
    np.add(counts, np.bincount(row * 7 + _KINDS[w.raw], minlength=rows * 7).reshape(rows, 7), out=counts)
    shares = counts / np.maximum(size, 1)[:, None]
    n = np.diff(w.offs)
    word_row = np.repeat(np.arange(rows), n)
    some = np.maximum(n, 1)
    order = np.lexsort((w.hashes, word_row))
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = (w.hashes[order][1:] != w.hashes[order][:-1]) | (word_row[order][1:] != word_row[order][:-1])
    distinct = np.bincount(word_row[order][new], minlength=rows)
    again = np.zeros(len(w.hashes), bool)
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (word_row[1:] == word_row[:-1])
    lens = w.end - w.start
    mean = np.bincount(word_row, lens, rows) / some
    single = np.bincount(word_row, lens == 1, rows) / some
    short = np.bincount(word_row, (lens > 1) & (lens <= 4), rows) / some
    columns = [
        shares,
        mean / 10,
        single,
        short,
        distinct / some,
        np.bincount(word_row, again, rows) / some,
        np.log1p(n) / 10,
        (n < 20).astype(float),
        (n == 0).astype(float),
    ]
    return np.column_stack(columns)


def meta_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Language and source by hashed bucket (null: one of its own), and the recorded length."""
    out = np.zeros((len(lang), 2 * BUCKETS + 2))
    for i, (a, b, n) in enumerate(zip(lang, source, n_chars, strict=True)):
        out[i, zlib.crc32(str(a).encode()) % BUCKETS] = 1
        out[i, BUCKETS + zlib.crc32(str(b).encode()) % BUCKETS] = 1
        out[i, -2] = 0.0 if n is None else np.log1p(max(n, 0)) / 10
        out[i, -1] = n is None
    return out


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -20, 20)


@dataclass
class Model:
    """The coefficients of the two views and of their combination, and the text features' means and deviations."""

    text: np.ndarray
    meta: np.ndarray
    calibrated: tuple[np.ndarray, np.ndarray]
    combined: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined, text and metadata scores."""
        a = _odds((text - self.mean) / self.scale, self.text) * self.calibrated[0][0] + self.calibrated[0][1]
        b = _odds(meta, self.meta) * self.calibrated[1][0] + self.calibrated[1][1]
        return sigmoid(_odds(np.column_stack([a, b]), self.combined)), sigmoid(a), sigmoid(b)


#: From the two views' coefficients: for each view, the rows it is surest of, as (id, text features, meta features) by label.
Pick = Callable[[list[np.ndarray], np.ndarray, np.ndarray], list[dict[float, list[tuple[int, np.ndarray, np.ndarray]]]]]


def co_train(
    text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = 5, per_round: int = 500, sure: float = 0.95, l2: float = 1.0
) -> Model:
    """co_train_on() with a pool in memory."""
    free = [np.ones(len(pool_text), bool), np.ones(len(pool_text), bool)]

    def pick(fitted: list[np.ndarray], mean: np.ndarray, scale: np.ndarray):
        out = []
        for v, view in enumerate(((pool_text - mean) / scale, pool_meta)):
            p, chosen = sigmoid(_odds(view, fitted[v])), {}
            for label, belief in ((1.0, p), (0.0, 1 - p)):
                good = np.flatnonzero((belief >= sure) & free[1 - v])
                good = good[np.argsort(-belief[good], kind="stable")][:per_round]
                free[1 - v][good] = False
                chosen[label] = [(int(i), pool_text[i], pool_meta[i]) for i in good]
            out.append(chosen)
        return out

    return co_train_on(text, meta, y, pick if len(pool_text) else None, rounds, l2)


def co_train_on(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pick: Pick | None, rounds: int = 5, l2: float = 1.0) -> Model:
    """y: 0 or 1. A fifth of the labelled rows calibrates. Without rows of both kinds the share of ones is the score.

    What pick() answers for one view is put into the training rows of the other.
    """
    mean = text.mean(axis=0) if len(text) else np.zeros(text.shape[1])
    scale = np.maximum(text.std(axis=0), 1e-3) if len(text) else np.ones(text.shape[1])
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        none = np.zeros(text.shape[1] + 1), np.zeros(meta.shape[1] + 1)
        return Model(*none, (np.zeros(2), np.zeros(2)), np.array([0, 0, np.log(share / (1 - share))]), mean, scale)
    views = [(text - mean) / scale, meta]
    aside = np.arange(len(y)) % 5 == 4
    if len(set(y[aside].tolist())) < 2 or len(set(y[~aside].tolist())) < 2:
        aside = np.zeros(len(y), bool)
    fitted = [np.zeros(v.shape[1] + 1) for v in views]
    extra: list[list[tuple[np.ndarray, float]]] = [[], []]
    for turn in range(rounds + 1):
        for v in (0, 1):
            x = np.concatenate([views[v][~aside], *(row[None, :] for row, _ in extra[v])])
            t = np.concatenate([y[~aside], [label for _, label in extra[v]]])
            # pseudo-labels weigh less, all together no more than the labelled rows
            light = min(0.5, (~aside).sum() / max(len(extra[v]), 1))
            weight = np.concatenate([np.ones((~aside).sum()), np.full(len(extra[v]), light)])
            fitted[v] = fit_dense_logistic(x, t, weight, l2)
        if turn == rounds or pick is None:
            break
        found = pick(fitted, mean, scale)
        for v in (0, 1):
            for label, rows in found[v].items():
                extra[1 - v] += [((a - mean) / scale if v == 1 else b, label) for _, a, b in rows]
        if not any(rows for view in found for rows in view.values()):
            break
    held = aside if aside.any() else np.ones(len(y), bool)
    one = np.ones(held.sum())
    lines = tuple(fit_dense_logistic(_odds(views[v][held], fitted[v])[:, None], y[held], one, 1e-2) for v in (0, 1))
    both = np.column_stack([_odds(views[v][held], fitted[v]) * lines[v][0] + lines[v][1] for v in (0, 1)])
    return Model(fitted[0], fitted[1], lines, fit_dense_logistic(both, y[held], one, 1e-2), mean, scale)


WIDTH = text_features(pa.array([""])).shape[1]
FEATURES = "doc_id {kind}, key long, pooled boolean, x array<float>, lang_slot int, source_slot int, chars float"


def _dense(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Text and metadata features of stored rows."""
    cols = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True)}
    x = cols["x"].flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, WIDTH)
    meta = np.zeros((batch.num_rows, 2 * BUCKETS + 2))
    at = np.arange(batch.num_rows)
    meta[at, cols["lang_slot"].to_numpy()] = 1
    meta[at, BUCKETS + cols["source_slot"].to_numpy()] = 1
    chars = cols["chars"].to_numpy(zero_copy_only=False)  # null: NaN
    meta[:, -2], meta[:, -1] = np.nan_to_num(chars), np.isnan(chars)
    return x, meta


def stored_features(docs: DataFrame, folds: int, held_out: int) -> DataFrame:
    """See FEATURES, one row per row of docs; pooled: whether it may be learnt from. The texts are read once."""
    key = F.xxhash64("doc_id")
    may = F.coalesce(id_crc(F.col("doc_id")) % folds != held_out, F.lit(False))
    schema = FEATURES.format(kind=docs.schema["doc_id"].dataType.simpleString())

    def make(batches):
        for batch in slices(batches, "text", 1 << 19):
            cols = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            meta = meta_features(*(cols[c].to_pylist() for c in ("lang", "source", "n_chars")))
            flat = text_features(cols["text"]).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * WIDTH), pa.array(flat.reshape(-1)))
            slots = [pa.array(meta[:, a : a + BUCKETS].argmax(axis=1).astype(np.int32)) for a in (0, BUCKETS)]
            chars = pa.array(np.where(meta[:, -1] > 0, 0, meta[:, -2]).astype(np.float32), mask=meta[:, -1] > 0)
            yield pa.RecordBatch.from_arrays([cols["doc_id"], cols["key"], cols["pooled"], lists, *slots, chars], names=["doc_id", "key", "pooled", "x", "lang_slot", "source_slot", "chars"])

    made = docs.select("doc_id", key.alias("key"), may.alias("pooled"), "text", "lang", "source", "n_chars").mapInArrow(make, schema)
    return store(made, "quality-features")[0]


def labelled_rows(features: DataFrame, labels: DataFrame, max_labelled: int) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """The labelled ids and, of a bounded hash-ordered sample of them, the features of both views and the labels.

    Labels of one doc_id that differ count as low quality.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("known_id")).agg(F.min("quality").cast("int").alias("quality"))
    rows = features.where("pooled").join(known, F.col("doc_id") == F.col("known_id"))
    first = rows.dropDuplicates(["doc_id"]).orderBy("key", "doc_id").limit(max_labelled)
    table = first.select("quality", "x", "lang_slot", "source_slot", "chars", "key", "doc_id").toArrow().sort_by([("key", "ascending"), ("doc_id", "ascending")])
    y = table.column("quality").to_numpy().astype(float)
    if not len(y):
        return known, np.zeros((0, WIDTH)), np.zeros((0, 2 * BUCKETS + 2)), y
    return known, *_dense(table.combine_chunks().to_batches()[0]), y


def pick_in_spark(pool: DataFrame, per_round: int, sure: float) -> Pick:
    """Ranks all rows of the pool, a row of it at most once for each view. Only the chosen rows reach the driver; rows
    with equal keys, which repeat a doc_id, are taken together or not at all."""
    taken: list[set[int]] = [set(), set()]
    best = "v int, label double, belief double, key long, x array<float>, lang_slot int, source_slot int, chars float"

    def pick(fitted: list[np.ndarray], mean: np.ndarray, scale: np.ndarray):
        sent = [np.array(sorted(t), np.int64) for t in taken]

        def candidates(batches):
            for batch in batches:
                x, meta = _dense(batch)
                key = batch.column(0).to_numpy()
                for v, view in enumerate(((x - mean) / scale, meta)):
                    p, free = sigmoid(_odds(view, fitted[v])), ~np.isin(key, sent[1 - v])
                    for label, belief in ((1.0, p), (0.0, 1 - p)):
                        good = np.flatnonzero((belief >= sure) & free)
                        good = good[np.lexsort((key[good], -belief[good]))][:per_round]
                        rows = batch.take(pa.array(good))
                        head = [pa.array(np.full(len(good), v, np.int32)), pa.array(np.full(len(good), label)), pa.array(belief[good])]
                        yield pa.RecordBatch.from_arrays([*head, *rows.columns], names=["v", "label", "belief", *rows.schema.names])

        ranked = pool.select("key", "x", "lang_slot", "source_slot", "chars").mapInArrow(candidates, best)
        order = Window.partitionBy("v", "label").orderBy(F.desc("belief"), "key")
        table = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_round).orderBy("v", "label", "rank").toArrow()
        out: list[dict] = [{1.0: [], 0.0: []}, {1.0: [], 0.0: []}]
        for batch in table.combine_chunks().to_batches():
            x, meta = _dense(batch)
            for i, (v, label, key) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True)):
                if key not in taken[1 - v]:
                    taken[1 - v].add(key)
                    out[v][label].append((key, x[i], meta[i]))
        return out

    return pick


def quality(
    docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, rounds: int = 5, per_round: int = 500, sure: float = 0.95, folds: int = 5, held_out: int = 0
) -> DataFrame:
    """doc_id, score, text_score, meta_score (0 to 1, higher: better) for every row of docs.

    docs has doc_id, text, lang, source, n_chars, any of which may be null; other columns are not read. Null and empty
    texts have zero text features. Rows that repeat are scored alike. Rows without a doc_id and the fold held out are
    learnt from in no way. Without labels of both kinds every score is the smoothed share of good labels.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    features = stored_features(docs, folds, held_out)
    known, text, meta, y = labelled_rows(features, labels, max_labelled)
    pool = features.where("pooled").join(known.select("known_id"), F.col("doc_id") == F.col("known_id"), "left_anti")
    pool, path = store(pool.select("key", "x", "lang_slot", "source_slot", "chars"), "quality-pool")
    model = co_train_on(text, meta, y, pick_in_spark(pool, per_round, sure), rounds)
    remove(docs.sparkSession, path)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            made = [pa.array(s) for s in sent.value.score(*_dense(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "score", "text_score", "meta_score"])

    fields = [docs.schema["doc_id"], *(T.StructField(c, T.DoubleType()) for c in ("score", "text_score", "meta_score"))]
    return features.select("doc_id", "x", "lang_slot", "source_slot", "chars").mapInArrow(score, T.StructType(fields))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    held = F.coalesce(id_crc(F.col("doc_id")) % 5 == 0, F.lit(False))
    return done.select("doc_id", held.alias("held_out"), "score", "text_score", "meta_score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
