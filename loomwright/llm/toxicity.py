"""Toxicity scores by a character n-gram linear classifier on naive-Bayes-scaled features.

A text is folded to lower-case letters with single spaces between words. Its features are the presence of character
n-grams (orders ORDERS), scaled by the log ratio of their smoothed document counts in toxic and clean training texts;
a logistic regression weighs the scaled features. Counts that chance explains are left out of the vocabulary.

Fitting reads a bounded sample of labelled rows (max_toxic, max_clean, max_chars), taken in the order of a hash of
doc_id, and runs on the driver. Scoring reads every whole text, in Arrow batches, with the vocabulary as a broadcast of
at most max_features entries.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, code_points, fresh, id_crc, read_table, slices
from .linear import fit_sparse_logistic, sigmoid

ORDERS = (3, 5, 7)
_SIEVE_BITS = 22


@functools.cache
def _folding() -> np.ndarray:
    """Code point below 65536 to its lower-case letter, or to a space."""
    table = np.full(1 << 16, 32, np.uint32)
    for i in range(1 << 16):
        if unicodedata.category(chr(i))[0] in "LM":
            low = chr(i).lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all rows, each led by a space and parted by zeros, and each row's start."""
    points, offs = code_points(column)
    pad = max(ORDERS)
    rows = len(offs) - 1
    wide = np.zeros(len(points) + rows * (pad + 2) + pad, np.uint32)
    shift = np.arange(rows) * (pad + 2)
    wide[offs[:-1] + shift] = 32
    at = np.arange(len(points)) + np.repeat(shift + 1, np.diff(offs))
    wide[at] = np.where(points < 1 << 16, _folding()[np.minimum(points, (1 << 16) - 1)], points)
    wide[offs[1:] + shift + 1] = 32
    keep = np.ones(len(wide), bool)
    keep[1:] = (wide[1:] != 32) | (wide[:-1] != 32)
    starts = (np.cumsum(keep) - keep)[offs[:-1] + shift]
    return wide[keep], starts


def gram_hashes(points: np.ndarray) -> Iterable[np.ndarray]:
    """For each of ORDERS, a 64-bit hash of the n-gram at each position."""
    n, wide = len(points) - max(ORDERS) + 1, points.astype(np.uint64)
    h = wide[:n].copy()
    for order in range(2, max(ORDERS) + 1):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += wide[order - 1 : order - 1 + n]
        if order in ORDERS:
            yield (h ^ np.uint64(order)) * np.uint64(0xBF58476D1CE4E5B9)


def presence(points: np.ndarray, starts: np.ndarray, keys: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, position in keys) of the n-grams that are among the sorted keys."""
    rows, cols = [], []
    for h in gram_hashes(points):
        at = np.flatnonzero(sieve[h >> np.uint64(64 - _SIEVE_BITS)])
        h = h[at]
        k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[k] == h
        rows.append(np.searchsorted(starts, at[hit], side="right") - 1)
        cols.append(k[hit])
    pairs = np.unique(np.concatenate(rows) * len(keys) + np.concatenate(cols))
    return pairs // len(keys), pairs % len(keys)


def sieve_of(keys: np.ndarray) -> np.ndarray:
    sieve = np.zeros(1 << _SIEVE_BITS, bool)
    sieve[keys >> np.uint64(64 - _SIEVE_BITS)] = True
    return sieve


@dataclass
class Model:
    """keys: sorted n-gram hashes. weight: of each, its log-count ratio included."""

    keys: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, column: pa.Array, sieve: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(column), float(sigmoid(np.array(self.bias))))
        rows, cols = presence(*folded(column), self.keys, sieve)
        return sigmoid(np.bincount(rows, self.weight[cols], len(column)) + self.bias)


def _documents_of(texts: list[str], batch: int = 64) -> Iterable[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    for at in range(0, len(texts), batch):
        yield at, folded(pa.array(texts[at : at + batch], pa.string()))


def fit(texts: list[str], toxic: np.ndarray, max_features: int = 1 << 16, min_z: float = 4.0, smooth: float = 1.0, l2: float = 1e-4) -> Model:
    """Fits on texts and their labels (1: toxic). Without texts of both kinds, or without an n-gram that several toxic
    texts have, there is nothing to learn: the model has no keys, and every score is the smoothed share of toxic texts."""
    toxic = np.asarray(toxic, float)
    n1, n0 = int(toxic.sum()), int(len(toxic) - toxic.sum())
    share = (n1 + smooth) / (n1 + n0 + 2 * smooth)
    unlearnt = Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))
    if not n1 or not n0:
        return unlearnt

    # candidates come from the toxic texts, one order at a time; a sieve then finds them in the clean ones
    kept = []
    for k in range(len(ORDERS)):
        grams = []
        for i in np.flatnonzero(toxic == 1):
            points, _ = folded(pa.array([texts[i]], pa.string()))
            grams.append(np.unique(list(gram_hashes(points))[k]))
        found, count = np.unique(np.concatenate(grams), return_counts=True)
        often = count >= max(2, min(5, n1 // 40))
        kept.append((found[often], count[often]))
        del grams, found, count
    keys, count1 = (np.concatenate(part) for part in zip(*kept, strict=True))
    order = np.argsort(keys)
    keys, count1 = keys[order], count1[order]
    if not len(keys):
        return unlearnt
    sieve, count0 = sieve_of(keys), np.zeros(len(keys))
    for at, (points, starts) in _documents_of(texts):
        r, c = presence(points, starts, keys, sieve)
        count0 += np.bincount(c, 1 - toxic[r + at], len(keys))
    share1, share0 = count1 / n1, count0 / n0
    both = (count1 + count0 + 1) / (n1 + n0 + 2)
    z = np.abs(share1 - share0) / np.sqrt(both * (1 - both) * (1 / n1 + 1 / n0))
    use = np.flatnonzero(z >= min(min_z, np.sort(z)[-min(len(z), 50)]))
    if len(use) > max_features:
        use = np.sort(use[np.argsort(-z[use], kind="stable")[:max_features]])
    # once more for the entries of the features in use, which are few
    keys, count1, count0 = keys[use], count1[use], count0[use]
    rows, cols, sieve = [], [], sieve_of(keys)
    for at, (points, starts) in _documents_of(texts):
        r, c = presence(points, starts, keys, sieve)
        rows.append((r + at).astype(np.int32))
        cols.append(c.astype(np.int32))
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    ratio = np.log(((count1 + smooth) / (n1 + 2 * smooth)) / ((count0 + smooth) / (n0 + 2 * smooth)))
    weight, bias = fit_sparse_logistic(rows, cols, ratio[cols], toxic, len(keys), l2)
    return Model(keys, weight * ratio, bias)


def training_sample(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 5,
    held_out: int = 0,
    max_toxic: int = 1500,
    max_clean: int = 3000,
    max_chars: int = 12_000_000,
    max_text: int = 120_000,
) -> tuple[list[str], np.ndarray]:
    """Texts and labels of a bounded sample in hash order, without the fold held out.

    At most max_toxic and max_clean texts, of at most max_text characters each and max_chars all together; labelled
    texts that are longer are no examples. Labels of one doc_id that differ count as toxic. Null labels, null ids and
    null texts are left out.
    """
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.max("toxic").alias("__toxic"))
        .where(id_crc(F.col("__id")) % folds != held_out)
        .withColumn("__order", F.xxhash64("__id"))
    )
    chosen = known.where("__toxic = 1").orderBy("__order", "__id").limit(max_toxic)
    chosen = chosen.unionAll(known.where("__toxic = 0").orderBy("__order", "__id").limit(max_clean))
    # at most max_toxic + max_clean rows, whatever the input
    texts = docs.select(F.col("doc_id").alias("__doc"), F.col("text").alias("__text")).where("__text is not null")
    rows = (
        texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
        .withColumn("__long", F.length("__text"))
        .where(F.col("__long") <= max_text)
        .select("__order", "__toxic", "__text")
        .collect()
    )
    out, used = [], [0, 0]
    for row in sorted(rows, key=tuple):
        label = int(row["__toxic"])
        if used[label] + len(row["__text"]) <= (max_chars // 3 if label else max_chars * 2 // 3):
            used[label] += len(row["__text"])
            out.append((row["__text"], label))
    return [t for t, _ in out], np.array([y for _, y in out], float)


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """docs with a score column from 0 to 1; null and empty texts get the score of a text without known n-grams.

    Every row stays, whatever its other columns; a column of that name is replaced.
    """
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(score)
    schema = T.StructType([*kept.schema.fields, T.StructField(score, T.DoubleType())])
    hold: list[np.ndarray] = []

    def score_all(batches):
        if not hold:
            hold.append(sieve_of(sent.value.keys))
        for batch in slices(batches, text, 1 << 19):
            column = batch.column(batch.schema.get_field_index(text))
            values = sent.value.score(column, hold[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=[*batch.schema.names, score])

    return kept.mapInArrow(score_all, schema)


def toxicity(docs: DataFrame, labels: DataFrame, score: str = "score", **sample: int) -> DataFrame:
    """docs with a toxicity score; learnt from labelled rows outside the fold crc32(doc_id) mod folds = held_out.

    sample: the bounds and the fold, see training_sample().
    """
    return scored(docs, fit(*training_sample(docs, labels, **sample)), score=score)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = toxicity(docs, read_table(spark, sf_dir, "labels"))
    held = F.coalesce(id_crc(F.col("doc_id")) % 5 == 0, F.lit(False))
    return done.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't predicted toxic, all columns as they were. A model that has learnt nothing, for want of
    labels of both kinds or of n-grams that toxic texts share, rejects nothing."""
    model = fit(*training_sample(docs, read_table(spark, sf_dir, "labels")))
    if not len(model.keys):
        return docs
    score = fresh(docs, "toxicity")
    return scored(docs, model, score=score).where(F.col(score) < 0.5).drop(score)
