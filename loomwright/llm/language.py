"""Language identification by string kernels: blended n-gram presence spectrum, Nystroem landmarks, kernel ridge.

A text is folded to lower-case letters with single spaces between words. For each order of the blended spectrum its
distinct n-grams are hashed to a presence vector; the kernel of two texts is the mean over the orders of the cosines of
their presence vectors. A bounded, hash-ordered sample of the labelled texts gives the landmarks and the training rows.
With C the landmarks' kernel matrix, a text's features are K(text, landmarks) C^-1/2, on which one ridge regression per
language is solved against the rest. Scoring is two matrix products a batch: presence x landmarks, kernel x weights.
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

from .common import bound_batches, code_points, id_crc, read_table, slices
from .toxicity import folded

#: Buckets of the presence vector, by order of n-gram.
BUCKETS = {1: 1 << 10, 2: 1 << 12, 3: 1 << 13}
UNKNOWN = "und"
ROWS = 256


@functools.cache
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(1 << 16)])


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each row has a letter of any script."""
    points, offs = code_points(column)
    found = _letters()[np.minimum(points, (1 << 16) - 1)] & (points < 1 << 16)
    for p in np.unique(points[points >= 1 << 16]).tolist():
        if unicodedata.category(chr(p))[0] == "L":
            found |= points == p
    upto = np.concatenate([[0], np.cumsum(found)])
    return upto[offs[1:]] > upto[offs[:-1]]


def spectra(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Presence vectors of all rows, scaled so that their products are kernels; whether each row has a letter."""
    points, starts = folded(column)
    rows = len(column)
    out = np.zeros((rows, sum(BUCKETS.values())), np.float32)
    row = np.repeat(np.arange(rows), np.diff(np.append(starts, len(points))))
    h, at = points.astype(np.uint64), 0
    for order, size in BUCKETS.items():
        if order > 1:
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[order - 1 :].astype(np.uint64)
        inside = (points[: len(h)] != 0) & (points[order - 1 :][: len(h)] != 0)
        slot = ((h[inside] ^ np.uint64(order)) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - size.bit_length() + 1)
        block = out[:, at : at + size]
        block[row[: len(h)][inside], slot.astype(np.int64)] = 1
        norm = np.sqrt(np.maximum(block.sum(axis=1, keepdims=True), 1) * len(BUCKETS))
        block /= norm
        at += size
    return out, has_letter(column)


@dataclass
class Model:
    """languages: sorted. landmarks: presence vectors. weights: kernel values to one score a language."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    centre: np.ndarray
    sharpness: float = 6.0

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        x, letters = spectra(column)
        values = (x @ self.landmarks.T).astype(np.float64) @ self.weights + self.centre
        share = np.exp(self.sharpness * (values - values.max(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        names = [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)]
        return names, np.where(letters, share[np.arange(len(best)), best], 0.0)


def fit(texts: list[str], languages: list[str], landmarks: int = 128, ridge: float = 1e-3) -> Model | None:
    """Fits on texts and languages; the first texts of each language are the landmarks. None without texts."""
    names = sorted(set(languages))
    if not names:
        return None
    blocks, seen, marked = [], dict.fromkeys(names, 0), []
    each = max(1, landmarks // len(names))
    for i, lang in enumerate(languages):
        seen[lang] += 1
        if seen[lang] <= each:
            marked.append(i)
    marks = spectra(pa.array([texts[i] for i in marked], pa.string()))[0]
    for at in range(0, len(texts), ROWS):
        x, _ = spectra(pa.array(texts[at : at + ROWS], pa.string()))
        blocks.append((x @ marks.T).astype(np.float64))
    kernel = np.concatenate(blocks)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    features = kernel @ root
    target = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    mean, offset = features.mean(axis=0), target.mean(axis=0)
    centred = features - mean
    solved = np.linalg.solve(
        centred.T @ centred + ridge * len(texts) * np.eye(len(mean)), centred.T @ (target - offset)
    )
    return Model(names, marks, root @ solved, offset - mean @ solved)


def training_sample(
    docs: DataFrame, folds: int, held_out: int, max_texts: int, max_chars: int, max_text: int, max_languages: int
) -> tuple[list[str], list[str]]:
    """Texts and languages in hash order, as many of each language as there are or as fit: at most max_texts texts, of at
    most max_text characters each and max_chars all together, of the max_languages languages with the most documents.
    Null ids, texts and languages are no examples."""
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (id_crc(F.col("doc_id")) % folds != held_out))
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not counts:
        return [], []
    each = max(1, max_texts // len(counts))
    space = 1 << 30
    limits = {r["lang"]: min(space, int(1.2 * space * each / r["count"]) + 1) for r in counts}
    table = docs.sparkSession.createDataFrame(list(limits.items()), "__lang string, __limit long")
    order = F.pmod(F.xxhash64("doc_id"), F.lit(space))
    rows = (
        usable.where(F.col("text").isNotNull())
        .join(F.broadcast(table), F.col("lang") == F.col("__lang"))
        .where(order < F.col("__limit"))
        .where(F.length("text") <= max_text)
        .select(order.alias("o"), "lang", "text")
        .collect()
    )
    texts, langs, used, seen = [], [], 0, dict.fromkeys(limits, 0)
    for row in sorted(rows, key=tuple):
        if seen[row["lang"]] < each and used + len(row["text"]) <= max_chars:
            seen[row["lang"]] += 1
            used += len(row["text"])
            texts.append(row["text"])
            langs.append(row["lang"])
    return texts, langs


def languages(
    docs: DataFrame,
    folds: int = 4,
    held_out: int = 2,
    max_texts: int = 3000,
    max_chars: int = 12_000_000,
    max_text: int = 120_000,
    max_languages: int = 200,
) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs (doc_id, text, lang; other columns are not read).

    Null texts and texts without a letter are `und` with score 0; so is every text when nothing can be learnt. The
    bounds are those of the labelled sample; every text is predicted whole.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang")
    model = fit(*training_sample(docs, folds, held_out, max_texts, max_chars, max_text, max_languages))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterable[pa.RecordBatch]):
        for big in slices(batches, "text", 1 << 19):
            for at in range(0, big.num_rows, ROWS):
                batch = big.slice(at, ROWS)
                if sent.value is None:
                    names, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
                else:
                    names, score = sent.value.predict(batch.column(1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"]
                )

    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.drop("lang").mapInArrow(predict, schema)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(id_crc(F.col("doc_id")) % 4 == 2, F.lit(False))
    return languages(docs).select("doc_id", held.alias("held_out"), "lang_pred", "score")
