"""Providers of what lies outside: look-ups, language models and embeddings. Offline ones are deterministic.

A provider maps a batch of keys to values. Spark asks it once per distinct key, in Arrow batches, and joins the answers
back; with no network the answers come from a table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Lookup(Protocol):
    """Answers for keys; None where there is none."""

    def __call__(self, keys: list[str]) -> list[str | None]: ...


class Embedder(Protocol):
    """One vector a text."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


def ask(df: DataFrame, key: str, provider: Lookup, answer: str = "answer", batch: int = 50) -> DataFrame:
    """df with a provider's answer for each key; a failing batch gives nulls."""

    def fetch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for at in range(0, len(pdf), batch):
                keys = pdf[key].iloc[at : at + batch].tolist()
                try:
                    found = provider(keys)
                except OSError:
                    found = [None] * len(keys)
                yield pd.DataFrame({key: keys, answer: found})

    distinct = df.select(key).where(F.col(key).isNotNull()).distinct()
    return df.join(distinct.mapInPandas(fetch, f"{key} string, {answer} string"), key, "left")


def ask_table(df: DataFrame, key: str, table: DataFrame, answer: str = "answer") -> DataFrame:
    """The same from a table (key, answer)."""
    return df.join(table.select(key, answer), key, "left")


class HashEmbedder:
    """Deterministic unit vectors from character trigrams, for use without a model."""

    def __init__(self, size: int = 64):
        self.size = size

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for i, t in enumerate(texts):
            t = f"  {t.lower()} "
            for k in range(len(t) - 2):
                d = hashlib.md5(t[k : k + 3].encode()).digest()
                out[i, int.from_bytes(d[:4], "little") % self.size] += 1 if d[4] & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def embedded(df: DataFrame, text: str, provider: Embedder, vector: str = "embedding") -> DataFrame:
    """df with a vector of each text, batch by batch."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(list(provider(s.fillna("").tolist())))

    return df.withColumn(vector, run(F.col(text)))


def entity_text(name: str, category: str, subcategory: str):
    """What an entity's vector is made from."""
    return F.concat(F.col(name), F.lit(" ("), F.lower(F.coalesce(F.nullif(F.col(subcategory), F.lit("")), F.col(category))), F.lit(")"))
