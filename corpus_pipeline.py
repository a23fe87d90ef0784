"""The corpus pipeline: stages that turn documents into packed training sequences.

Each stage is a function of (spark, docs, sf_dir) and works on all that its predecessor kept. Its result is written as
Parquet to the shared folder and read again as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwright.llm import mixing, near_dedup, packing, substring, toxicity
from loomwright.llm.common import read_table, store
from loomwright.llm.tokenise import tokenizer_path


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in full training sequences, with their ids."""
    # workers still hold what earlier stages left, so the memo is smaller than when packing runs alone
    return packing.packed(docs, tokenizer_path("word_bpe_49k.json"), max_memo=150_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity.stage),
    ("near_dedup", near_dedup.stage),
    ("substring_dedup", substring.stage),
    ("mixing", mixing.stage),
    ("packing", pack),
]

#: SQL has neither the classifier nor the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
