"""Readers with explicit schemas: absent fields are null, bad input is dropped as each format's rule says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.text import djvu_pages

ENTITY = (
    "STRUCT<id: STRING, name: STRING, category: STRING, subcategory: STRING, count: INT, contexts: ARRAY<STRING>, "
    "variants: ARRAY<STRING>, mentions: ARRAY<STRUCT<offset: INT, matched_term: STRING, excerpt: STRING>>>"
)
BOOK = "STRUCT<id: STRING, title: STRING, author: STRING, year: INT, language: STRING, description: STRING>"
BOOK_FILE = f"book {BOOK}, entities ARRAY<{ENTITY}>, stats MAP<STRING, STRING>"
PAIR_COLUMNS = ["term_a", "lang_a", "source_a", "term_b", "lang_b", "source_b", "link_type", "modern_id", "notes"]
PAIRS = ", ".join(f"{c} STRING" for c in PAIR_COLUMNS)


def book_files(spark: SparkSession, glob: str) -> DataFrame:
    """One row per entity of JSON book files: book_id, title, language, year, and the entity's fields."""
    files = spark.read.schema(BOOK_FILE).option("multiLine", True).json(glob)
    rows = files.select("book", F.explode("entities").alias("e"))
    return rows.select(F.col("book.id").alias("book_id"), F.col("book.title").alias("title"), F.col("book.language").alias("language"), F.nullif(F.col("book.year"), F.lit(0)).alias("year"), "e.*")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that don't parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of each file, without what isn't UTF-8."""
    text = F.regexp_replace("value", "�", "")
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), text.alias("text"))


def pair_csv(spark: SparkSession, path: str, schema: str = PAIRS) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def scanned_pages(spark: SparkSession, path: str) -> DataFrame:
    """leaf and text of a scanned book's XML."""
    return djvu_pages(spark.read.text(path, wholetext=True))


def override_map(spark: SparkSession, path: str) -> DataFrame:
    """key and value of a flat JSON object, without its comment."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    return pairs.where("key <> '_comment'")


def cached(df: DataFrame) -> DataFrame:
    """A snapshot that several queries share."""
    return df.persist()
