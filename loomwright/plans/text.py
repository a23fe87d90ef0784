"""Text ingestion and row generators (T)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import text as ops
from .views import Views, query


@query("t01_chunks")
def t01(v: Views) -> DataFrame:
    return ops.chunks(v.documents)


@query("t01b_pilot_chunks")
def t01b(v: Views) -> DataFrame:
    return ops.chunks(v.documents, size=3000, overlap=200, least=0, collapse=False, strip=False)


@query("t02_boilerplate", "SELECT doc_id, md5(regexp_replace(regexp_replace(text, 'This work is licensed[^\\n]*', '', 'g'), 'Licensed under[^\\n]*', '', 'g')) AS h FROM documents")
def t02(v: Views) -> DataFrame:
    rules = [r"This work is licensed[^\n]*", r"Licensed under[^\n]*"]
    return v.documents.select("doc_id", F.md5(ops.strip_boilerplate(F.col("text"), rules)).alias("h"))


@query(
    "t03_section_slice",
    "SELECT page_id, regexp_replace(regexp_replace(html, '^.*?(?:<title>)', '', 's'), '(?:</title>).*$', '', 's') AS title FROM pages",
)
def t03(v: Views) -> DataFrame:
    return v.pages.select("page_id", ops.between(F.col("html"), "<title>", "</title>").alias("title"))


@query("t04_first_year", ", y AS (SELECT doc_id, regexp_extract(substr(text, 1, 2000), '\\b(1[5-9]\\d\\d)\\b', 1) AS y FROM documents) SELECT doc_id, CAST(nullif(y, '') AS INTEGER) AS year FROM y")
def t04(v: Views) -> DataFrame:
    return v.documents.select("doc_id", ops.first_year(F.col("text")).alias("year"))


@query("t05_json_items", "SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE name || '/OTHER_' || category END AS item FROM entity")
def t05(v: Views) -> DataFrame:
    item = F.to_json(F.struct("name", "category", F.col("subcategory").alias("context")))
    reply = F.when(F.col("id") % 3 == 0, "no list").otherwise(F.concat(F.lit('Sure:\n```json\n[{"name": "x"}, '), item, F.lit("]\n```")))
    one = F.get(ops.json_items(reply), 0)
    return v.entity.select("id", F.concat(one["name"], F.lit("/"), one["subcategory"]).alias("item"))


@query("t06_json_repair", "SELECT id, name AS name, CAST(cnt AS BIGINT) AS n FROM entity")
def t06(v: Views) -> DataFrame:
    broken = F.concat(F.lit("Reply: "), F.regexp_replace(F.to_json(F.struct(F.struct("name", F.array("cnt").alias("n")).alias("o"))), r"\]?\}*$", ""))
    fixed = ops.repaired_json(broken)
    return v.entity.select("id", F.get_json_object(fixed, "$.o.name").alias("name"), F.get_json_object(fixed, "$.o.n[0]").cast("long").alias("n"))


@query("t07_mentions")
def t07(v: Views) -> DataFrame:
    return ops.mentions(v.documents, ["the", "that", "und", "que", "licensed", "apache license"])


@query("t08_page_index", "SELECT doc_id, length(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS n FROM documents WHERE length(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) > 300")
def t08(v: Views) -> DataFrame:
    n = F.length(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))).cast("long")
    return v.documents.select("doc_id", n.alias("n")).where("n > 300")


@query(
    "t09_tokens",
    "SELECT doc_id, CAST(len(list_filter(string_split_regex(trim(regexp_replace(lower(text), '[^A-Za-z0-9_\\s]', '', 'g')), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ('the', 'and'))) AS INTEGER) AS n FROM documents",
)
def t09(v: Views) -> DataFrame:
    return v.documents.select("doc_id", F.size(ops.tokens(F.col("text"), ["the", "and"])).alias("n"))


@query("t10_lead_sentences")
def t10(v: Views) -> DataFrame:
    return v.documents.select("doc_id", ops.lead_sentences(F.col("text")).alias("lead"))


@query("t11_ellipsis", "SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 57) || '...' ELSE text END AS short FROM documents")
def t11(v: Views) -> DataFrame:
    return v.documents.select("doc_id", ops.ellipsis(F.col("text"), 60).alias("short"))
