"""Scalar functions: normalisers (N), similarity and keys (X), vectors (V)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys, normalise
from ..functions.similarity import char_jaccard, cosine, cosine_raw, cosine_smoothed, dot, edit_similarity, pair_score, prefix_length, string_similarity
from ..operators.neighbours import block_scores
from .filters import _NAMES2, _SIM, name_pairs
from .joins import _DOT
from .views import Views, query

_HEADS = ", h AS (SELECT doc_id, head FROM word)"


def _heads(v: Views) -> DataFrame:
    return v.word


@query("n01_key_text", _HEADS + r"SELECT doc_id, regexp_replace(regexp_replace(strip_accents(lower(head)), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS k FROM h")
def n01(v: Views) -> DataFrame:
    return _heads(v).select("doc_id", normalise.key_text(F.col("head")).alias("k"))


_SLUG = r"regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(head), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query("n02_slug", _HEADS + f"SELECT doc_id, coalesce(nullif({_SLUG}, ''), 'entity') AS k FROM h")
def n02(v: Views) -> DataFrame:
    return _heads(v).select("doc_id", normalise.slug(F.col("head")).alias("k"))


@query("n03_plain_slug", "SELECT doc_id, regexp_replace(regexp_replace(lower(head), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS k FROM word")
def n03(v: Views) -> DataFrame:
    return v.word.select("doc_id", normalise.plain_slug(F.col("head")).alias("k"))


@query(
    "n04_registry_text",
    "SELECT doc_id, trim(regexp_replace(strip_accents(lower(replace(replace(replace(replace(head, 'ß', 'ss'), 'æ', 'ae'), 'ø', 'o'), 'œ', 'oe'))), '\\s+', ' ', 'g')) AS k FROM word",
)
def n04(v: Views) -> DataFrame:
    return v.word.select("doc_id", normalise.registry_text(F.col("head")).alias("k"))


@query("n05_marked_text", _HEADS + "SELECT doc_id, trim(regexp_replace(strip_accents(lower(head)), '\\s+', ' ', 'g')) AS k FROM h")
def n05(v: Views) -> DataFrame:
    return _heads(v).select("doc_id", normalise.marked_text(F.col("head")).alias("k"))


@query("n06_page_text", "SELECT doc_id, trim(regexp_replace(strip_accents(replace(lower(head), 'ﬁ', 'fi')), '\\s+', ' ', 'g')) AS k FROM word")
def n06(v: Views) -> DataFrame:
    return v.word.select("doc_id", normalise.page_text(F.col("head")).alias("k"))


@query("n07_ocr_text", "SELECT doc_id, strip_accents(replace(head, 'æ', 'ae')) AS k FROM word")
def n07(v: Views) -> DataFrame:
    return v.word.select("doc_id", normalise.ocr_text(F.col("head")).alias("k"))


@query("n08_name_text", _HEADS + r"SELECT doc_id, trim(regexp_replace(strip_accents(lower(head)), '[^\p{L}\p{N}]+', ' ', 'g')) AS k FROM h")
def n08(v: Views) -> DataFrame:
    return _heads(v).select("doc_id", normalise.name_text(F.col("head")).alias("k"))


@query("n09_low_trim", "SELECT doc_id, lower(trim(head)) AS k FROM word")
def n09(v: Views) -> DataFrame:
    return v.word.select("doc_id", normalise.low_trim(F.col("head")).alias("k"))


_TITLED = ", t AS (SELECT id, CASE id % 4 WHEN 0 THEN 'Mr. ' || name WHEN 1 THEN 'Mrs ' || name WHEN 2 THEN 'Dr. ' || name || ',' ELSE name END AS n FROM entity)"


def titled(v: Views) -> DataFrame:
    kind = F.col("id") % 4
    n = F.when(kind == 0, F.concat(F.lit("Mr. "), "name")).when(kind == 1, F.concat(F.lit("Mrs "), "name")).when(kind == 2, F.concat(F.lit("Dr. "), "name", F.lit(","))).otherwise(F.col("name"))
    return v.entity.withColumn("n", n)


@query("n10_surname", _TITLED + "SELECT id, trim(regexp_replace(n, '(?i)^(mr|mrs|dr)\\.?\\s+', '')) AS bare, lower(regexp_replace(split_part(n, ' ', -1), '[.,;:]+$', '')) AS surname FROM t")
def n10(v: Views) -> DataFrame:
    return titled(v).select("id", normalise.strip_honorific(F.col("n")).alias("bare"), normalise.surname(F.col("n")).alias("surname"))


@query("n11_ocr_cleanup", "SELECT id, trim(regexp_replace(replace(name, 'e', '^/e'), '[\\^/]', '', 'g')) AS clean, CASE WHEN id % 2 = 0 THEN name ELSE '' END AS kept FROM entity")
def n11(v: Views) -> DataFrame:
    noisy = F.replace("name", F.lit("e"), F.lit("^/e"))
    variants = F.array(F.when(F.col("id") % 2 == 0, F.col("name")).otherwise(F.concat("name", F.lit("-"))), F.concat(F.lit("fol. "), "name"))
    return v.entity.select("id", normalise.clean_ocr(noisy).alias("clean"), F.array_join(normalise.clean_ocr_variants(variants), "|").alias("kept"))


@query("n12_book_hint", "SELECT book_id, lower(split_part(replace(title, '#', '_'), '_', 1)) AS hint FROM book")
def n12(v: Views) -> DataFrame:
    return v.book.select("book_id", normalise.book_hint(F.replace("title", F.lit("#"), F.lit("_"))).alias("hint"))


@query("n13_same_nfc", "SELECT doc_id, nfc_normalize(head) = nfc_normalize(replace(head, 'é', 'e' || chr(769))) AS same FROM word")
def n13(v: Views) -> DataFrame:
    other = F.replace("head", F.lit("é"), F.lit("é"))
    return v.word.select("doc_id", normalise.same_nfc(F.col("head"), other).alias("same"))


@query("x01_string_similarity", _NAMES2 + _SIM.format(a="a", b="b", keep="a, b", src="pr") + "SELECT a, b, round(sim, 6) AS sim FROM simd")
def x01(v: Views) -> DataFrame:
    return name_pairs(v).select("a", "b", F.round(string_similarity(F.col("a"), F.col("b")), 6).alias("sim"))


@query("x02_levenshtein", _NAMES2 + "SELECT a, b, CAST(levenshtein(a, b) AS INTEGER) AS d FROM pr")
def x02(v: Views) -> DataFrame:
    return name_pairs(v).select("a", "b", F.levenshtein("a", "b").alias("d"))


@query("x03_edit_similarity", _NAMES2 + "SELECT a, b, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS s FROM pr")
def x03(v: Views) -> DataFrame:
    return name_pairs(v).select("a", "b", F.round(edit_similarity(F.col("a"), F.col("b")), 6).alias("s"))


@query("x04_char_jaccard", _NAMES2 + "SELECT a, b, round(len(list_intersect(list_distinct(string_split(a, '')), list_distinct(string_split(b, '')))) / len(list_distinct(list_concat(string_split(a, ''), string_split(b, '')))), 6) AS j FROM pr")
def x04(v: Views) -> DataFrame:
    return name_pairs(v).select("a", "b", F.round(char_jaccard(F.col("a"), F.col("b")), 6).alias("j"))


@query("x05_prefix_length", _NAMES2 + "SELECT a, b, CAST(len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: starts_with(b, substr(a, 1, CAST(i AS INTEGER))))) AS INTEGER) AS n FROM pr")
def x05(v: Views) -> DataFrame:
    return name_pairs(v).select("a", "b", prefix_length(F.col("a"), F.col("b")).alias("n"))


@query(
    "x06_pair_score",
    _NAMES2
    + ", t AS (SELECT a, b, levenshtein(a, b) / greatest(length(a), length(b)) AS d, length(a) % 2 <> length(b) % 2 AS cross_lingual, substr(a, 1, 3) <> substr(b, 1, 3) AND len(list_intersect(string_split(substr(a, 1, 3), ''), string_split(substr(b, 1, 3), ''))) = 0 AS apart FROM pr) SELECT a, b, round(CASE WHEN d < 0.25 THEN 0 ELSE d * CASE WHEN cross_lingual THEN 1.5 ELSE 1 END * CASE WHEN apart THEN 1.3 ELSE 1 END END, 6) AS score FROM t",
)
def x06(v: Views) -> DataFrame:
    lang = lambda c: F.when(F.length(c) % 2 == 0, "l0").otherwise("l1")
    score = pair_score(F.col("a"), F.col("b"), lang("a"), lang("b"))
    return name_pairs(v).select("a", "b", F.round(score, 6).alias("score"))


@query("x07_stable_key", ", g AS (SELECT category, array_to_string(list_sort(list(DISTINCT name))[1:16], '|') AS n FROM entity GROUP BY 1) SELECT category, 'clu_' || substr(sha1(category || '|' || n), 1, 16) AS k FROM g")
def x07(v: Views) -> DataFrame:
    return v.entity.groupBy("category").agg(F.collect_set("name").alias("names")).select("category", keys.stable_key(F.col("category"), F.col("names")).alias("k"))


@query("x08_stable_id", "SELECT id, 'ent_' || substr(sha1('local|' || category || '|' || id), 1, 12) AS k FROM entity")
def x08(v: Views) -> DataFrame:
    return v.entity.select("id", keys.stable_id(F.lit("local"), F.col("category"), F.col("id").cast("string")).alias("k"))


@query(
    "x09_keyword_relevance",
    "SELECT conv_id, turn, CAST(least(100, (contains(lower(text), 'the'))::INT * 30 + (contains(lower(text), 'que'))::INT * 40 + (contains(lower(text), 'and'))::INT * -10 + (contains(lower(text), 'der'))::INT * 50) AS INTEGER) AS score FROM conversations",
)
def x09(v: Views) -> DataFrame:
    weights = {"the": 30, "que": 40, "and": -10, "der": 50}
    return v.conversations.select("conv_id", "turn", keys.keyword_relevance(F.col("text"), weights).alias("score"))


@query("x10_builders", "SELECT page_id, regexp_replace(url || '/120px-x.jpg', '\\d+px-', '400px-', 'g') AS thumb, replace(replace(replace(replace(replace(url_encode(url), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*') AS enc FROM pages")
def x10(v: Views) -> DataFrame:
    return v.pages.select("page_id", keys.resized(F.concat("url", F.lit("/120px-x.jpg")), 400).alias("thumb"), keys.percent_encoded(F.col("url")).alias("enc"))


@query(
    "x11_link_strength",
    ", t AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'same_referent' WHEN 1 THEN 'orthographic_variant' WHEN 2 THEN 'cross_linguistic' WHEN 3 THEN 'contested_identity' WHEN 4 THEN 'conceptual_overlap' WHEN 5 THEN 'derivation' ELSE 'other' END AS kind FROM orders) SELECT o_orderkey, CAST(CASE kind WHEN 'same_referent' THEN 1.0 WHEN 'orthographic_variant' THEN 0.95 WHEN 'cross_linguistic' THEN 0.9 WHEN 'contested_identity' THEN 0.7 WHEN 'conceptual_overlap' THEN 0.5 WHEN 'derivation' THEN 0.4 ELSE 0.5 END AS DOUBLE) AS strength FROM t",
)
def x11(v: Views) -> DataFrame:
    from ..functions.rules import LINK_STRENGTH, link_strength

    kinds = F.array(*[F.lit(k) for k in [*LINK_STRENGTH, "other"]])
    return v.orders.select("o_orderkey", link_strength(F.element_at(kinds, (F.col("o_orderkey") % 7 + 1).cast("int"))).alias("strength"))


@query("x12_publication_year", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size + 1500 ELSE coalesce(CAST(nullif(regexp_extract('vol' || (p_partkey * 7), '(1\\d{3}|20\\d{2})', 1), '') AS INTEGER), 1900) END AS year FROM part")
def x12(v: Views) -> DataFrame:
    given = F.when(F.col("p_size") % 3 == 0, F.col("p_size") + 1500).otherwise(0)
    return v.part.select("p_partkey", keys.publication_year(given, F.concat(F.lit("vol"), (F.col("p_partkey") * 7).cast("string"))).alias("year"))


def _vector_sql(score: str) -> str:
    d, na, nb = _DOT.format(a="a.embedding", b="b.embedding"), _DOT.format(a="a.embedding", b="a.embedding"), _DOT.format(a="b.embedding", b="b.embedding")
    body = score.format(d=d, n=f"(sqrt({na}) * sqrt({nb}))")
    return f"SELECT a.vec_id AS a, b.vec_id AS b, round({body}, 5) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id"


def _vector(v: Views, f, score) -> DataFrame:
    """f of each pair; `score` is the same on numpy arrays, from a dot product and two norms."""
    e = v.embeddings.select("vec_id", "label", "embedding")
    plain = F.size("embedding") * F.when(F.exists("embedding", lambda x: x.isNull()), -1).otherwise(1)
    sizes = {r["n"]: r["count"] for r in e.groupBy(F.coalesce(plain, F.lit(-1)).alias("n")).count().orderBy(F.desc("count")).limit(1000).collect()}
    dim = max((n for n in sizes if n > 0), key=sizes.get, default=0)
    regular = F.coalesce((plain == dim) & (plain > 0), F.lit(False))
    found = block_scores(e.where(regular), "vec_id", "embedding", "label", score)
    if sizes.keys() <= {dim}:
        return found
    # vectors that are null, hold nulls or have another length don't go into a matrix
    odd, even = e.where(~regular), e.where(regular)
    for x, y in ((odd, e), (even, odd)):
        a = x.select(F.col("vec_id").alias("a"), "label", F.col("embedding").alias("x"))
        b = y.select(F.col("vec_id").alias("b"), F.col("label").alias("l"), F.col("embedding").alias("y"))
        j = a.join(b, (F.col("label") == F.col("l")) & (F.col("a") < F.col("b")))
        found = found.unionByName(j.select("a", "b", F.round(f(F.col("x"), F.col("y")), 5).alias("sim")))
    return found


@query("v01_cosine", _vector_sql("CASE WHEN {n} = 0 THEN 0 ELSE {d} / {n} END"))
def v01(v: Views) -> DataFrame:
    return _vector(v, cosine, lambda d, x, y: np.where(x * y == 0, 0.0, d / (x * y)))


@query("v02_cosine_smoothed", _vector_sql("{d} / ({n} + 1e-10)"))
def v02(v: Views) -> DataFrame:
    return _vector(v, cosine_smoothed, lambda d, x, y: d / (x * y + 1e-10))


@query("v03_dot", _vector_sql("{d}"))
def v03(v: Views) -> DataFrame:
    return _vector(v, dot, lambda d, x, y: d)


@query("v04_cosine_raw", _vector_sql("{d} / {n}"))
def v04(v: Views) -> DataFrame:
    return _vector(v, cosine_raw, lambda d, x, y: np.where(x * y == 0, np.nan, d / (x * y)))
