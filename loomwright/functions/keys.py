"""Stable keys, identifiers and small builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalise import name_text


def stable_key(category: Column, names: Column, most: int = 16) -> Column:
    """A key of a cluster that survives re-runs: a digest of its category and its first sorted normalised names."""
    listed = F.slice(F.array_sort(F.array_distinct(F.transform(names, name_text))), 1, most)
    return F.concat(F.lit("clu_"), F.substring(F.sha1(F.concat(category, F.lit("|"), F.array_join(listed, "|"))), 1, 16))


def stable_id(*parts: Column) -> Column:
    """An identifier of a registry entry: a digest of its parts, joined by a bar."""
    return F.concat(F.lit("ent_"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12))


def percent_encoded(c: Column) -> Column:
    """A part of a URL: all but letters, digits and - _ . ! ~ * ' ( ) encoded as UTF-8."""
    c = F.url_encode(c)
    for code, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def resized(url: Column, width: int) -> Column:
    """An image URL with its pixel width replaced."""
    return F.regexp_replace(url, r"\d+px-", f"{width}px-")


def search_phrase(text: Column, words: int = 3) -> Column:
    """The words in the middle of a text, quoted and encoded."""
    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    first = F.greatest(F.floor((F.size(parts) - words) / 2) + 1, F.lit(1)).cast("int")
    return percent_encoded(F.concat(F.lit('"'), F.array_join(F.slice(parts, first, words), " "), F.lit('"')))


def publication_year(year: Column, text: Column, otherwise: int = 1900) -> Column:
    """A year, or the first four-digit one in an identifier."""
    found = F.regexp_extract(text, r"(1\d{3}|20\d{2})", 1)
    return F.coalesce(F.when(year > 0, year), F.when(found != "", found.cast("int")), F.lit(otherwise))


def keyword_relevance(text: Column, weights: dict[str, int], most: int = 100) -> Column:
    """Summed weights of the words that occur, at most `most`."""
    low = F.lower(text)
    return F.least(F.lit(most), sum((F.when(low.contains(w), v).otherwise(0) for w, v in weights.items()), F.lit(0)))
