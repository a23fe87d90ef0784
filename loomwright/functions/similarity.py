"""String and vector similarity as column expressions; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix_length(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    shorter = F.least(F.length(a), F.length(b))
    steps = F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(steps, lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))


def letters(c: Column) -> Column:
    """The distinct characters."""
    return F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the character sets; 0 if either is empty."""
    x, y = letters(a), letters(b)
    union = F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def string_similarity(a: Column, b: Column, fold: bool = True, empty: float = 0.0) -> Column:
    """Half the shared prefix's share of the shorter name, and parts of character overlap and length ratio.

    Cases are folded on request; `empty` is the likeness where one of two names is empty. Tenths are whole numbers by 10,
    as SQL's decimals: 0.3 * 3 is 0.8999999999999999 in doubles, and a sum at a floor falls on the other side of it.
    """
    if fold:
        a, b = F.lower(a), F.lower(b)
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    x, y = letters(a), letters(b)
    overlap = 3 * F.size(F.array_intersect(x, y)) / 10 / F.size(F.array_union(x, y))
    mixed = 0.5 * prefix_length(a, b) / short + overlap + 2 * short / 10 / long
    return F.when(a.isNull() | b.isNull(), None).when(a == b, 1.0).when(short == 0, empty).otherwise(mixed)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, on lower case; 1 for two empty strings."""
    a, b = F.lower(a), F.lower(b)
    long = F.greatest(F.length(a), F.length(b))
    return F.when(long == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / long)


def contains_either(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)


def pair_score(a: Column, b: Column, lang_a: Column, lang_b: Column, least: float = 0.25) -> Column:
    """Training value of a name pair: distance, more across languages and unlike starts, less for short or odd names."""
    dist = 1 - edit_similarity(a, b)
    a3, b3 = F.lower(F.substring(a, 1, 3)), F.lower(F.substring(b, 1, 3))
    apart = (a3 != b3) & ~F.arrays_overlap(letters(a3), letters(b3))
    odd = [F.length(F.regexp_replace(c, r"[\p{L} '\-.,]", "")) > F.length(c) * 0.3 for c in (a, b)]
    score = dist * F.when(lang_a != lang_b, 1.5).otherwise(1.0) * F.when(apart, 1.3).otherwise(1.0)
    score = score * F.when(F.least(F.length(F.trim(a)), F.length(F.trim(b))) < 4, 0.5).otherwise(1.0)
    for o in odd:
        score = score * F.when(o, 0.3).otherwise(1.0)
    return F.when(dist < least, 0.0).otherwise(score)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, left to right."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def cosine_smoothed(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + 1e-10)


def cosine_raw(a: Column, b: Column) -> Column:
    """NaN where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(float("nan"))).otherwise(dot(a, b) / n)


def unit(a: Column) -> Column:
    """The vector scaled to length 1; a zero vector as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x / n))
