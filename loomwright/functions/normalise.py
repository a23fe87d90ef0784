"""String normalisers. Each is a named function with its own rule; they differ on purpose.

Unicode forms have no built-in function in Spark. `fold_marks` covers the Latin blocks with one translate() inside code
generation; `unicode_form` is the vectorised general way.
"""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@functools.cache
def _latin_marks() -> tuple[str, str]:
    """Precomposed letters of the Latin blocks and the base letters that they decompose to."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))) for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def fold_marks(c: Column) -> Column:
    """Drops combining marks and replaces precomposed Latin letters by their base letters."""
    src, dst = _latin_marks()
    return F.regexp_replace(F.translate(c, src, dst), r"\p{Mn}+", "")


def unicode_form(form: str, strip_marks: bool = True, ascii_only: bool = False):
    """A pandas UDF to a normal form (NFC, NFD, NFKC, NFKD), without marks or without non-ASCII if asked."""

    @F.pandas_udf("string")
    def convert(values: pd.Series) -> pd.Series:
        out = values.str.normalize(form)
        if strip_marks:
            out = out.str.replace("[\\u0300-\\u036f]+", "", regex=True)
        return out.str.encode("ascii", "ignore").str.decode("ascii") if ascii_only else out

    return convert


# fixed values: letters that fold to several or to other letters
_FOLDS = [("Æ", "AE"), ("æ", "ae"), ("Œ", "OE"), ("œ", "oe"), ("ß", "ss"), ("Ø", "O"), ("ø", "o"), ("Ð", "D"), ("ð", "d"), ("Þ", "Th"), ("þ", "th")]


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def key_text(c: Column) -> Column:
    """Lower case, no marks, runs of other than letters and digits as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(fold_marks(F.lower(c)), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def ascii_text(c: Column) -> Column:
    """No marks, other non-ASCII dropped, lower case, single spaces."""
    return squeeze(F.lower(F.regexp_replace(fold_marks(c), r"[^\x00-\x7F]", "")))


def slug(c: Column, empty: str = "entity") -> Column:
    """A URL slug of the ASCII form; `empty` where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(ascii_text(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit(empty)).otherwise(s)


def plain_slug(c: Column) -> Column:
    """A slug without folding: accents become hyphens, one hyphen is cut at each end."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def registry_text(c: Column) -> Column:
    """Special Latin letters spelled out, lower case, no marks, single spaces."""
    for old, new in _FOLDS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return squeeze(fold_marks(F.lower(c)))


def marked_text(c: Column) -> Column:
    """Lower case, no marks, single spaces."""
    return squeeze(fold_marks(F.lower(c)))


def page_text(c: Column) -> Column:
    """For matching against scanned pages: long s and ligatures spelled out, lower case, no marks, single spaces."""
    c = F.lower(c)
    for old, new in [("ſ", "s"), ("ﬁ", "fi"), ("ﬂ", "fl")]:
        c = F.replace(c, F.lit(old), F.lit(new))
    return squeeze(fold_marks(c))


def ocr_text(c: Column) -> Column:
    """Letters that scans confuse unified, no marks; case stays."""
    return fold_marks(F.replace(F.replace(F.translate(c, "ſƒ", "ss"), F.lit("æ"), F.lit("ae")), F.lit("Æ"), F.lit("AE")))


def name_text(c: Column) -> Column:
    """Lower case, no marks, runs of other than letters and digits as one space."""
    return F.trim(F.regexp_replace(fold_marks(F.lower(c)), r"[^\p{L}\p{N}]+", " "))


def low_trim(c: Column) -> Column:
    return F.lower(F.trim(c))


# fixed values: titles that precede names
HONORIFICS = r"(?i)^(mr|mrs|ms|miss|dr|sir|lady|lord|st|saint|don|dona|padre|fr)\.?\s+"


def strip_honorific(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(c), HONORIFICS, ""))


# fixed values: words inside surnames
PARTICLES = ["da", "de", "do", "di", "das", "dos", "del", "van", "von"]


def surname(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """The last word without title, initials, trailing punctuation and particles; aliases rename it."""
    words = F.split(strip_honorific(F.regexp_replace(c, r"[.,;:]+$", "")), r"\s+")
    kept = F.filter(words, lambda w: (F.length(F.regexp_replace(w, r"\.", "")) > 1) & ~F.lower(w).isin(PARTICLES))
    last = F.lower(F.try_element_at(kept, F.lit(-1)))
    if not aliases:
        return last
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(table, last), last)


def clean_ocr(c: Column) -> Column:
    """Carets and slashes dropped."""
    return F.trim(F.regexp_replace(c, r"[\^/]", ""))


def clean_ocr_variants(variants: Column) -> Column:
    """Without short variants that end in a hyphen and bibliographic fragments, the others cleaned."""
    fragment = r"(?i)\b(fol\.|lib\.|cap\.)"
    kept = F.filter(variants, lambda v: ~(v.endswith("-") & (F.length(v) <= 20)) & ~v.rlike(fragment))
    return F.transform(kept, clean_ocr)


def book_hint(c: Column) -> Column:
    """The slug of what precedes the first underscore."""
    return slug(F.split_part(c, F.lit("_"), F.lit(1)), "book")


def same_nfc(a: Column, b: Column) -> Column:
    """Equal after canonical composition."""
    nfc = unicode_form("NFC", strip_marks=False)
    return nfc(a) == nfc(b)
