"""Text ingestion: chunking, clean-up, mention finding, tagging and page lookup."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalise import page_text


def chunk_text(text: str, size: int = 2500, overlap: int = 200, least: int = 200, collapse: bool = True, strip: bool = True) -> Iterator[tuple[int, int, str]]:
    """(number, start, chunk) of overlapping chunks that end at a paragraph, else at a sentence, in their second half."""
    if collapse:
        text = re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", text))
    start, number = 0, 0
    while start < len(text):
        end = start + size
        if end < len(text):
            at = text.rfind("\n\n", start + size // 2, end)
            if at < 0:
                at = text.rfind(". ", start + size // 2, end)
            if at >= 0:
                end = at + 2
        chunk = text[start:end].strip() if strip else text[start:end]
        if not strip or len(chunk) > least:
            yield number, start, chunk
            number += 1
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", **rules) -> DataFrame:
    """One row per chunk: key, chunk_no, start, chunk. Each start depends on the break before it, hence Python."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *c) for k, t in zip(b[key], b[text], strict=True) if t is not None for c in chunk_text(t, **rules)]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "start", "chunk"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(cut, f"{key} {kind}, chunk_no int, start int, chunk string")


def strip_boilerplate(c: Column, rules: list[str]) -> Column:
    """Every match of the rules dropped, one rule after the other."""
    for rule in rules:
        c = F.regexp_replace(c, rule, "")
    return c


def between(c: Column, start: str, end: str) -> Column:
    """What stands after the first match of start and before the last match of end; the whole text without them."""
    c = F.regexp_replace(c, f"(?s)^.*?(?:{start})", "")
    return F.regexp_replace(c, f"(?s)(?:{end}).*$", "")


def first_year(c: Column, within: int = 2000) -> Column:
    found = F.regexp_extract(F.substring(c, 1, within), r"\b(1[5-9]\d\d)\b", 1)
    return F.when(found != "", found.cast("int"))


def json_items(c: Column, schema: str = "array<struct<name string, category string, subcategory string, context string>>") -> Column:
    """Complete items of the outermost JSON list in a reply; null where there is none."""
    body = F.regexp_extract(F.regexp_replace(c, "```(json)?", ""), r"(?s)(\[.*\])", 1)
    items = F.from_json(body, schema)
    whole = F.filter(items, lambda x: x["name"].isNotNull() & x["category"].isNotNull() & x["context"].isNotNull())
    filled = F.transform(
        whole,
        lambda x: F.struct(
            x["name"].alias("name"),
            x["category"].alias("category"),
            F.coalesce(x["subcategory"], F.concat(F.lit("OTHER_"), x["category"])).alias("subcategory"),
            x["context"].alias("context"),
        ),
    )
    return F.when(F.size(filled) > 0, filled)


def repair_json(text: str) -> str | None:
    """The outermost JSON object of a reply, with missing closing brackets added; None where there is no object."""
    import json

    start = text.find("{")
    if start < 0:
        return None
    body = text[start:]
    stack, quoted, escaped = [], False, False
    for i, ch in enumerate(body):
        if escaped:
            escaped = False
        elif ch == "\\":
            escaped = quoted
        elif ch == '"':
            quoted = not quoted
        elif not quoted and ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif not quoted and ch in "}]" and stack:
            stack.pop()
            if not stack:
                body = body[: i + 1]
                break
    body += '"' * quoted + "".join(reversed(stack))
    try:
        json.loads(body)
    except ValueError:
        return None
    return body


def repaired_json(c: Column) -> Column:
    """repair_json() on a column, batch by batch."""

    @F.pandas_udf("string")
    def repair(values: pd.Series) -> pd.Series:
        return values.map(lambda t: repair_json(t) if t is not None else None)

    return repair(c)


def find_mentions(text: str, terms: list[str], apart: int = 50, around: int = 150, widen: int = 20, most: int = 100) -> list[tuple[int, str, str]]:
    """(offset, term, excerpt) of whole-word matches of the terms, longest first, none near a kept one."""
    kept: list[tuple[int, str, str]] = []
    for term in sorted({t for t in terms if len(t) >= 2}, key=lambda t: (-len(t), t)):
        for m in re.finditer(rf"\b{re.escape(term)}\b", text, re.IGNORECASE):
            if any(abs(m.start() - k[0]) < apart for k in kept):
                continue
            a, b = max(0, m.start() - around), min(len(text), m.end() + around)
            left, right = text.rfind(" ", max(0, a - widen), a), text.find(" ", b, b + widen)
            a, b = left + 1 if a and left >= 0 else a, right if right >= 0 else b
            kept.append((m.start(), term, re.sub(r"\s+", " ", text[a:b]).strip()))
    return sorted(kept)[:most]


def mentions(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text", **rules) -> DataFrame:
    """One row per mention: key, offset, term, excerpt. The dictionary goes with the function, so it is bounded."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *m) for k, t in zip(b[key], b[text], strict=True) if t is not None for m in find_mentions(t, terms, **rules)]
            yield pd.DataFrame(rows, columns=[key, "offset", "term", "excerpt"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(find, f"{key} {kind}, offset int, term string, excerpt string")


def _low(text: str) -> str:
    """Lower case letter by letter, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _word_char(c: str) -> bool:
    return c == "_" or c.isascii() and c.isalnum()


def find_terms(text: str, automaton, excluded: frozenset = frozenset()) -> list[tuple[int, str, object]]:
    """(offset, term, value) of the dictionary's terms in a text, from left to right without overlaps, the longest first
    at each place, each between word boundaries (of A-Z, a-z, 0-9 and _), whatever the case."""
    low, found = _low(text), []
    for last, (term, value) in automaton.iter(low):
        start, end = last - len(term) + 1, last + 1
        edge = lambda at: _word_char(low[at - 1 : at] or " ") != _word_char(low[at : at + 1] or " ")
        if value not in excluded and edge(start) and edge(end):
            found.append((start, -end, term, value))
    out, past = [], 0
    for start, end, term, value in sorted(found, key=lambda f: f[:2]):
        if start >= past:
            out.append((start, term, value))
            past = -end
    return out


def tag_terms(
    docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", exclude: str | None = None, max_terms: int = 500_000
) -> DataFrame:
    """key, offset, term, value for each tagged place; see find_terms().

    terms: term, value (the cluster that the name stands for); the smallest value of equal terms counts. exclude: the
    column of docs whose value must not be tagged in the row, such as the document's own cluster. The dictionary goes to
    every task as an automaton, so it is bounded: more than max_terms are refused.
    """
    import ahocorasick

    named = terms.where("term is not null and term <> ''").groupBy(F.col("term").alias("t")).agg(F.min("value").alias("v")).limit(max_terms + 1).collect()
    if len(named) > max_terms:
        raise ValueError(f"more than {max_terms} terms; raise max_terms if executors can hold them")
    automaton = ahocorasick.Automaton()
    for row in sorted(named, key=lambda r: (r["v"], r["t"]), reverse=True):
        automaton.add_word(_low(row["t"]), (_low(row["t"]), row["v"]))
    if named:
        automaton.make_automaton()
    sent = docs.sparkSession.sparkContext.broadcast(automaton)
    kinds = docs.schema[key].dataType.simpleString(), terms.schema["value"].dataType.simpleString()
    own = F.lit(None) if exclude is None else F.col(exclude)

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t, x in zip(b["k"], b["t"], b["x"], strict=True):
                if t is not None and len(sent.value):
                    rows += [(k, *f) for f in find_terms(t, sent.value, frozenset() if pd.isna(x) else frozenset([x]))]
            yield pd.DataFrame(rows, columns=[key, "offset", "term", "value"])

    named_docs = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), own.cast(kinds[1]).alias("x"))
    return named_docs.mapInPandas(tag, f"{key} {kinds[0]}, offset int, term string, value {kinds[1]}")


def page_chunks(excerpt: Column) -> Column:
    """What is looked for on the pages, by tier: six words from the middle (words 2 to 5 of a short excerpt, all of one
    of fewer than four words), then the first five, then the last five. Null for excerpts under 15 characters."""
    words, n = F.split(excerpt, " "), F.size(F.split(excerpt, " "))
    middle = F.when(n >= 8, F.slice(words, F.floor(n / 2).cast("int") - 2, F.lit(6))).when(n >= 4, F.slice(words, 2, F.least(n - 1, F.lit(4)))).otherwise(words)
    five = lambda at: F.when(n >= 5, F.array_join(F.slice(words, at, 5), " "))
    tiers = F.array(F.array_join(middle, " "), five(1), five(-5))
    return F.when(F.length(excerpt) >= 15, tiers)


def containing_page(excerpts: DataFrame, pages: DataFrame, key: str, text: str = "text", gram: int = 6) -> DataFrame:
    """For each excerpt the first page that contains its chunk, by the first tier that finds one: key, tier, page.

    pages: page, text, ordered by page; those of ten characters or fewer are blank. Both texts are normalised first.
    Candidates come from equality joins on the pages' distinct words: a chunk's inner words stand whole on its page, so
    the rarest is looked up; a chunk without one is looked up by the middle letters of its longest word, among the
    letter runs of the vocabulary. Page texts are read once more, for the candidates alone.
    """
    p = pages.select("page", page_text(F.col("text")).alias("__text")).where(F.length("__text") > 10)
    asked = excerpts.select(key, F.posexplode(page_chunks(page_text(F.col(text)))).alias("tier", "chunk")).where("chunk is not null and chunk <> ''")
    words = F.split("chunk", " ")
    inner = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = asked.withColumn("inner", inner).withColumn("piece", F.when(F.size(inner) == 0, F.substring(longest, 1, gram)))
    on_page = p.select("page", F.explode(F.array_distinct(F.split("__text", " "))).alias("w"))
    often = on_page.groupBy("w").agg(F.count("*").alias("n"))
    # every inner word must be known; the one on the fewest pages names the candidates
    looked = asked.where(F.size("inner") > 0).select(key, "tier", "chunk", F.explode("inner").alias("w"))
    rare = looked.join(often, "w", "left").groupBy(key, "tier", "chunk").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w")).alias("r"))
    whole = rare.where("r.n > 0").select(key, "tier", "chunk", F.col("r.w").alias("w"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("w") - gram + 1, F.lit(1))), lambda i: F.substring(F.col("w"), i, F.lit(gram)))
    runs = often.where(F.length("w") >= gram).select("w", F.explode(F.array_distinct(grams)).alias("piece"))
    short = asked.where(F.size("inner") == 0).select(key, "tier", "chunk", "piece").join(runs, "piece").select(key, "tier", "chunk", "w")
    at = whole.unionByName(short).join(on_page, "w").select(key, "tier", "chunk", "page").distinct()
    hits = at.join(p, "page").where(F.col("__text").contains(F.col("chunk")))
    best = hits.groupBy(key).agg(F.min(F.struct("tier", "page")).alias("b"))
    return best.select(key, (F.col("b.tier") + 1).alias("tier"), F.col("b.page").alias("page"))


def tokens(c: Column, stop: list[str] = ()) -> Column:
    """Lower-case words of three ASCII letters or more that aren't stop words; other characters are deleted."""
    plain = F.regexp_replace(F.lower(c), r"[^A-Za-z0-9_\s]", "")
    return F.filter(F.split(F.trim(plain), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(list(stop) or [""]))


def lead_sentences(c: Column, chars: int = 2000, least: int = 40, most: int = 6) -> Column:
    """The first sentences of the long paragraphs within the first characters."""
    paragraphs = F.filter(F.split(F.substring(c, 1, chars), "\n+"), lambda p: F.length(p) > least)
    sentences = F.split(F.array_join(paragraphs, " "), r"(?<=[.!?])\s+(?=[A-Z])")
    return F.regexp_replace(F.array_join(F.slice(sentences, 1, most), " "), r"(?s)([.!?])[^.!?]*$", "$1")


def ellipsis(c: Column, most: int) -> Column:
    """At most `most` characters, the last three of a longer text being dots."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def djvu_pages(xml: DataFrame, column: str = "value") -> DataFrame:
    """leaf (from 1) and text of each page of a scanned book's XML; blank pages stay."""
    objects = F.filter(F.split(F.col(column), r"(?=<OBJECT[\s>])"), lambda o: o.startswith("<OBJECT"))
    pages = xml.select(F.posexplode(objects).alias("pos", "object"))
    words = F.transform(F.regexp_extract_all("object", F.lit(r"<WORD[^>]*>([^<]*)</WORD>"), F.lit(1)), lambda w: F.trim(w))
    return pages.select((F.col("pos") + 1).alias("leaf"), F.array_join(words, " ").alias("text"))
