"""Lexical, hybrid and evidence ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalise import registry_text


def _overlap(q: str, name: Column) -> Column:
    n = F.length(name)
    return F.least(n, F.lit(len(q))) / F.greatest(n, F.lit(len(q)))


def cluster_score(q: str, names: Column, category: Column, texts: list[tuple[Column, float, int]], fuzzy: int = 10) -> Column:
    """Lexical score of a cluster for a query.

    1 for an exact name; else the best of substring matches, the category, the texts (column, score, shortest query) and
    near spellings of the first names.
    """
    q = q.lower().strip()
    low = F.transform(F.filter(names, lambda n: n.isNotNull() & (n != "")), F.lower)
    inside = F.transform(
        F.filter(low, lambda n: (F.length(n) >= 2) & (n.contains(q) | ((F.length(n) >= 3) & F.lit(q).contains(n)))),
        lambda n: 0.7 + 0.3 * _overlap(q, n),
    )
    similar = F.transform(F.slice(low, 1, fuzzy), lambda n: 1 - F.levenshtein(n, F.lit(q)) / F.greatest(F.length(n), F.lit(len(q))))
    near = F.transform(F.filter(similar, lambda s: s > 0.6), lambda s: s * 0.8)
    parts = [F.lit(0.0), F.array_max(inside), F.array_max(near)]
    if len(q) >= 3:
        c = F.lower(F.coalesce(category, F.lit("")))
        parts.append(F.when(c.contains(q) | F.lit(q).contains(c), 0.3))
    parts += [F.when(F.lower(text).contains(q), score) for text, score, least in texts if len(q) >= least]
    return F.when(F.array_contains(low, q), 1.0).otherwise(F.greatest(*parts))


def hybrid_score(lexical: Column, semantic: Column | None) -> Column:
    """The lexical score weighs more the surer it is."""
    if semantic is None:
        return lexical
    return F.when(lexical >= 0.9, 0.3 * semantic + 0.7 * lexical).when(lexical >= 0.6, 0.5 * semantic + 0.5 * lexical).otherwise(0.65 * semantic + 0.35 * lexical)


def search(index: DataFrame, q: str, score: Column, limit: int = 20, category: str | None = None, order: list[Column] | None = None) -> DataFrame:
    """The best entries for a query of two letters or more; a shorter one finds nothing. The filter runs before scoring."""
    rows = index if category in (None, "ALL") else index.where(F.col("category") == category)
    if len(q.strip()) < 2:
        rows = rows.where(F.lit(False))
    return rows.withColumn("score", F.round(score, 6)).where("score > 0").orderBy(F.desc("score"), *(order or [])).limit(max(0, limit))


def entity_score(q: Column, names: Column, category: Column) -> Column:
    """Score of a registry entity: exact, prefix, substring or near name; its category counts little."""
    folded = F.filter(F.transform(names, registry_text), lambda n: n != "")

    def one(n: Column) -> Column:
        long, short = F.greatest(F.length(n), F.length(q)), F.least(F.length(n), F.length(q))
        sim = 1 - F.levenshtein(n, q) / long
        return F.when(n == q, 1.0).when(n.startswith(q), 0.95).when(n.contains(q) | q.contains(n), 0.75 + 0.2 * short / long).when(sim >= 0.65, sim * 0.8).otherwise(0.0)

    best = F.coalesce(F.array_max(F.transform(folded, one)), F.lit(0.0))
    return F.when(q == "", 0.0).otherwise(F.greatest(best, F.when(registry_text(category).contains(q), 0.25).otherwise(0.0)))


def evidence_score(tokens: list[str], question: str, canonical: Column, names: Column, contexts: Column, count: Column, semantic: Column | None = None) -> Column:
    """Score of an entity as evidence for a question."""
    question = question.lower()
    low_names, low_contexts = F.lower(F.array_join(names, " ")), F.lower(F.array_join(contexts, " "))
    hits = sum((F.when(low_names.contains(t), 2.0).when(low_contexts.contains(t), 0.5).otherwise(0.0) for t in tokens), F.lit(0.0))
    first = F.lower(F.try_element_at(names, F.lit(1)))
    asked = F.when((F.length(canonical) > 3) & F.lit(question).contains(F.lower(canonical)), 4.0).otherwise(0.0)
    variant = F.coalesce(F.when((F.length(first) > 3) & F.lit(question).contains(first), 3.0), F.lit(0.0))
    near = 4 * F.coalesce(semantic, F.lit(0.0)) if semantic is not None else F.lit(0.0)
    return hits + asked + variant + near + 0.05 * F.log(count + F.lit(1))


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """facet, val, n over all rows, in one pass."""
    pairs = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(F.col(c).cast("string") for c in columns)))
    return df.select(F.explode(pairs).alias("facet", "val")).groupBy("facet", "val").agg(F.count("*").alias("n"))
