"""Predicates and rule-based classifiers on names, clusters and findings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalise import PARTICLES, registry_text
from .similarity import contains_either, edit_similarity, prefix_length

# --- noise in names ----------------------------------------------------------------------------------------------
# fixed values: characters that scanning leaves, bibliographic references and month names
OCR_CHARS = "[»«^§|{}†‡¶•☉♀♈〈〉]"
BIBLIO = r"(?i)\b(fol\.|lib\.|cap\.|timoth\b|regum\b)\b"
MONTHS = (
    r"(?i)\b(janeiro|fevereiro|marco|março|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro|"
    r"january|february|march|april|may|june|july|august|september|october|november|december)\b"
)


def _count(c: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(c, keep, ""))


def noise_tests(name: Column, mentions: Column, latin: str = r"\p{IsLatin}", non_latin_floor: int = 20) -> list[tuple[str, Column]]:
    """The noise rules in order, as (reason, test)."""
    raw = F.trim(F.coalesce(name, F.lit("")))
    letters, digits = _count(raw, r"[^\p{L}]"), _count(raw, r"[^\p{N}]")
    marks, size = _count(raw, r"[\p{L}\p{N}\s]"), F.length(raw)
    longer = F.greatest(size, F.lit(1))
    return [
        ("empty", raw == ""),
        ("ocr_noise_char", raw.rlike(OCR_CHARS)),
        ("empty_after_normalize", (raw != "") & (registry_text(raw) == "")),
        ("bibliographic_fragment", raw.rlike(BIBLIO)),
        ("very_short_low_count", (size <= 2) & (mentions < 10)),
        ("year_or_page_token", raw.rlike("(?i)^[0-9]{3,4}[a-z]?$")),
        ("date_phrase", raw.rlike(MONTHS) & (digits >= 1)),
        ("slash_noise", raw.rlike(r"[/\\]") & (mentions < 100)),
        ("symbol_noise", raw.rlike("[£€<>]")),
        ("wrapped_punctuation", raw.rlike(r"""^[_'".()\[\]{}]+|[_'".()\[\]{}]+$""")),
        ("numeric_only", (letters == 0) & (digits > 0)),
        ("punctuation_only", (letters == 0) & (marks >= 2)),
        ("non_latin_low_count", ~raw.rlike(latin) & (mentions < non_latin_floor)),
        ("high_punctuation_ratio", (letters > 0) & (marks / longer >= 0.35)),
        ("high_digit_ratio", (digits >= 4) & (digits / longer > 0.45)),
        ("bounded_by_nonword", raw.rlike(r"^[\W_].*[\W_]$") & (letters < 3)),
    ]


def is_noise_name(name: Column, mentions: Column) -> Column:
    test = F.lit(False)
    for _, t in noise_tests(name, mentions):
        test = test | t
    return test


def noise_reasons(name: Column, mentions: Column, non_latin_floor: int = 20) -> Column:
    """All reasons; an empty name has only the first."""
    tests = noise_tests(name, mentions, "[A-Za-zÀ-ÿ]", non_latin_floor)
    listed = F.filter(F.array(*[F.when(t, reason) for reason, t in tests[1:]]), lambda r: r.isNotNull())
    return F.when(tests[0][1], F.array(F.lit("empty"))).otherwise(listed)


def is_useful_name(name: Column, least: int = 3) -> Column:
    """Long enough, not a number, no chapter reference, no function word."""
    n = F.trim(name)
    low = F.lower(n)
    # fixed values: words that say nothing
    words = ["the", "and", "for", "with", "from", "that", "this"]
    return (F.length(n) >= least) & ~n.rlike("^[0-9]+$") & ~low.startswith("chapter") & ~low.startswith("cap.") & ~low.isin(words)


def is_ocr_garbage(name: Column) -> Column:
    alpha = _count(name, r"[^\p{L}]")
    # fixed values: characters and patterns of damaged scans
    chars = "[»«^§|{}†‡¶≫≪●◆■□★☆♦♣♠♥]"
    pattern = r"\b[A-Z]{1,2}\s[A-Z]{1,2}\b|[^\w\s.,;:'\-()]{2,}|\w+\^\w+|\d{3,}"
    return name.rlike(chars) | name.rlike(pattern) | (alpha < 2) | ((alpha < F.length(name) * 0.3) & (F.length(name) > 3))


def low_alpha(name: Column, floor: float = 0.6) -> Column:
    return _count(name, r"[^\p{L}]") / F.greatest(F.length(name), F.lit(1)) < floor


def is_specific_name(name: Column, generic: list[str] = ()) -> Column:
    """Four letters or more, not generic, and of several words, capitalised or with a Latinate ending."""
    low = F.lower(F.trim(name))
    # fixed values: endings of pharmaceutical names
    ending = "(?:ium|eum|icum|osum|alis|aris|inus|atus|ica|osa|ola)$"
    shape = (F.size(F.split(low, r"\s+")) >= 2) | (name.rlike(r"^\p{Lu}") & (F.length(low) >= 5)) | low.rlike(ending)
    return (F.length(low) >= 4) & ~low.isin(list(generic) or [""]) & shape


def is_transparent_cognate(a: Column, b: Column) -> Column:
    """The same first four letters and nearly the same length, or aligned words that begin alike."""
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    start = (F.substring(a, 1, 4) == F.substring(b, 1, 4)) & (F.abs(F.length(a) - F.length(b)) <= 3) & (F.least(F.length(a), F.length(b)) >= 4)
    wa, wb = F.split(a, r"\s+"), F.split(b, r"\s+")
    same = F.size(F.filter(F.zip_with(wa, wb, lambda x, y: F.substring(x, 1, 3) == F.substring(y, 1, 3)), lambda t: t))
    words = (F.size(wa) >= 2) & (F.size(wa) == F.size(wb)) & (same >= F.size(wa) - 1)
    return start | words


# --- merges and variants ------------------------------------------------------------------------------------------


def plausible_merge(a: Column, b: Column, category: Column) -> Column:
    """Whether two names can be one entity: not unlike surnames after one first name, not unlike short names."""
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    wa, wb = F.split(a, r"\s+"), F.split(b, r"\s+")

    def last(w: Column) -> Column:
        end = F.element_at(w, -1)
        return F.when(end.isin(PARTICLES) & (F.size(w) >= 3), F.element_at(w, F.greatest(F.size(w) - 1, F.lit(1)))).otherwise(end)

    la, lb = last(wa), last(wb)
    allowed = F.greatest(F.lit(2), F.floor(F.least(F.length(la), F.length(lb)) / 2))
    persons = (category == "PERSON") & (F.size(wa) >= 2) & (F.size(wb) >= 2)
    apart = persons & (F.element_at(wa, 1) == F.element_at(wb, 1)) & (F.levenshtein(la, lb) > allowed)
    shorter = F.least(F.length(a), F.length(b))
    unlike = (shorter < 8) & (F.levenshtein(a, b) > F.greatest(F.lit(1), F.floor(shorter / 3)))
    return contains_either(a, b) | (~F.coalesce(apart, F.lit(False)) & ~unlike)


def valid_variant(name: Column, variant: Column, least: int = 4, floor: float = 0.45) -> Column:
    """Equal names, long enough substrings, or near spellings."""
    n, v = F.lower(F.trim(name)), F.lower(F.trim(variant))
    inside = F.least(F.length(n), F.length(v)) >= least
    return F.when(n == v, True).when(contains_either(n, v), inside).otherwise(edit_similarity(name, variant) >= floor)


# --- classifiers --------------------------------------------------------------------------------------------------


def link_type(sim: Column, same_language: Column, cat_a: Column, cat_b: Column, sub_a: Column, sub_b: Column, ortho: float = 0.90, same: float = 0.80) -> Column:
    matter = ["PLANT", "ANIMAL", "MINERAL"]
    made = ((sub_a == "PREPARATION") & sub_b.isin(matter)) | ((sub_b == "PREPARATION") & sub_a.isin(matter))
    return (
        F.when(same_language & (sim > ortho), "orthographic_variant")
        .when(~same_language & (sim > same), "same_referent")
        .when((cat_a == cat_b) & (sim > 0.75), "same_referent")
        .when((cat_a == cat_b) & (sim > 0.65), "conceptual_overlap")
        .when(made & (sim > 0.6), "derivation")
        .otherwise("conceptual_overlap")
    )


# fixed values: words that tell a relationship, in the order in which ties are resolved
RELATIONSHIPS = {
    "true_synonym": ["synonym", "equivalent", "same as", "identical", "also called", "alternative name", "known as", "that is", "i.e.", "namely"],
    "cross_linguistic": ["called in", "portuguese", "spanish", "italian", "french", "english", "latin", "arabic", "greek", "persian", "sanskrit", "local name", "vernacular", "vulgar name", "trade name", "in malabar", "in persia"],
    "contested_identity": ["debated", "confused", "conflated", "mistaken", "disputed", "may be", "possibly", "uncertain", "different from", "distinct", "some say", "others claim"],
    "subtype_relation": ["type of", "variety", "subtype", "specific form", "kind of", "preparation of", "derived from", "extracted from", "made from"],
    "ingredient_cooccurrence": ["ingredient", "component", "listed", "recipe", "compound", "formula", "mixed with", "added to", "preparation"],
    "authority_cooccurrence": ["authority", "cited", "mentioned alongside", "mentioned by", "according to", "writes that", "says that"],
}


def keyword_score(text: Column, words: list[str]) -> Column:
    """How many of the words occur."""
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def relationship(text: Column, source_category: Column, found_category: Column, groups: dict[str, list[str]] | None = None) -> Column:
    """struct(label, confidence) by the group with most keywords, the first on a tie; else by categories."""
    low = F.lower(text)
    groups = groups or RELATIONSHIPS
    scored = [F.struct(keyword_score(low, words).alias("n"), F.lit(-i).alias("o"), F.lit(label).alias("label")) for i, (label, words) in enumerate(groups.items())]
    best = F.greatest(*scored)
    both = (F.upper(source_category) == "PERSON") & (F.upper(found_category) == "PERSON")
    plain = lambda label, confidence: F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))
    found = F.struct(best["label"].alias("label"), F.least(F.lit(0.95), F.round(0.5 + best["n"] * 0.15, 6)).alias("confidence"))
    return (
        F.when(best["n"] > 0, found)
        .when(both, plain("authority_cooccurrence", 0.7))
        .when(F.upper(source_category) == F.upper(found_category), plain("possible_synonym", 0.4))
        .otherwise(plain("unclassified", 0.2))
    )


def capitalised_terms(text: Column) -> Column:
    """Distinct capitalised words, each with the lower-case word that may follow it."""
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-zà-ú]{2,}(?:\s+[a-zà-ú]+)?)\b"), F.lit(1))))


def is_recipe(text: Column, quantity: str, structure: str, words: list[str], relation: Column) -> Column:
    """By quantity marks, structural marks and capitalised terms; the patterns are parameters."""
    n = F.regexp_count(text, F.lit(quantity))
    caps = capitalised_terms(text)
    told = keyword_score(F.lower(relation), words) > 0
    return (n >= 3) | (text.rlike(structure) & (n >= 1)) | ((caps >= 6) & (n >= 1)) | (told & ((n >= 1) | (caps >= 5)))


def vocabulary_match(found_category: Column, category: Column, found: Column, found_norm: Column, name: Column, modern: Column) -> Column:
    """Whether one matched cluster is a good match for a found name."""
    short = F.least(F.length(found), F.length(name))
    shared = F.when(short > 0, prefix_length(found, name) / short).otherwise(1.0)
    clash = (found_category != "") & (category != "") & (found_category != category)
    return ~clash & (contains_either(found_norm, name) | contains_either(found_norm, modern) | contains_either(found, name) | (shared >= 0.6))


def finding_label(ocr: Column, generic: Column, relation: Column, match_ok: Column, recipe: Column, specific: Column, matched: Column, cross: Column) -> Column:
    """The decision list on a finding's signals: label."""
    positive = ["true_synonym", "cross_linguistic", "contested_identity", "subtype_relation"]
    in_recipe = (
        F.when(relation == "ingredient_cooccurrence", "ingredient_cooccurrence")
        .when(cross & specific, "entity_in_recipe")
        .when(~matched & ~specific, "ingredient_cooccurrence")
        .when(matched & specific, "entity_in_recipe")
        .otherwise("probable_recipe")
    )
    return (
        F.when(ocr, "ocr_noise")
        .when(generic, "generic_term")
        .when(relation.isin(positive), relation)
        .when(~match_ok, "spurious_match")
        .when(relation == "authority_cooccurrence", relation)
        .when(recipe, in_recipe)
        .when(cross & specific, "probable_link")
        .when(matched, "possible_link")
        .otherwise("needs_review")
    )


# fixed values: strength of each type of link
LINK_STRENGTH = {"same_referent": 1.0, "orthographic_variant": 0.95, "cross_linguistic": 0.9, "contested_identity": 0.7, "conceptual_overlap": 0.5, "derivation": 0.4}


def link_strength(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LINK_STRENGTH.items() for x in kv])
    return F.coalesce(F.try_element_at(table, kind), F.lit(0.5))


def xref_type(label: Column, relation: Column, groups: dict[str, list[str]]) -> Column:
    """The type of a cross-reference; groups gives the keyword lists context, naming, derivation and made."""
    low = F.lower(relation)
    has = lambda g: keyword_score(low, groups[g]) > 0
    open_label = label.isin("llm_genuine", "probable_link", "possible_link", "entity_in_recipe")
    return (
        F.when(label == "true_synonym", "same_referent")
        .when(label.isin("cross_linguistic", "contested_identity"), label)
        .when((label == "subtype_relation") & has("made"), "derivation")
        .when(open_label & has("context"), "conceptual_overlap")
        .when(open_label & has("naming"), "cross_linguistic")
        .when(open_label & has("derivation"), "derivation")
        .otherwise("conceptual_overlap")
    )


def junk_cluster(name: Column, mentions: Column, has_content: Column, modern: Column, always: list[str] = ()) -> Column:
    """A reason and, by its start, a verdict: known_junk and empty_low_mentions are junk."""
    return (
        F.when(name.isin(list(always) or [""]), "known_junk")
        .when(has_content, "has_content")
        .when(F.coalesce(modern, F.lit("")) != "", "has_modern_name")
        .when(mentions <= 5, "empty_low_mentions")
        .otherwise("enough_mentions")
    )


def noise_cluster(name: Column, mentions: Column) -> Column:
    return ((F.length(name) <= 2) & (mentions < 10)) | name.rlike(r"[^\p{L}]{3,}")


def repair_category(category: Column, subcategory: Column, valid: dict[str, list[str]], aliases: dict[str, str]) -> Column:
    """struct(category, subcategory): aliases resolved, unknown subcategories to OTHER_<category>, unknown categories
    by their subcategory."""
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None
    sub = F.coalesce(F.try_element_at(table, subcategory), subcategory) if aliases else subcategory
    by_sub = F.lit(None).cast("string")
    known = F.lit(False)
    for cat, subs in valid.items():
        by_sub = F.when(sub.isin(subs), cat).otherwise(by_sub)
        known = known | ((category == cat) & sub.isin(subs))
    cat = F.when(category.isin(list(valid)), category).otherwise(F.coalesce(by_sub, category))
    fits = F.lit(False)
    for c, subs in valid.items():
        fits = fits | ((cat == c) & sub.isin(subs))
    return F.struct(cat.alias("category"), F.when(fits, sub).otherwise(F.concat(F.lit("OTHER_"), cat)).alias("subcategory"))


def tier(has_id: Column, confidence: Column, share_of_books: Column) -> Column:
    return F.when(has_id & (confidence == "high") & (share_of_books < 0.5), 1).when(~has_id & (confidence == "low") & (share_of_books > 0.5), 3).otherwise(2)


def training_label(kind: Column) -> Column:
    """The numeric target of a pair's link type."""
    return (
        F.when(kind.isin("same_referent", "orthographic_variant"), 1.0)
        .when(kind == "hard_negative", 0.0)
        .when(kind == "contested_identity", 0.5)
        .otherwise(0.3)
    )
