"""Prompts for a model that answers as a book's author, and the validation of its replies, as column expressions.

A profile is a struct: persona_name, persona_description, persona_type, voice_notes, voice_anchors, frameworks (array of
name, role, description), authorities_trusted, authorities_contested, knowledge_sources, blind_spots, historical_context,
sample_reasoning, private_facts, private_inferences, private_unknowns. Evidence is an array of structs in order of rank:
id, category, canonical_name, local_name, names, count, contexts, excerpts. Both are bounded: a book has one profile, and
a question at most some fifteen pieces of evidence.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: categories in the order in which evidence is shown, and words that ask for a procedure
CATEGORY_ORDER = ["SUBSTANCE", "DISEASE", "PLANT", "PERSON", "CONCEPT", "PLACE", "ANIMAL", "ANATOMY", "OBJECT"]
PROCEDURAL = r"(?i)\b(cure|treat|treatment|remedy|recipe|receipt|dose|dosage|prepare|preparation|compound|how do you make|how to make)\b"
CONFIDENCES = ["high", "moderate", "low", "speculative"]
MOST_EVIDENCE = 8

EVIDENCE = "array<struct<id string, category string, canonical_name string, local_name string, names array<string>, count bigint, contexts array<string>, excerpts array<string>>>"
REPLY = "response string, evidence_used array<struct<entity_id string, entity_name string, category string, relevance string, reasoning string>>, confidence string, confidence_explanation string, frameworks_applied array<string>, modern_note string"


def is_procedural(question: Column) -> Column:
    return question.rlike(PROCEDURAL)


def is_institution(profile: Column) -> Column:
    named = profile["persona_name"].rlike(r"(?i)\b(college|guild|society|academy|office|institution)\b")
    return F.coalesce((profile["persona_type"] == "institution") | named, F.lit(False))


def fallback_profile(author: Column, title: Column, language: Column, year: Column) -> Column:
    """The profile of a book that has none: its author, and reasoning from the text alone."""
    none = F.array().cast("array<string>")
    language, year = F.coalesce(language, F.lit("unknown")), year.cast("string")
    frameworks = F.array(
        F.struct(F.lit("Reasoning from the text").alias("name"), F.lit("primary").alias("role"), F.lit("Keep to the entities and contexts that this book attests.").alias("description"))
    )
    return F.struct(
        F.coalesce(author, F.lit("the author")).alias("persona_name"),
        F.concat(F.lit('The voice of the author of "'), title, F.lit('" ('), year, F.lit(").")).alias("persona_description"),
        F.lit("individual").alias("persona_type"),
        F.lit("Speak cautiously and as the period would; say where evidence is weak.").alias("voice_notes"),
        none.alias("voice_anchors"),
        frameworks.alias("frameworks"),
        none.alias("authorities_trusted"),
        none.alias("authorities_contested"),
        F.lit("The book's own entities and excerpts.").alias("knowledge_sources"),
        F.lit("Whatever was found after publication, and facts that no evidence attests.").alias("blind_spots"),
        F.concat(F.lit("Published in "), year, F.lit("; language: "), language, F.lit(".")).alias("historical_context"),
        F.lit("Direct evidence first, then analogy; speculation is named as such.").alias("sample_reasoning"),
        none.alias("private_facts"),
        none.alias("private_inferences"),
        none.alias("private_unknowns"),
    )


def materia(entities: Column, most: int = 8) -> Column:
    """A line per category in CATEGORY_ORDER: its number of entities and the most mentioned ones; entities is an array
    of structs name, category, count. Ties go by name."""

    def line(category: str) -> Column:
        own = F.filter(entities, lambda e: e["category"] == category)
        ranked = F.array_sort(F.transform(own, lambda e: F.struct((-e["count"]).alias("o"), e["name"].alias("n"), e["count"].alias("k"))))
        names = F.transform(F.slice(ranked, 1, most), lambda s: F.concat(s["n"], F.lit(" ("), s["k"].cast("string"), F.lit(")")))
        return F.when(F.size(own) > 0, F.concat(F.lit(f"- {category} ("), F.size(own).cast("string"), F.lit(" total): "), F.array_join(names, ", ")))

    return F.concat_ws("\n", *map(line, CATEGORY_ORDER))


def system_prompt(profile: Column, title: Column, year: Column, voice: Column, entities: Column) -> Column:
    """Who answers, what it can't know, how it sounds, and what its book is about; voice: excerpts of the book."""
    year, listed = year.cast("string"), lambda c: F.array_join(c, "; ")
    some = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    section = lambda head, body: F.concat(F.lit(f"\n## {head}\n"), body)
    frameworks = F.array_join(F.transform(profile["frameworks"], lambda f: F.concat(F.lit("- **"), f["name"], F.lit("** ("), f["role"], F.lit("): "), f["description"])), "\n")
    rules = F.concat(
        F.lit("- Knowledge ends in "), year, F.lit(', when "'), title, F.lit('" was published; nothing later is known.\n'),
        F.lit("- A later topic is unknown: say so, and answer by the closest analogy of the period.\n"),
        F.lit("- Modern mechanisms are never presented as known.\n- No invented private episodes, motives or feelings."),
    )
    mode = F.when(is_institution(profile), "- An institution speaks: `we`, formal.").otherwise("- The author speaks: `I`, in words of the period.")
    dossier = F.concat_ws(
        "\n",
        F.concat(F.lit("- Public: "), profile["persona_description"]),
        F.concat(F.lit("- Private facts: "), F.when(some(profile["private_facts"]), listed(profile["private_facts"])).otherwise("only what context and description imply.")),
        F.concat(F.lit("- Private inferences, marked as uncertain: "), F.when(some(profile["private_inferences"]), listed(profile["private_inferences"])).otherwise("cautious ones only.")),
        F.when(some(profile["private_unknowns"]), F.concat(F.lit("- Unknown, not to be invented: "), listed(profile["private_unknowns"]))),
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("You are "), profile["persona_name"], F.lit(". "), profile["persona_description"]),
        section("Limits of knowledge", rules),
        section("Mode", mode),
        F.concat(F.lit("\nVoice: "), profile["voice_notes"]),
        F.when(some(profile["voice_anchors"]), F.concat(F.lit("Phrases to return to: "), listed(profile["voice_anchors"]))),
        F.when(some(voice), section("Passages of your text, for the register", F.array_join(F.transform(voice, lambda x: F.concat(F.lit('> "'), x, F.lit('"'))), "\n"))),
        section("Frameworks", frameworks),
        section("Authorities trusted", F.array_join(profile["authorities_trusted"], ", ")),
        section("Authorities contested", F.array_join(profile["authorities_contested"], ", ")),
        section("Sources of knowledge", profile["knowledge_sources"]),
        section("Blind spots", profile["blind_spots"]),
        section("Historical context", profile["historical_context"]),
        section("Habit of reasoning", profile["sample_reasoning"]),
        section("Entities of your text, the most mentioned first", materia(entities)),
        section("Life", dossier),
    )


def _evidence_lines(evidence: Column, category: Column | str, full: bool) -> Column:
    """A heading, the lines of one category's evidence and an empty line; nothing for a category without any."""
    own = F.filter(evidence, lambda e: e["category"] == category)

    def lines(e: Column) -> Column:
        head = F.concat(F.lit("- ["), e["id"], F.lit("] "), e["local_name"], F.lit(" ("), e["count"].cast("string"), F.lit(" mentions)"))
        if not full:
            return head
        context, excerpt = F.try_element_at(e["contexts"], F.lit(1)), F.try_element_at(e["excerpts"], F.lit(1))
        return F.concat_ws("\n", head, F.concat(F.lit("  Context: "), context), F.concat(F.lit('  > "'), F.substring(excerpt, 1, 250), F.lit('"')))

    head = F.concat(F.lit("**"), category if isinstance(category, Column) else F.lit(category), F.lit(":**"))
    return F.when(F.size(own) > 0, F.concat_ws("\n", head, F.array_join(F.transform(own, lines), "\n"), F.lit("")))


def user_message(question: Column, evidence: Column, persona: Column, year: Column) -> Column:
    """The question, the evidence by category (known ones in their order, then others, without contexts), and how to answer."""
    others = F.array_distinct(F.transform(F.filter(evidence, lambda e: ~e["category"].isin(CATEGORY_ORDER)), lambda e: e["category"]))
    rest = F.array_join(F.transform(others, lambda c: _evidence_lines(evidence, c, False)), "\n")
    groups = F.concat_ws("\n", *(_evidence_lines(evidence, c, True) for c in CATEGORY_ORDER), F.when(F.size(others) > 0, rest))
    shown = F.when(F.size(evidence) > 0, F.concat(F.lit("Evidence from your text, by kind:\n\n"), groups)).otherwise("Your text does not speak of this; reason from your principles by analogy.\n")
    table = F.when(is_procedural(question), "The question asks for a procedure: give a table of items, reasons and cautions.").when(F.size(evidence) > 3, "A table may help.")
    form = '{"response":"answer in character","evidence_used":[{"entity_id":"id from above","entity_name":"name","category":"category","relevance":"direct|analogical","reasoning":"why"}],"confidence":"high|moderate|low|speculative","confidence_explanation":"why","frameworks_applied":["name"],"modern_note":""}'
    return F.concat_ws(
        "\n",
        F.concat(F.lit('A reader asks: "'), question, F.lit('"\n')),
        shown,
        F.concat(F.lit("Answer as "), persona, F.lit(" would, in the first person, from the above alone.")),
        F.concat(F.lit("The year is "), year.cast("string"), F.lit("; a modern term is unknown to you and answered by analogy.")),
        F.lit("Let the question set the length. No headings or remarks about the answer."),
        table,
        F.concat(F.lit("Reply with one JSON object: "), F.lit(form)),
    )


def parsed_reply(reply: Column) -> Column:
    """The reply's outermost JSON object as a REPLY struct; a stand-in of low confidence where there is none."""
    body = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)(\{.*\})", 1)
    found = F.from_json(body, REPLY, {"mode": "PERMISSIVE"})
    none = F.array().cast("array<struct<entity_id string, entity_name string, category string, relevance string, reasoning string>>")
    stand_in = F.struct(
        F.lit("My text as I have it does not let me answer with confidence.").alias("response"),
        none.alias("evidence_used"),
        F.lit("low").alias("confidence"),
        F.lit("The reply was not valid JSON.").alias("confidence_explanation"),
        F.array().cast("array<string>").alias("frameworks_applied"),
        F.lit("").alias("modern_note"),
    )
    broken = (body == "") | F.get_json_object(body, "$").isNull()
    return F.when(broken, stand_in).otherwise(found)


def validated(reply: Column, evidence: Column, question: Column) -> Column:
    """A REPLY struct in which only retrieved evidence is cited.

    A citation stands if its id was retrieved, or its name is one of a retrieved entity, whose id it then gets; at most
    MOST_EVIDENCE stay. An unknown confidence is moderate; modern notes go; headings of the reply are cut; an empty reply
    is replaced; and an answer about a procedure gets a table of the evidence if it has none.
    """
    ids = F.transform(evidence, lambda e: e["id"])
    entries = F.flatten(F.transform(evidence, lambda e: F.transform(F.concat(F.array(e["canonical_name"], e["local_name"]), F.coalesce(e["names"], F.array().cast("array<string>"))), lambda n: F.struct(F.lower(n).alias("n"), e["id"].alias("id")))))

    def owner(name: Column) -> Column:
        """The id of the last entity with this name."""
        own = F.filter(entries, lambda x: x["n"] == F.lower(F.coalesce(name, F.lit(""))))
        return F.try_element_at(own, F.lit(-1))["id"]

    used = F.transform(
        F.coalesce(reply["evidence_used"], F.array().cast("array<struct<entity_id string, entity_name string, category string, relevance string, reasoning string>>")),
        lambda u: F.struct(
            F.when(F.array_contains(ids, F.coalesce(u["entity_id"], F.lit(""))), u["entity_id"]).otherwise(owner(u["entity_name"])).alias("entity_id"),
            u["entity_name"].alias("entity_name"), u["category"].alias("category"), u["relevance"].alias("relevance"), u["reasoning"].alias("reasoning"),
        ),
    )
    used = F.slice(F.filter(used, lambda u: u["entity_id"].isNotNull()), 1, MOST_EVIDENCE)
    text = F.regexp_replace(F.coalesce(reply["response"], F.lit("")), r"(?im)^\s*#{1,6}\s*(response|interpretation)\s*$", "")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)^\s*(response|interpretation)\s*:?\s*", ""), r"^\s+|\s+$", "")
    text = F.when(text == "", "My text as I have it does not suffice for a sure answer.").otherwise(text)
    has_table = text.rlike(r"\|.+\|") & text.rlike(r"\n\|(?:\s*:?-+:?\s*\|)+\s*\n")
    why = lambda e: F.coalesce(F.nullif(F.replace(F.try_element_at(e["contexts"], F.lit(1)), F.lit("|"), F.lit("/")), F.lit("")), F.lit("Named in the text"))
    rows = F.transform(F.slice(evidence, 1, 5), lambda e: F.concat(F.lit("| "), e["local_name"], F.lit(" | "), e["category"], F.lit(" | "), why(e), F.lit(" |")))
    table = F.concat(F.lit("\n\n## Evidence\n\n| Item | Kind | Reason |\n|---|---|---|\n"), F.array_join(rows, "\n"))
    text = F.when(~has_table & is_procedural(question) & (F.size(evidence) > 0), F.concat(text, table)).otherwise(text)
    sure = F.when(reply["confidence"].isin(CONFIDENCES), reply["confidence"]).otherwise("moderate")
    return F.struct(
        text.alias("response"), used.alias("evidence_used"), sure.alias("confidence"), reply["confidence_explanation"].alias("confidence_explanation"),
        F.coalesce(reply["frameworks_applied"], F.array().cast("array<string>")).alias("frameworks_applied"), F.lit("").alias("modern_note"),
    )
