"""Similarity, lookup and pair joins.

Every similarity join is an equi-join on a block (category, prefix, book) or on rare letter runs, so Spark never plans a
nested loop over the whole input.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normalise import name_text
from ..functions.rules import plausible_merge
from ..functions.similarity import contains_either, edit_similarity, string_similarity


def renamed(df: DataFrame, suffix: str) -> DataFrame:
    """All columns with a suffix."""
    return df.select(*(F.col(c).alias(c + suffix) for c in df.columns))


def similar_within_book(
    entities: DataFrame, floor: float = 0.88, person_floor: float = 0.85, ease: float = 0.05, least_string: float = 0.3
) -> DataFrame:
    """Merge candidates of one book and category (columns book_id, id, name, category, vector): a, b, sim, string_sim.

    The floor is lower for persons and for names that are alike (string similarity over one half).
    """
    return similar_pairs(entities, True, floor, person_floor, ease, least_string, guard=True)


def similar_across_books(entities: DataFrame, floor: float = 0.84, person_floor: float = 0.80, ease: float = 0.03) -> DataFrame:
    """Match candidates between books, of one category: a, b, book_a, book_b, sim, string_sim."""
    return similar_pairs(entities, False, floor, person_floor, ease, 0.0, guard=False)


def similar_pairs(entities: DataFrame, same_book: bool, floor: float, person_floor: float, ease: float, least_string: float, guard: bool) -> DataFrame:
    """The blocked theta join under both of the above; guard drops implausible merges.

    Vectors meet in packs, as matrix products; names join only the pairs that are near enough.
    """
    from .neighbours import vector_pairs  # which uses this module

    key = F.xxhash64("book_id", "id")  # an id may be a book's own
    block = ["category", "book_id"] if same_book else ["category"]
    keyed = entities.select(key.alias("key"), F.to_json(F.struct(*block)).alias("block"), "vector")
    near = vector_pairs(keyed, "key", "vector", "block", min(floor, person_floor) - ease, 15).select("a", "b", "sim")
    named = entities.select(key.alias("key"), "book_id", "id", "name", "category")
    a, b = renamed(named, "_a"), renamed(named, "_b")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))  # the pair's order is by book or id
    found = both.join(a, F.col("a") == F.col("key_a")).join(b, F.col("b") == F.col("key_b"))
    found = found.where(F.col("id_a") < F.col("id_b") if same_book else F.col("book_id_a") < F.col("book_id_b"))
    base = F.when(F.col("category_a") == "PERSON", person_floor).otherwise(floor)
    found = found.where(F.col("sim") >= base - ease)
    found = found.withColumn("string_sim", string_similarity(F.col("name_a"), F.col("name_b")))
    found = found.where((F.col("sim") >= base - F.when(F.col("string_sim") > 0.5, ease).otherwise(0.0)) & (F.col("string_sim") >= least_string))
    if guard:
        found = found.where(plausible_merge(F.col("name_a"), F.col("name_b"), F.col("category_a")))
    return found.select(
        F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.col("book_id_a").alias("book_a"), F.col("book_id_b").alias("book_b"), "sim", "string_sim"
    )


def knn_rules(pairs: DataFrame) -> DataFrame:
    """The rules that a nearest neighbour must pass, on columns sim, string_sim, category_*, subcategory_*."""
    open_ended = lambda c: c.isNull() | (c == "") | c.startswith("OTHER_")
    sa, sb, sim, alike = F.col("subcategory_a"), F.col("subcategory_b"), F.col("sim"), F.col("string_sim")
    return pairs.where(
        (F.col("category_a") == F.col("category_b"))
        & ((sa == sb) | open_ended(sa) | open_ended(sb))
        & (sim >= 0.65)
        & ((F.col("category_a") != "PERSON") | (alike >= 0.35))
        & ((sa != "PREPARATION") | (sim >= 0.90))
        & ((sa != "OTHER_CONCEPT") | ((sim >= 0.92) & (alike >= 0.3)))
        & (~sa.startswith("OTHER_") | (sa == "OTHER_CONCEPT") | (alike >= 0.25))
    )


def best_unordered(pairs: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """One row per unordered pair, the one with the largest score."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    order = Window.partitionBy("__lo", "__hi").orderBy(F.desc(score), a, b)
    ranked = pairs.withColumn("__lo", lo).withColumn("__hi", hi).withColumn("__rn", F.row_number().over(order))
    return ranked.where("__rn = 1").drop("__lo", "__hi", "__rn")


def greedy_matching(pairs: DataFrame, a: str = "a", b: str = "b", score: str = "sim") -> DataFrame:
    """One-to-one matching in falling order of score; ties go to the smaller a, then b.

    Each round takes all edges that are the best left at both of their ends, which the sequential greedy would take
    too, and drops the edges that touch them. Rounds are few but for monotone chains.
    """
    left = cut_lineage(pairs.select(a, b, score))
    taken = None
    while True:
        first = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(F.desc(score), a, b))
        best = left.withColumn("__ra", first(a)).withColumn("__rb", first(b)).where("__ra = 1 and __rb = 1").drop("__ra", "__rb")
        best = cut_lineage(best)
        if not best.limit(1).count():
            return taken if taken is not None else best
        taken = best if taken is None else taken.unionByName(best)
        left = cut_lineage(left.join(best.select(a), a, "left_anti").join(best.select(b), b, "left_anti"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint()


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session in one process may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root or os.path.join(tempfile.gettempdir(), "loomwright")


def edit_candidates(df: DataFrame, key: str, text: str, block: str, floor: float, gram: int = 2) -> DataFrame:
    """Pairs a < b of one block whose texts may have an edit similarity of floor or more (none that has is missing).

    One edit changes at most `gram` of a text's letter runs, so texts within d edits share one of the first gram * d + 1
    of them, in any common order; the rarest runs of the block come first, which keeps the join keys small. A text with no
    more runs than that also stands under one key of its block with its like, which only very short texts do.
    """
    length = F.length(text)
    edits = F.floor((1 - floor) * length / floor + 1e-9).cast("int")  # to the longest text that can still be near
    runs = F.transform(F.sequence(F.lit(1), length - gram + 1), lambda i: F.substring(F.col(text), i, F.lit(gram)))
    none = F.array().cast("array<string>")
    rows = df.where(F.col(text).isNotNull() & (length > 0)).select(
        F.col(key).alias("id"), F.col(block).alias("blk"), length.alias("n"), edits.alias("d"), F.col(text).alias("whole"), F.when(length >= gram, runs).otherwise(none).alias("runs")
    )
    few = F.when(F.size("runs") <= gram * F.col("d"), F.lit(""))
    equal = F.when(F.col("d") == 0, F.concat(F.lit("\u0002"), "whole"))
    both = F.concat("runs", F.array_compact(F.array(few, equal)))
    # equal runs of one text are told apart by their number
    each = rows.select("id", "blk", "n", "d", F.size("runs").alias("m"), F.posexplode(both).alias("i", "run")).withColumn("special", F.col("i") >= F.col("m"))
    each = each.withColumn("k", F.row_number().over(Window.partitionBy("id", "blk", "run").orderBy("i")))
    often = each.groupBy("blk", "run", "k").agg(F.count("*").alias("f"))
    order = Window.partitionBy("id", "blk").orderBy("special", "f", "run", "k")
    prefix = each.join(often, ["blk", "run", "k"]).withColumn("at", F.row_number().over(order)).where(F.col("special") | (F.col("at") <= gram * F.col("d") + 1))
    keys = prefix.select("id", "blk", "n", F.concat_ws("\u0001", "run", F.col("k").cast("string")).alias("x"))
    other = keys.select(F.col("id").alias("id2"), F.col("blk").alias("blk2"), F.col("n").alias("n2"), F.col("x").alias("x2"))
    close = F.least("n", "n2") >= floor * F.greatest("n", "n2") - 1e-9
    pairs = keys.join(other, (F.col("blk") == F.col("blk2")) & (F.col("x") == F.col("x2")) & (F.col("id") < F.col("id2")) & close)
    return pairs.select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()


def near_duplicate_clusters(clusters: DataFrame, floor: float = 0.83, place_floor: float = 0.85) -> DataFrame:
    """Pairs of clusters (cluster_id, canonical_name, category, books array, names array) of one category that share a
    book and have nearly equal names, or have equal names and share a member name: a, b, sim."""
    a, b = renamed(clusters, "_a"), renamed(clusters, "_b")
    sim = edit_similarity(F.col("canonical_name_a"), F.col("canonical_name_b"))
    bar = F.when(F.col("category_a") == "PLACE", place_floor).otherwise(floor)
    near = edit_candidates(clusters, "cluster_id", "canonical_name", "category", min(floor, place_floor))
    pairs = near.join(a, F.col("a") == F.col("cluster_id_a")).join(b, F.col("b") == F.col("cluster_id_b"))
    pairs = pairs.withColumn("sim", F.round(sim, 6)).where(F.col("sim") >= bar)
    alike = F.arrays_overlap("books_a", "books_b") | ((F.col("sim") == 1.0) & F.arrays_overlap("names_a", "names_b"))
    return pairs.where(alike).select(F.col("cluster_id_a").alias("a"), F.col("cluster_id_b").alias("b"), "sim")


def within_cluster_pairs(members: DataFrame, name: str = "name") -> DataFrame:
    """Pairs of different names of one cluster from different books, each unordered pair of names once."""
    m = members.select("cluster_id", "book_id", F.col(name).alias("n"))
    a, b = renamed(m, "_a"), renamed(m, "_b")
    on = (F.col("cluster_id_a") == F.col("cluster_id_b")) & (F.col("book_id_a") < F.col("book_id_b")) & (F.col("n_a") != F.col("n_b"))
    return a.join(b, on).select(F.least("n_a", "n_b").alias("name_a"), F.greatest("n_a", "n_b").alias("name_b")).distinct()


def hard_negatives(names: DataFrame, low: float = 0.12, high: float = 0.45) -> DataFrame:
    """Pairs of names (name, cluster_id, category) that begin alike but belong to different clusters, with a score."""
    n = names.withColumn("prefix", F.substring(F.lower("name"), 1, 3))
    a, b = renamed(n, "_a"), renamed(n, "_b")
    on = (F.col("prefix_a") == F.col("prefix_b")) & (F.col("cluster_id_a") < F.col("cluster_id_b"))
    pairs = a.join(b, on).withColumn("dist", F.round(1 - edit_similarity(F.col("name_a"), F.col("name_b")), 6))
    pairs = pairs.where(F.col("dist").between(low, high) & ~contains_either(F.lower("name_a"), F.lower("name_b")))
    score = (1 - F.col("dist")) * F.when(F.col("category_a") == F.col("category_b"), 1.2).otherwise(1.0)
    return pairs.select("name_a", "name_b", "cluster_id_a", "cluster_id_b", "dist", F.round(score, 6).alias("score"))


def tiered_lookup(df: DataFrame, index: DataFrame, tiers: list[Column], key: str, value: str) -> DataFrame:
    """The first tier's key found in index (key, value): adds value and tier (1 for the first). Unmatched rows stay."""
    out = df
    for k, tier in enumerate(tiers):
        side = index.select(F.col(key).alias(f"__k{k}"), F.col(value).alias(f"__v{k}"))
        out = out.join(side, tier == F.col(f"__k{k}"), "left")
    found = F.coalesce(*(F.col(f"__v{k}") for k in range(len(tiers))))
    which = F.coalesce(*(F.when(F.col(f"__v{k}").isNotNull(), k + 1) for k in range(len(tiers))))
    out = out.withColumn("__value", found).withColumn("tier", which)
    return out.drop(*(f"__{c}{k}" for c in "kv" for k in range(len(tiers)))).withColumnRenamed("__value", value)


def singletons(entities: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Entities that are in no cluster."""
    return entities.join(members.select(*keys).distinct(), keys, "left_anti")


def name_tiers(found: Column) -> list[Column]:
    """The forms under which a found name is looked up: as it is, without final punctuation, and with one kind of letter
    that scans confuse replaced, one kind at a time."""
    key = F.lower(F.trim(found))
    # fixed values: letters that scans confuse
    confused = [("ſ", "s"), ("ƒ", "f"), ("ﬁ", "fi"), ("ﬂ", "fl")]
    return [key, F.regexp_replace(key, r"""[.,;:!?'"]+$""", ""), *(F.replace(key, F.lit(old), F.lit(new)) for old, new in confused)]


def migration_matches(new: DataFrame, new_members: DataFrame, old: DataFrame, old_members: DataFrame) -> DataFrame:
    """One-to-one matches of new clusters with old ones that have ground truth: new_id, old_id, strategy, score.

    clusters: cluster_id, category, canonical_name, wikidata_id, modern_name, total_mentions; old ones also has_truth.
    members: cluster_id, book_id, entity_id, names (name and variants). A new cluster proposes by the first strategy that
    finds an old cluster of its category: the same wikidata_id; shared members (3 a shared entity, 1 a shared name in
    one book; 3 points, two names, or a name with an entity or with its own name among the old aliases will do); most
    aliases that are the old one's modern name; most shared aliases, two at least. Ties go to more mentions, then to the
    smaller id. Of the proposals to one old cluster the best strategy, score and number of mentions wins.
    """
    norm = lambda c: F.filter(F.array_distinct(F.transform(c, name_text)), lambda n: n.isNotNull() & (n != ""))

    def named(clusters: DataFrame, members: DataFrame, id: str) -> tuple[DataFrame, DataFrame]:
        """Members with their category and normalised names; distinct aliases of each cluster."""
        kind = clusters.select(F.col("cluster_id").alias(id), "category")
        rows = members.select(F.col("cluster_id").alias(id), "book_id", "entity_id", norm(F.col("names")).alias("names")).join(kind, id)
        own = clusters.select(F.col("cluster_id").alias(id), "category", F.explode(norm(F.array("canonical_name", "modern_name"))).alias("alias"))
        return rows, own.unionByName(rows.select(id, "category", F.explode("names").alias("alias"))).distinct()

    def best(pairs: DataFrame, *order: Column) -> DataFrame:
        ranked = pairs.join(old.select(F.col("cluster_id").alias("old_id"), F.col("total_mentions").alias("__m")), "old_id")
        w = Window.partitionBy("new_id").orderBy(*order, F.desc("__m"), "old_id")
        return ranked.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__m")

    mine, my_aliases = named(new, new_members, "new_id")
    theirs, old_aliases = named(old, old_members, "old_id")
    known = lambda df, id: df.select(F.col("cluster_id").alias(id), "category", F.trim("wikidata_id").alias("wd")).where("wd <> ''")
    same_id = known(new, "new_id").join(known(old.where("has_truth"), "old_id"), ["wd", "category"])
    first = best(same_id.select("new_id", "old_id")).select("new_id", "old_id", F.lit(1000.0).alias("score"))

    ids = mine.where("book_id is not null and entity_id is not null").select("new_id", "book_id", "entity_id", "category")
    ids = ids.join(theirs.select("old_id", "book_id", "entity_id", "category"), ["book_id", "entity_id", "category"])
    name = lambda df, id: df.select(id, "book_id", "category", F.explode("names").alias("n"))
    names = name(mine, "new_id").join(name(theirs, "old_id"), ["book_id", "category", "n"])
    points = ids.select("new_id", "old_id", F.lit(1).alias("i"), F.lit(0).alias("n")).unionByName(names.select("new_id", "old_id", F.lit(0).alias("i"), F.lit(1).alias("n")))
    points = points.groupBy("new_id", "old_id").agg(F.sum("i").alias("i"), F.sum("n").alias("n")).withColumn("w", 3 * F.col("i") + F.col("n"))
    top = best(points, F.desc("w"), F.desc("n"), F.desc("i"))
    both = top.join(my_aliases.select("new_id", "alias"), "new_id").join(old_aliases.select("old_id", "alias"), ["old_id", "alias"])
    shared = both.groupBy("new_id").agg(F.count("*").alias("k"))
    called = new.select(F.col("cluster_id").alias("new_id"), name_text(F.col("canonical_name")).alias("alias"))
    by_name = top.join(called, "new_id").join(old_aliases.select("old_id", "alias"), ["old_id", "alias"], "left_semi").select("new_id", F.lit(True).alias("called"))
    top = top.join(shared, "new_id", "left").join(by_name, "new_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    enough = (F.col("w") >= 3) | (F.col("n") >= 2) | ((F.col("n") >= 1) & (F.col("i") >= 1)) | ((F.col("n") == 1) & (F.col("k") >= 1) & F.coalesce("called", F.lit(False)))
    second = top.where(enough).select("new_id", "old_id", (F.col("w") + 0.1 * F.col("k")).alias("score"))

    modern = old.select(F.col("cluster_id").alias("old_id"), "category", name_text(F.col("modern_name")).alias("alias")).where("alias <> ''")
    hits = my_aliases.join(modern, ["alias", "category"]).groupBy("new_id", "old_id").agg(F.count("*").alias("k"))
    third = best(hits, F.desc("k")).select("new_id", "old_id", (50.0 + F.col("k")).alias("score"))
    hits = my_aliases.join(old_aliases, ["alias", "category"]).groupBy("new_id", "old_id").agg(F.count("*").alias("k"))
    fourth = best(hits, F.desc("k")).where("k >= 2").select("new_id", "old_id", (10.0 + F.col("k")).alias("score"))

    # fixed values: the strategies by priority
    strategies = ["wikidata", "member_overlap", "modern_name", "alias_match"]
    proposed = None
    for k, (strategy, found) in enumerate(zip(strategies, (first, second, third, fourth), strict=True)):
        part = found.select("new_id", "old_id", F.lit(k).alias("at"), F.lit(strategy).alias("strategy"), F.round("score", 6).alias("score"))
        proposed = part if proposed is None else proposed.unionByName(part)
    proposed = proposed.withColumn("__rn", F.row_number().over(Window.partitionBy("new_id").orderBy("at"))).where("__rn = 1").drop("__rn")
    proposed = proposed.join(old.where("has_truth").select(F.col("cluster_id").alias("old_id")), "old_id", "left_semi")
    proposed = proposed.join(new.select(F.col("cluster_id").alias("new_id"), F.col("total_mentions").alias("__m")), "new_id")
    w = Window.partitionBy("old_id").orderBy("at", F.desc("score"), F.desc("__m"), "new_id")
    return proposed.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select("new_id", "old_id", "strategy", "score")


def person_patterns(persons: DataFrame) -> DataFrame:
    """person, count, pattern of persons that have a plain surname (person, name, aliases, variants, count).

    Searched forms are the name, the aliases, the surname from four letters on, and capitalised variants from four; forms
    of two letters are left out. Patterns match whole words in any case, the longest form first.
    """
    id = F.col("person")
    usable = persons.where((F.length(id) >= 3) & id.rlike(r"^\p{L}+$"))
    capital = F.filter(F.coalesce("variants", F.array().cast("array<string>")), lambda v: (F.length(v) > 3) & v.rlike(r"^\p{Lu}"))
    forms = F.array_union(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), F.array_union(F.when(F.length(id) >= 4, F.array(id, F.initcap(id))).otherwise(F.array().cast("array<string>")), capital))
    forms = F.filter(forms, lambda f: F.length(f) > 2)
    escaped = F.transform(F.reverse(F.array_sort(F.transform(forms, lambda f: F.struct(F.length(f).alias("n"), f.alias("f"))))), lambda s: F.regexp_replace(s["f"], r"([.*+?^${}()|\[\]\\])", r"\\$1"))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])(?:"), F.array_join(escaped, "|"), F.lit(r")(?![\p{L}\p{N}_])"))
    return usable.where(F.size(forms) > 0).select("person", "count", pattern.alias("pattern"))


def co_citations(excerpts: DataFrame, patterns: DataFrame, top_n: int = 60, samples: int = 3) -> DataFrame:
    """Unordered pairs of persons of whom one is named in an excerpt of the other: source, target, weight, excerpts.

    excerpts: person, pos, text. patterns: person, count, pattern, of which the top_n most frequent persons count, which
    bounds what is broadcast. Weight is the number of such excerpts; of these the first few stay as samples, in the order
    of the persons' rank and of pos.
    """
    top = patterns.orderBy(F.desc("count"), "person").limit(top_n)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "person")))  # top_n rows
    mine = excerpts.where("text is not null").join(F.broadcast(top.select("person", "rank")), "person")
    others = top.select(F.col("person").alias("other"), "pattern")
    hits = mine.join(F.broadcast(others), (F.col("person") != F.col("other")) & F.expr("text rlike pattern"))
    hits = hits.select(F.least("person", "other").alias("source"), F.greatest("person", "other").alias("target"), "rank", "pos", "text")
    weight = hits.groupBy("source", "target").agg(F.count("*").alias("weight"))
    first = hits.withColumn("k", F.row_number().over(Window.partitionBy("source", "target").orderBy("rank", "pos"))).where(F.col("k") <= samples)
    shown = first.groupBy("source", "target").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda s: s["text"]).alias("excerpts"))
    return weight.join(shown, ["source", "target"])
