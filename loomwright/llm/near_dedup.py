"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

A document's set holds its distinct word shingles. The first permutation scatters a shingle over a ring of RING places;
the second, one fixed permutation of the ring, is read from there at K successive places, so shifting it circularly
gives all K signature coordinates. Bands of ROWS coordinates are the candidate keys: at Jaccard 0.8 a pair misses all
of them with a probability of 5e-6.

Documents with equal sets form a class and enter once, by the smallest doc_id. Links are found in rounds:
  1. each class is verified against the smallest class that shares a band key with it;
  2. PIVOT_ROUNDS times, in every bucket that still holds several components, each class outside its component is
     verified against a member of the bucket drawn by hash;
  3. then all pairs between different components of a bucket are verified, each once, but for those that their sizes,
     sketches or differences from a common pivot rule out.
So every candidate pair is either in one component already or has been verified; a bucket of many copies of one text
costs few verifications a member. Verification compares full sets. Sets are built only for documents that a sieve of
bounded size passes, made of the ids in buckets; no text is shuffled.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX_A, Words, bound_batches, fresh, list_column, mix64, passes, read_table, remove, sieve_of_ids, slices, store
from .components import components, relabelled

BANDS, ROWS, RING = 40, 6, 1 << 20
PIVOT_ROUNDS = 2
SKETCH = 4
WORDS_OF_DIFFERENCE = 4
K = BANDS * ROWS


@functools.cache
def _ring() -> np.ndarray:
    """The second permutation, with its first K places repeated at the end; windows of it are K places long."""
    ring = np.random.default_rng(20240229).permutation(RING).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([ring, ring[:K]]), K)


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all rows, and each row's first (rows + 1).

    With fewer words than a shingle has, the whole sequence is one; without words the set is empty.
    """
    w = Words(column)
    n_words = np.diff(w.offs)
    size = np.where(n_words >= words, words, n_words)
    n = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    row = np.repeat(np.arange(len(n)), n)
    first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(w.offs[:-1], n)
    h = np.zeros(len(row), np.uint64)
    for k in range(words):
        inside = k < size[row]
        part = w.hashes[np.minimum(first + k, max(len(w.hashes) - 1, 0))] if len(w.hashes) else h
        h = np.where(inside, mix64(h * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(k + 1)), h)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return h, np.searchsorted(row, np.arange(len(n) + 1))


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The BANDS band keys of a set, and the lowest bits of its K coordinates in SKETCH words."""
    place = (shingles >> np.uint64(64 - RING.bit_length() + 1)).astype(np.int64)
    ring, low = _ring(), np.full(K, RING, np.uint32)
    for at in range(0, len(place), 2048):
        np.minimum(low, ring[place[at : at + 2048]].min(axis=0), out=low)
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mix64(key * MIX_A + low[r::ROWS].astype(np.uint64) + np.uint64(1))
    sketch = np.packbits((low & 1).astype(np.uint8).reshape(SKETCH, -1), axis=1, bitorder="little")
    wide = np.zeros((SKETCH, 8), np.uint8)
    wide[:, : sketch.shape[1]] = sketch
    return key.view(np.int64), wide.view(np.int64)[:, 0]


def _sets(docs: DataFrame, words: int, sieve: np.ndarray) -> DataFrame:
    """(id, set array<bigint>) of the documents (id, text) that a sieve passes."""
    sent = docs.sparkSession.sparkContext.broadcast(sieve)

    def make(batches):
        for batch in slices(batches, "text", 1 << 19):
            wanted = passes(sent.value, batch.column(0).fill_null(0).to_numpy()) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            if wanted.any():
                batch = batch.filter(pa.array(wanted))
                h, offs = shingle_sets(batch.column(1), words)
                yield pa.RecordBatch.from_arrays([batch.column(0), list_column(h.view(np.int64), offs, pa.int64())], names=["id", "set"])

    return docs.mapInArrow(make, "id long, set array<bigint>")


def _features(docs: DataFrame, words: int) -> DataFrame:
    """id, n_shingles, two halves of a key of the set, its sketch and band keys (none for an empty set)."""

    def make(batches):
        for batch in slices(batches, "text", 1 << 19):
            h, offs = shingle_sets(batch.column(1), words)
            n = np.diff(offs)
            made = [signature(h[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True) if b > a]
            sums = [
                np.concatenate([[0], np.cumsum(mix64(h + np.uint64(salt)))]).astype(np.uint64)
                for salt in (0x1234567, 0x89ABCDEF0)
            ]
            halves = [(s[offs[1:]] - s[offs[:-1]]).view(np.int64) for s in sums]
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))])
            flat = np.concatenate([b for b, _ in made]) if made else np.zeros(0, np.int64)
            sketch = np.concatenate([b for _, b in made]) if made else np.zeros(0, np.int64)
            columns = [batch.column(0), pa.array(n), pa.array(halves[0]), pa.array(halves[1])]
            columns += [list_column(sketch, ends // BANDS * SKETCH, pa.int64()), list_column(flat, ends, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_shingles", "k1", "k2", "sketch", "bands"])

    return docs.mapInArrow(make, "id long, n_shingles long, k1 long, k2 long, sketch array<bigint>, bands array<bigint>")


def _linked(a: Column, b: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def _bitmap(elements: Column) -> Column:
    """A hashed bitmap of an array of longs, as an array of WORDS_OF_DIFFERENCE longs."""
    word = lambda w: F.aggregate(
        F.filter(elements, lambda x: F.pmod(F.shiftright(x, 6), F.lit(WORDS_OF_DIFFERENCE)) == w),
        F.lit(0).cast("long"),
        lambda s, x: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))),
    )
    return F.array(*[word(w) for w in range(WORDS_OF_DIFFERENCE)])


def _common_bound(part: str) -> Column:
    """At most how many elements two difference sets share, by their bitmaps and sizes (columns of both sides)."""
    words = range(WORDS_OF_DIFFERENCE)
    shared = sum((F.bit_count(F.col(f"{part}_bits")[w].bitwiseAND(F.col(f"{part}_bits2")[w])) for w in words), F.lit(0))
    spare = [F.col(f"{part}_n{side}") - sum((F.bit_count(F.col(f"{part}_bits{side}")[w]) for w in words), F.lit(0)) for side in ("", "2")]
    return shared + F.least(*spare)


def _may_link(percent: int) -> Column:
    """False only for pairs that can't reach the similarity.

    By size; by sketches, if they differ in more bits than those of two sets at the threshold, whose expected number
    is exceeded by 5.6 deviations with a probability of about 1e-7; and, where both have been compared with the same pivot P of n shingles, by their differences from it: with m
    of P missing and a more than P, of which two sets share s_m and s_a, the similarity is
    i / (n - m + a + n - m' + a' - i) with i = n - m - m' + s_m + s_a shared shingles.
    """
    t, differ = F.lit(percent), (1 - percent / 100) / 2
    max_apart = int(K * differ + 5.6 * (K * differ * (1 - differ)) ** 0.5)
    size = 100 * F.least("n_set", "n_set2") >= t * F.greatest("n_set", "n_set2")
    apart = sum((F.bit_count(F.col("sketch")[w].bitwiseXOR(F.col("sketch2")[w])) for w in range(SKETCH)), F.lit(0))
    both = F.col("n_pivot") - F.col("miss_n") - F.col("miss_n2") + _common_bound("miss") + _common_bound("more")
    linked = 100 * both >= t * (F.col("n_set") + F.col("n_set2") - both)
    return size & (apart <= max_apart) & (F.col("pivot").isNull() | F.col("pivot2").isNull() | (F.col("pivot") != F.col("pivot2")) | linked)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Documents whose sets' Jaccard similarity is at least percent / 100 are linked; component_id is the smallest doc_id
    reachable, and kept marks the row that has it. Null and empty texts, and texts without words, have an empty set
    and link with nothing. Rows without a doc_id are never linked, have no component and are kept. Rows that share a
    doc_id are one document, with the smallest of their texts, and share its result. Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    repeated = rows.where("id is not null").groupBy("id").count().where("count > 1").limit(1).count() > 0
    source = rows
    if repeated:
        one = rows.where("id is not null").groupBy("id").agg(F.min("text").alias("text"))
        source = one.unionByName(rows.where("id is null"))
    table, _ = store(_features(source, words), "features")
    usable = table.where("id is not null and n_shingles > 0")
    # a class is entered by its smallest id; any of its rows has its band keys
    classes = usable.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.min_by(F.struct("bands", "sketch", "n_shingles"), "id").alias("r"))
    classes = classes.select("k1", "k2", "rep", "r.*")
    classes, classes_path = store(classes, "classes")
    keyed, keyed_path = store(classes.select("rep", F.posexplode("bands").alias("band", "key")), "bands")
    # what a hot key is joined with is a written table each time: such a join can be split, one with an aggregate can't
    heads = keyed.groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    heads, heads_path = store(heads, "heads")
    members, members_path = store(keyed.join(heads, "key"), "buckets")
    remove(spark, keyed_path, heads_path)

    first = members.where("rep > head").groupBy(F.col("rep").alias("a")).agg(F.min("head").alias("b"))
    first, first_path = store(first, "pairs")
    sets, sets_path = store(_sets(source, words, sieve_of_ids(members.select(F.col("rep").alias("id")))), "sets", codec="none")

    def verified(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
        right = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
        return pairs.join(left, "a").join(right, "b").where(_linked(F.col("set_a"), F.col("set_b"), percent)).drop("set_a", "set_b")

    def described(rest: DataFrame) -> DataFrame:
        """Of each class in unsettled buckets: size, sketch, band keys, and its differences from its pivot."""
        reps = rest.select(F.col("rep").alias("a")).distinct()
        mine = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
        pivot = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
        compared = reps.join(first, "a").join(mine, "a").join(pivot, "b")
        compared = compared.select("a", "b", F.size("set_b").alias("n_pivot"), F.array_except("set_b", "set_a").alias("miss"), F.array_except("set_a", "set_b").alias("more"))
        compared = compared.select(
            "a", F.col("b").alias("pivot"), "n_pivot",
            F.size("miss").alias("miss_n"), F.size("more").alias("more_n"),
            _bitmap(F.col("miss")).alias("miss_bits"), _bitmap(F.col("more")).alias("more_bits"),
        )
        kinds = classes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_set"), "sketch", F.col("bands").alias("marks"))
        return reps.join(kinds, "a").join(compared, "a", "left").withColumnRenamed("a", "rep")

    label = components(store(verified(first), "links")[0])
    paths = [members_path, first_path, sets_path]
    for turn in range(PIVOT_ROUNDS + 1):
        named = members.join(label, members.rep == label.node, "left").select("key", "band", "rep", F.coalesce("root", "rep").alias("root"))
        several = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        several, path = store(several, "several")
        paths.append(path)
        rest, path = store(named.join(several, "key"), "unsettled")
        paths.append(path)
        if not rest.limit(1).count():
            break
        if turn < PIVOT_ROUNDS:  # every unsettled bucket has a pivot of its own
            draw = F.xxhash64("rep", "key", F.lit(turn))
            pivots = rest.groupBy("key").agg(F.min_by(F.struct("rep", "root"), draw).alias("p"))
            pivots, path = store(pivots.select(F.col("key").alias("key2"), F.col("p.rep").alias("rep2"), F.col("p.root").alias("root2")), "pivots")
            paths.append(path)
            pairs = rest.join(pivots, (F.col("key") == F.col("key2")) & (F.col("root") != F.col("root2")))
        else:  # each pair in the first band that it shares, if nothing rules it out
            known, path = store(described(rest), "described")
            paths.append(path)
            full = rest.join(known, "rep")
            other = full.select(*(F.col(c).alias(f"{c}2") for c in full.columns))
            shared = F.array_position(F.zip_with("marks", "marks2", lambda x, y: x == y), True)
            here = (F.col("key") == F.col("key2")) & (F.col("root") < F.col("root2")) & _may_link(percent) & (shared == F.col("band") + 1)
            pairs = full.join(other, here)
        pairs = pairs.select(
            F.greatest("rep", "rep2").alias("a"),
            F.least("rep", "rep2").alias("b"),
            F.greatest("root", "root2").alias("root_a"),
            F.least("root", "root2").alias("root_b"),
        )
        found, path = store(verified(pairs.distinct()).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")), "links")
        paths.append(path)
        if found.limit(1).count():
            label = relabelled(label, components(found))
    remove(spark, *paths)

    comps = classes.join(label, classes.rep == label.node, "left").select("k1", "k2", F.coalesce("root", "rep").alias("component_id"))
    grouped = usable.drop("bands", "sketch").join(comps, ["k1", "k2"]).select("id", "n_shingles", "component_id")
    alone = table.where("id is null or n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = grouped.unionByName(alone).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.expr("id = component_id"), F.lit(True)).alias("kept")
    )
    if repeated:
        ids = rows.where("id is not null").select(F.col("id").alias("__id"))
        out = ids.join(out, F.col("__id") == F.col("doc_id")).drop("__id").unionByName(out.where("doc_id is null"))
    return out


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=2)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the row with the smallest doc_id, all columns as they were."""
    found = near_duplicates(docs)
    key = fresh(docs, "dropped")
    gone = found.where("not kept").select(F.col("doc_id").alias(key)).distinct()
    left = docs.join(gone, docs["doc_id"] == gone[key], "left_anti")
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if again.limit(1).count():  # rows that repeat a doc_id: one stays
        left = left.where("doc_id is null").unionByName(left.where("doc_id is not null").dropDuplicates(["doc_id"]))
    return left
