"""Substring dedup on sliding spans of sentences.

A sentence ends after a mark (STOPS) and before a line feed. Sentences are parted further, or two texts that differ in
one word of a long one would share nothing of it, and by their words alone, so alike in every copy: at each word whose
hash is the smallest, the last of equals, of some `window` words in a row of the sentence, so at least once every
`window` words. A character of a script without spaces is a word here, and counts half.

A span is the shortest run of at least MIN_SENTENCES sentences and min_words words from its first sentence on; one
begins at every sentence from which such a run exists. Spans with equal words are copies. Of all copies in the corpus
the one in the document with the smallest doc_id, at its smallest place, is first; the sentences of every other one are
removed.

Cuts that depend on `window` words are the same in two texts but for window - 1 words at the ends of what they share, so
a shared run of n words holds a whole span of both if n >= min_words + 4 * window - 3: of 50 words always, of fewer than
40 never, and at most 5 words of it are left at either end.

Most sentences are in no copy, so candidates come first. Of every MIN_WORDS words in a row, the run of GRAM words with the
smallest hash is marked, so texts that share MIN_WORDS words share a mark. Marks that occur more than once enter a sieve, a
bit array of bounded size, and spans are hashed only where they hold a mark that passes it. Every copy holds one, so nothing
is lost; a mark that passes by chance costs a few spans.

Everything is hashed over word hashes with prefix sums, so a document costs a pass over its bytes. Copies are found by a
partial aggregation on the hash and a join with the hashes that occur more than once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, bound_batches, fresh, mix64, passes, range_hash, read_table, remove, sieve_of_ids, slices, store

MIN_SENTENCES, MIN_WORDS = 2, 40
WINDOW, GRAM = 3, 15
#: Marks that end a sentence: . ! ? and the full stops, exclamation and question marks of other scripts.
STOPS = ".!?。！？｡।؟۔።။។"


def _ends_with_stop(raw: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each word that ends before a byte ends in one of STOPS."""
    found = np.isin(raw[end - 1], np.frombuffer(STOPS[:3].encode(), np.uint8))
    wide = np.flatnonzero(raw[end - 1] >= 0x80)
    if len(wide):
        at = end[wide]
        code = sum(raw[np.maximum(at - k, 0)].astype(np.int64) << 8 * (k - 1) for k in (1, 2, 3))
        for mark in STOPS[3:]:
            size = len(mark.encode())
            found[wide] |= (code & (1 << 8 * size) - 1 == int.from_bytes(mark.encode(), "big")) & (at >= size)
    return found


def smallest_of_windows(hashes: np.ndarray, since: np.ndarray, window: int) -> np.ndarray:
    """Whether each word is the smallest, the last of equals, of some window of words inside its sentence.

    since is a word's place in its sentence; sentences lie one after another.
    """
    n = len(hashes)
    reach, before, after = np.ones(n, np.int64), np.ones(n, bool), np.ones(n, bool)
    for d in range(1, min(window, n)):
        inside = since[d:] >= d  # word k and word k - d are in one sentence
        before[:d] = False
        before[d:] &= inside & (hashes[:-d] >= hashes[d:])
        after[n - d :] = False
        after[:-d] &= inside & (hashes[d:] > hashes[:-d])
        reach += before
        reach += after
    return reach >= window


class Sentences:
    """The sentences of texts given as words: their first words and rows; and the spans that begin at them.

    again: whether the span's words stand earlier in the same row.
    """

    def __init__(self, w: Words, window: int, min_sentences: int, min_words: int):
        self.words = w
        raw, start, end, n = w.raw, w.start, w.end, len(w.start)
        opens = np.zeros(n + 1, bool)
        opens[w.offs] = True
        if n:
            opens[1:n] |= _ends_with_stop(raw, end)[:-1]
            feeds = np.concatenate([[0], np.cumsum(raw == 10)])
            opens[1:n] |= feeds[start[1:]] > feeds[end[:-1]]
            natural = np.flatnonzero(opens[:n])
            since = np.arange(n) - np.repeat(natural, np.diff(np.append(natural, n)))
            opens[:n] |= smallest_of_windows(w.hashes, since, window)
        self.first = np.flatnonzero(opens[:n])  # first word of each sentence
        self.past = np.append(self.first[1:], n)
        self.offs = np.searchsorted(self.first, w.offs)  # rows' first sentences
        m = len(self.first)
        row = np.repeat(np.arange(len(w.offs) - 1), np.diff(self.offs))
        limit = self.offs[1:][row]
        # the sentence after the span that begins at each sentence
        upto = np.concatenate([[0], np.cumsum(2 - w.solo)])  # in half words
        enough = np.searchsorted(upto[self.past], upto[self.first] + 2 * min_words, side="left") + 1
        stop = np.maximum(enough, np.arange(m) + min_sentences)
        self.at = np.flatnonzero(stop <= limit)
        self.stop = stop[self.at]
        self.row = row[self.at]
        begin, finish = self.first[self.at], self.past[self.stop - 1] if m else self.at
        a = range_hash(w.hashes, begin, finish, 0x9E3779B97F4A7C15)
        b = range_hash(w.hashes, begin, finish, 0xD6E8FEB86659FD93)
        self.hashes = mix64(a + (b << np.uint64(1))).view(np.int64)
        order = np.lexsort((self.at, self.hashes, self.row))
        h, r = self.hashes[order], self.row[order]
        self.again = np.zeros(len(order), bool)
        self.again[order[1:]] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])


def marks(w: Words, span: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the runs of GRAM words that are the smallest, the last of equals, of all in some `span`
    words in a row of a text."""
    n, width = len(w.hashes), span - GRAM + 1
    last = np.repeat(w.offs[1:], np.diff(w.offs))
    whole = np.flatnonzero(np.arange(n) + span <= last)
    if not len(whole):
        return whole, np.zeros(0, np.int64)
    at = np.arange(n)
    h = range_hash(w.hashes, at, np.minimum(at + GRAM, n), 0x9E3779B97F4A7C15)
    best, size = at, 1
    while size < width:  # the smallest of twice as many, or of as many more as there are to be
        step = min(size, width - size)
        one, other = best[:-step], best[step:]
        best, size = np.where(h[other] <= h[one], other, one), size + step
    found = np.unique(best[whole])
    return found, h[found].view(np.int64)


def repeated_marks(docs: DataFrame, span: int) -> np.ndarray:
    """A sieve of the marks that documents (id, key, text) share, or that one of them has twice."""

    def made(batches):
        for batch in slices(batches, "text", 1 << 19):
            w = Words(batch.column(2), apart=True)
            at, h = marks(w, span)
            row = np.searchsorted(w.offs, at, side="right") - 1
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
            first = np.flatnonzero(np.append(True, ~same)[: len(h)])
            twice = np.append(same, False)[: len(h)][first]
            ids = [batch.column(k).take(pa.array(row[first])) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(h[first]), *ids, pa.array(twice)], names=["hash", "id", "key", "twice"])

    # a document is told by its id and its text's key together, in one number
    found = docs.mapInArrow(made, "hash long, id long, key long, twice boolean").select("hash", F.xxhash64("id", "key").alias("doc"), "twice")
    met = found.groupBy("hash").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.max(F.col("twice").cast("int")).alias("t"))
    found, path = store(met.where("a <> b or t = 1").select("hash"), "repeated-marks")
    sieve = sieve_of_ids(found)
    remove(docs.sparkSession, path)
    return sieve


def repeated(spans: DataFrame, place: list[str]) -> DataFrame:
    """(hash, first) of hashes that occur at several places; plain longs, where a place is one, aggregate by hash table."""
    where = F.col(place[0]) if len(place) == 1 else F.struct(*place)
    return spans.groupBy("hash").agg(F.min(where).alias("first"), F.max(where).alias("last")).where("first <> last").select("hash", "first")


def repeated_spans(docs: DataFrame, place: list[str], min_sentences: int, min_words: int) -> DataFrame:
    """Of (id, key, text): the spans to remove, as (id, key, gone array<struct<at, n>>), one row a document that has any.
    Where no id is repeated, key is left out."""
    sieve = docs.sparkSession.sparkContext.broadcast(repeated_marks(docs, min_words))

    def spans(batches):
        for batch in slices(batches, "text", 1 << 19):
            w = Words(batch.column(2), apart=True)
            at, h = marks(w, min_words)
            at = at[passes(sieve.value, h)]
            if not len(at):
                continue
            wanted = np.unique(np.searchsorted(w.offs, at, side="right") - 1)  # texts with a mark that passes
            if len(wanted) < batch.num_rows:
                batch = batch.take(pa.array(wanted))
                w = Words(batch.column(2), apart=True)
                at, h = marks(w, min_words)
                at = at[passes(sieve.value, h)]
            s = Sentences(w, WINDOW, min_sentences, min_words)
            # the first mark at or after a span's first word lies within it
            next_mark = np.append(at, len(w.hashes) + GRAM)[np.searchsorted(at, s.first[s.at])]
            holds = next_mark + GRAM <= (s.past[s.stop - 1] if len(s.at) else s.at)
            mine = np.flatnonzero(holds)
            rows = pa.array(s.row[mine])
            begin, n = (s.at - s.offs[s.row])[mine], (s.stop - s.at)[mine]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.hashes[mine], mask=s.again[mine]), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(begin.astype(np.int32)), pa.array(n.astype(np.int32))],
                names=["hash", "id", "key", "at", "n"],
            )

    # a span that stands earlier in its own document has no hash and goes in any case
    found, _ = store(docs.mapInArrow(spans, "hash long, id long, key long, at int, n int").select("hash", *place, "at", "n"), "spans")
    # written first: a join with a table can split a hot hash, a join with an aggregate can't
    many, _ = store(repeated(found.where("hash is not null"), place).withColumnRenamed("first", "first_place"), "repeated-spans")
    where = F.col(place[0]) if len(place) == 1 else F.struct(*place)
    later = found.join(many, "hash").where(where != F.col("first_place")).select(*place, "at", "n")
    gone = later.unionByName(found.where("hash is null").select(*place, "at", "n"))
    # by document: at most one row a sentence, whatever the number of copies
    return gone.groupBy(*place).agg(F.collect_set(F.struct("at", "n")).alias("gone"))


def substring_dedup(
    docs: DataFrame,
    min_sentences: int = MIN_SENTENCES,
    min_words: int = MIN_WORDS,
    doc_id: str = "doc_id",
    text: str = "text",
    removed: str = "n_removed",
) -> DataFrame:
    """docs with non-first copies of spans removed from the text, and the number of sentences removed.

    Every row stays, with all its other columns; a text that is one copy from end to end becomes empty. Null texts stay
    null, with 0 removed; empty texts, and texts without a whole span, stay as they are. A null doc_id comes before
    all others. Rows with the same doc_id and the same text are one document, whose first copy stays in each; rows with
    the same doc_id and other texts follow one another in the order of a hash of the text. A column with the name of
    the count is replaced. An empty table gives an empty table. min_words is GRAM at least.
    """
    if min_words < GRAM:
        raise ValueError(f"min_words must be at least {GRAM}")
    spark = docs.sparkSession
    bound_batches(spark)
    kept = docs.drop(removed)
    no_id = F.lit(-(1 << 63))
    at_id, at_key = F.coalesce(F.col(doc_id).cast("long"), no_id), F.xxhash64(text)
    source = kept.select(at_id.alias("id"), at_key.alias("key"), F.col(text).alias("text"))
    several = source.groupBy("id").count().where("count > 1").limit(1).count() > 0
    place = ["id", "key"] if several else ["id"]
    gone = repeated_spans(source, place, min_sentences, min_words)
    marks_of, held = fresh(kept, "gone"), {c: fresh(kept, f"at_{c}") for c in place}
    gone = gone.select(*(F.col(c).alias(n) for c, n in held.items()), F.col("gone").alias(marks_of))
    here = at_id == F.col(held["id"])
    if several:
        here &= at_key == F.col(held["key"])
    joined = kept.join(gone, here, "left").select(*(F.col(f"`{c}`") for c in kept.columns), marks_of)

    def cut(batches):
        for batch in slices(batches, text, 1 << 19):
            where = batch.schema.get_field_index(text)
            column = batch.column(where)
            gone = batch.column(batch.schema.get_field_index(marks_of)).to_pylist()
            wanted = [i for i, g in enumerate(gone) if g]
            counts = np.zeros(batch.num_rows, np.int32)
            if wanted:
                out = column.to_pylist()
                s = Sentences(Words(column.take(pa.array(wanted)), apart=True), WINDOW, min_sentences, min_words)
                w = s.words
                for k, i in enumerate(wanted):
                    a, b = s.offs[k], s.offs[k + 1]
                    edge = np.zeros(b - a + 1, np.int64)
                    np.add.at(edge, [g["at"] for g in gone[i]], 1)
                    np.add.at(edge, [g["at"] + g["n"] for g in gone[i]], -1)
                    drop = np.cumsum(edge[:-1]) > 0
                    # a sentence reaches from its first word to the next sentence's
                    begins = np.append(w.start[s.first[a:b]], w.byte_offs[k + 1])
                    pieces = [w.raw[w.byte_offs[k] : begins[0]]] if not drop[0] else []
                    pieces += [w.raw[x:y] for x, y, d in zip(begins[:-1], begins[1:], drop, strict=True) if not d]
                    out[i] = b"".join(p.tobytes() for p in pieces).decode("utf-8", "replace")
                    counts[i] = drop.sum()
                column = pa.array(out, column.type)
            columns = [column if k == where else c for k, c in enumerate(batch.columns) if batch.schema.names[k] != marks_of]
            fields = [n for n in batch.schema.names if n != marks_of]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts)], names=[*fields, removed])

    declared = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
    return joined.mapInArrow(cut, ", ".join([*declared, f"`{removed}` int"]))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the repeated passages; n_chars counts what is left."""
    count = fresh(docs, "removed")
    done = substring_dedup(docs, removed=count).drop(count)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(docs.columns)
