"""Lempel-Ziv phrase fingerprints: documents whose parses share phrases are alike as a compressor sees them.

A text is parsed into dictionary phrases (LZ78: each phrase is the shortest one not met before). The set of its phrases
is hashed, and a signature of COORDINATES minimum hashes, 16 bits of each, is the fingerprint. The share of equal
coordinates estimates the Jaccard similarity of two phrase sets.

op6 compares each document with an edited copy of itself and with its successor in descending order of doc_id. The
order is had without a global sort: ids are cut into ranges at approximate quantiles, one for each task, every range
gets a copy of the first document of the range that follows it, and is then sorted and streamed in its task. Texts are
shuffled once.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, mix64, range_hash, read_table

COORDINATES = 128
_FACTORS = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


class Parse:
    """An LZ78 parse of a text up to a cut, which can go on in two ways."""

    def __init__(self, head: str):
        self.root: dict = {}
        self.ends: list[int] = []
        self.size = len(head)
        self.node = self._go(head, self.root, 0, self.ends, None)

    def _go(self, text: str, node: dict, at: int, ends: list[int], log: list | None) -> dict:
        root, put = self.root, ends.append
        for c in text:
            at += 1
            deeper = node.get(c)
            if deeper is None:
                node[c] = {}
                if log is not None:
                    log.append((node, c))
                put(at)
                node = root
            else:
                node = deeper
        return node

    def ends_with(self, tail: str, last: bool = False) -> list[int]:
        """Ends of the phrases of head + tail; the state stays that of the head, but after the last call."""
        ends, log = self.ends.copy(), None if last else []
        self._go(tail, self.node, self.size, ends, log)
        for node, c in reversed(log or ()):
            del node[c]
        return ends


def signature(text: str, ends: list[int]) -> np.ndarray:
    """Minimum hashes of the phrases that end at these places; all ones without phrases."""
    if not ends:
        return np.full(COORDINATES, 0xFFFF, np.uint16)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    end = np.array(ends)
    h = range_hash(points, np.concatenate([[0], end[:-1]]), end, 0x9E3779B97F4A7C15)
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1024):
        np.minimum(low, (h[at : at + 1024, None] * _FACTORS).min(axis=0), out=low)
    # the lowest values differ in their low bits; 0xFFFF is left to texts without phrases
    return ((mix64(low) & np.uint64(0xFFFF)) % np.uint64(0xFFFF)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / COORDINATES


def written(sig: np.ndarray) -> str:
    return base64.b64encode(sig.astype("<u2").tobytes()).decode("ascii")


def fingerprint(text: str) -> np.ndarray:
    return signature(text, Parse(text).ends)


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def place_among(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most value, found in two steps of about the root of their number each."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts) - 1) + 1
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    upto = lambda listed: F.size(F.filter(listed, lambda c: c <= value))
    block = upto(F.array(*(F.lit(b[0]) for b in blocks)))
    inside = upto(F.element_at(F.array(*(F.array(*map(F.lit, b)) for b in blocks)), block))
    return F.when(value < cuts[0], 0).otherwise((block - 1) * step + inside)


def in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """(id, text, at, range, extra): every document of (id, text) in its range and, as an extra, the first one of the
    range that follows in the order; after the last range comes the first. The order is that of falling ids, then, for
    documents without one, that of falling hashes of their texts; at is the number it goes by. Ranges count upwards."""
    spark = docs.sparkSession
    n, with_id = docs.agg(F.count("*"), F.count("id")).first()
    bare = min(ranges - 1, -(-ranges * (n - with_id) // n)) if n > with_id else 0  # ranges of documents without an id
    points = [i / (ranges - bare) for i in range(1, ranges - bare)]
    cuts = docs.agg(F.percentile_approx("id", points, F.lit(max(10_000, 20 * ranges)))).first()[0] if points else []
    at, place = F.col("id"), place_among(F.col("id"), sorted(set(cuts or [])))
    if n > with_id:
        by_hash = F.floor((F.xxhash64("text") / F.lit(2.0**64) + 0.5) * max(bare, 1)).cast("int")
        at = F.coalesce(F.col("id"), F.xxhash64("text"))
        place = F.when(F.col("id").isNull(), F.least(by_hash, F.lit(max(bare, 1) - 1))).otherwise(place + max(bare, 1))
    placed = docs.withColumn("at", at).withColumn("range", place)
    tops = placed.groupBy("range").agg(F.max("at").alias("top")).orderBy("range").collect()  # a row a range
    next_up = [(r["range"], r["top"], tops[(i + 1) % len(tops)]["range"]) for i, r in enumerate(tops)]
    copies = spark.createDataFrame(next_up, "r int, top long, goes int")
    found = placed.join(F.broadcast(copies), (F.col("range") == F.col("r")) & (F.col("at") == F.col("top")), "left")
    own = F.struct(F.col("range"), F.lit(0).alias("extra"))
    places = F.when(F.col("goes").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("goes").alias("range"), F.lit(1).alias("extra"))))
    return found.select("id", "text", "at", F.explode(places).alias("place")).select("id", "text", "at", "place.range", "place.extra")


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """See SCHEMA; one row per row of docs.

    The edited text has the last third (rounded down) of its characters replaced by the first as many, or all, of the
    next document's, in descending order of doc_id; after the last document comes the first. Null texts are empty; an
    empty text's fingerprint is like that of empty texts only. Documents with equal ids follow one another in the order
    of their texts; those without an id come last, in the order of a hash of their texts. A single document follows
    itself. Other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a range a task, but for one more where ids are missing
    ordered = in_ranges(source, tasks).repartitionById(tasks, "range").sortWithinPartitions("range", "extra", F.desc("at"), "text")

    def compare(batches):
        held: list[list] = [[] for _ in ARROW]
        # the document that waits for its successor: range, id, text, parse of its kept part, signature, length
        waiting, done = None, None

        def close(successor_text: str, successor: np.ndarray) -> None:
            _, key, body, parse, own, cut = waiting
            tail = successor_text[: len(body) - cut]
            edited = body[:cut] + tail
            new = signature(edited, parse.ends_with(tail, last=True))
            row = [key, len(body), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), written(own), written(new), likeness(own, new), likeness(own, successor)]
            for c, v in zip(held, row, strict=True):
                c.append(v)

        def opened(place: int, key: int | None, body: str) -> tuple:
            cut = len(body) - len(body) // 3
            parse = Parse(body[:cut])
            return place, key, body, parse, signature(body, parse.ends_with(body[cut:])), cut

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, ARROW.types, strict=True)], schema=ARROW)
            for c in held:
                c.clear()
            return out

        for batch in batches:
            for key, body, place, extra in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if extra and place == done:
                    continue  # several documents share the first id of the next range; the first was taken
                new = opened(place, key, body)
                if waiting is not None:
                    close(body, new[4])
                waiting, done = (None, place) if extra else (new, done)
                if len(held[0]) >= 500:
                    yield flush()
        if held[0]:
            yield flush()

    return ordered.select("id", "text", "range", "extra").mapInArrow(compare, SCHEMA)


ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def op6_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(read_table(spark, sf_dir, "documents"))
