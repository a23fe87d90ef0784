"""Media payloads in a content-addressed chunk store.

Payloads are cut where a rolling gear hash of the last 32 bytes has CUT_BITS zero bits (chunks of min_chunk to max_chunk
bytes), so equal passages give equal chunks wherever they stand. A chunk is named by its digest.

store_media()
  1. counts chunk digests over all payloads, digests only;
  2. builds a sieve of the repeated ones: a bit array of at most max_sieve_bits, sized by their number. It may pass a
     digest that isn't repeated, which costs a detour and nothing else, and never misses one that is;
  3. writes a row per payload: its ordered chunk list and, compressed together, its chunks that the sieve rejects.
     Chunks that pass go to the shared store, one row per digest.
read_media() rebuilds every distinct payload: those without shared chunks in place, the others by a Spark join of their
chunk lists with the shared store. Each chunk is checked against its digest. Only shared chunks, and the rows that use
them, are ever shuffled; all tables lie in the shared folder.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bound_batches, new_path, read_table, slices, store, string_bytes

CUT_BITS = 11
DIGEST = 16
LEVEL = 6


@functools.cache
def _gears() -> np.ndarray:
    """A 32-bit constant for each byte, from its digest."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


def gear_hash(flat: np.ndarray) -> np.ndarray:
    """For each byte, the sum of gear[byte k places back] << k over the 32 bytes that end there."""
    h = _gears()[flat]
    for span in (1, 2, 4, 8, 16):
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
    return h


def cuts(column: pa.Array, min_chunk: int, max_chunk: int) -> list[tuple[bytes, list[int]]]:
    """Each row's bytes and its chunks' ends, of which the last counts the zero padding too."""
    flat, offs = string_bytes(column)
    # the top bits have seen all 32 bytes
    marks = np.flatnonzero(gear_hash(flat) >> np.uint32(32 - CUT_BITS) == 0) + 1 if len(flat) else np.zeros(0, np.int64)
    raw, out = flat.tobytes(), []
    first = np.searchsorted(marks, offs[:-1], side="right")
    last = np.searchsorted(marks, offs[1:], side="right")
    for a, b, i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), first.tolist(), last.tolist(), strict=True):
        ends, at = [], 0
        for m in (marks[i:j] - a).tolist():
            while m - at > max_chunk:
                at += max_chunk
                ends.append(at)
            if m - at >= min_chunk:
                at = m
                ends.append(at)
        while b - a - at > max_chunk:
            at += max_chunk
            ends.append(at)
        size = max(64, -(-(b - a) // 64) * 64)
        if at < size:
            ends.append(size)
        out.append((raw[a:b] + bytes(size - (b - a)), ends))
    return out


def digest_of(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:DIGEST]


def parts(payload: bytes, ends: list[int]) -> list[bytes]:
    return [payload[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _bits(digests: list[bytes], size: int) -> np.ndarray:
    """Two bit positions of each digest."""
    words = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return (words & np.uint64(size - 1)).astype(np.int64)


def sieve_of(digests: DataFrame, max_sieve_bits: int) -> np.ndarray:
    """A bit array, in words of 64, that passes every digest of a table; never larger than max_sieve_bits."""
    n = digests.count()
    size = min(max_sieve_bits, 1 << max(16, (24 * n).bit_length()))

    def positions(batches):
        for batch in batches:
            at = np.unique(_bits(batch.column(0).to_pylist(), size)) if batch.num_rows else np.zeros(0, np.int64)
            words, first = np.unique(at >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(bits.view(np.int64))], names=["word", "bits"])

    found = digests.mapInArrow(positions, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


MEDIA = "id long, n_bytes long, media binary, lengths array<int>, digests binary, shared array<int>, data binary"


def store_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chunk: int = 512, max_chunk: int = 1 << 14, max_sieve_bits: int = 1 << 29) -> tuple[DataFrame, DataFrame]:
    """(media, chunks): the payload rows, see MEDIA, and the shared chunks (digest, data), both read from files.

    A payload is a text's UTF-8 (null: none) and zeros up to a positive multiple of 64 bytes. Null and repeated doc_ids
    and repeated rows keep a row each. Other columns are not read. An empty table gives empty stores. min_chunk is 32 at
    least: a cut depends on the 32 bytes before it, which must be the row's own.
    """
    if not 32 <= min_chunk <= max_chunk:
        raise ValueError("min_chunk must be from 32 to max_chunk")
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))

    def digests(batches):
        for batch in slices(batches, "text", 1 << 21):
            seen = [digest_of(c) for p, ends in cuts(batch.column(1), min_chunk, max_chunk) for c in parts(p, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.binary())], names=["digest"])

    counted = source.mapInArrow(digests, "digest binary").groupBy("digest").count()
    repeated, _ = store(counted.where("count > 1").select("digest"), "repeated-chunks")
    sieve = docs.sparkSession.sparkContext.broadcast(sieve_of(repeated, max_sieve_bits))

    def rows(batches):
        import zstandard

        press, sent = zstandard.ZstdCompressor(level=LEVEL), set()
        for batch in slices(batches, "text", 1 << 21):
            out: list[list] = [[] for _ in range(8)]
            for key, size, (payload, ends) in zip(
                batch.column(0).to_pylist(), np.diff(string_bytes(batch.column(1))[1]).tolist(), cuts(batch.column(1), min_chunk, max_chunk), strict=True
            ):
                chunks = parts(payload, ends)
                names = [digest_of(c) for c in chunks]
                at = _bits(names, len(sieve.value) << 6)
                known = (sieve.value[at >> 6] >> (at & 63) & 1).all(axis=1)
                shared = np.flatnonzero(known).tolist()
                private = [press.compress(b"".join(c for c, k in zip(chunks, known, strict=True) if not k))] if len(shared) < len(chunks) else [b""]
                lengths = [len(c) for c in chunks]
                row = False, key, size, hashlib.sha256(payload).digest(), lengths, b"".join(names), shared, private[0]
                for c, v in zip(out, row, strict=True):
                    c.append(v)
                for k in shared:
                    if names[k] not in sent:
                        if len(sent) > 1_000_000:  # bounds this task's memory; the table is deduplicated below
                            sent.clear()
                        sent.add(names[k])
                        row = True, None, None, names[k], None, None, None, press.compress(chunks[k])
                        for c, v in zip(out, row, strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, ARROW.types, strict=True)], schema=ARROW
            )

    spark, path = docs.sparkSession, new_path(docs.sparkSession, "media")
    source.mapInArrow(rows, f"chunk boolean, {MEDIA}").write.partitionBy("chunk").option("compression", "none").parquet(path)
    table = spark.read.schema(f"{MEDIA}, chunk boolean").parquet(path)
    unique = table.where("chunk").groupBy(F.col("media").alias("digest")).agg(F.first("data").alias("data"))
    chunks, _ = store(unique, "chunks", codec="none")
    return table.where("not chunk").drop("chunk"), chunks


ARROW = pa.schema(
    [
        ("chunk", pa.bool_()),
        ("id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("media", pa.binary()),
        ("lengths", pa.list_(pa.int32())),
        ("digests", pa.binary()),
        ("shared", pa.list_(pa.int32())),
        ("data", pa.binary()),
    ]
)


def _rebuild(use: Callable[[bytes, bytes], list], schema: T.StructType) -> Callable:
    """Batches of payload rows to schema: the columns up to the first that `use` returns are carried over."""
    arrow = to_arrow_schema(schema)

    def rebuilt(batches):
        import zstandard

        press = zstandard.ZstdDecompressor()
        for batch in batches:
            cols = {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            carry = [n for n in arrow.names if n in cols]
            out: list[list] = []
            for i in range(batch.num_rows):
                lengths, names, own = cols["lengths"][i], cols["digests"][i], cols["data"][i]
                fetched = {r["seq"]: r["data"] for r in cols["fetched"][i]} if "fetched" in cols else {}
                inner, at, whole, form = press.decompress(own) if own else b"", 0, [], [own]
                for k, n in enumerate(lengths):
                    name = names[k * DIGEST : (k + 1) * DIGEST]
                    if k in fetched:
                        form.append(fetched[k])
                        piece = press.decompress(fetched[k])
                    else:
                        piece, at = inner[at : at + n], at + n
                    if digest_of(piece) != name:
                        raise ValueError(f"chunk {k} ({name.hex()}) is damaged or missing")
                    whole.append(piece)
                head = b"".join(n.to_bytes(4, "little") + names[k * DIGEST : (k + 1) * DIGEST] for k, n in enumerate(lengths))
                out.append([cols[c][i] for c in carry] + use(b"".join(whole), head + b"".join(form)))
            columns = [pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), arrow, strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rebuilt


def read_media(media: DataFrame, chunks: DataFrame, use: Callable[[bytes, bytes], list], schema: str) -> DataFrame:
    """id, n_bytes and use(payload, stored form) of each payload row, read back; every chunk is verified.

    A payload's stored form is its chunk list (for each chunk a 32-bit little-endian length and its digest) followed by
    the compressed chunks as stored: its own as one, then the shared ones in order.
    """
    made = T.StructType.fromDDL(schema).fields
    whole = lambda df, *keys: df.mapInArrow(
        _rebuild(use, s := T.StructType([df.schema[k] for k in keys] + made)), s
    )
    alone = media.where(F.size("shared") == 0).select("id", "n_bytes", "lengths", "digests", "data")
    users = media.where(F.size("shared") > 0)
    # a payload that several rows hold is rebuilt once
    distinct = users.groupBy("media").agg(F.first(F.struct("lengths", "digests", "shared", "data")).alias("m")).select("media", "m.*")
    wanted = distinct.select("media", "digests", F.explode("shared").alias("seq"))
    wanted = wanted.select("media", "seq", F.expr(f"substring(digests, seq * {DIGEST} + 1, {DIGEST})").alias("digest"))
    fetched = wanted.join(chunks, "digest").groupBy("media").agg(F.collect_list(F.struct("seq", "data")).alias("fetched"))
    joined = whole(distinct.drop("shared").join(fetched, "media"), "media")
    return whole(alone, "id", "n_bytes").unionByName(users.select("id", "n_bytes", "media").join(joined, "media").drop("media"))


def byte_features(payload: bytes) -> str:
    """Mean, deviation and entropy of the 8-bit samples, and the rate at which they cross their middle."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    crossing = np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)) / len(x)
    return f"{x.mean():.4f}:{x.std():.4f}:{entropy:.4f}:{crossing:.6f}"


def describe(payload: bytes, form: bytes) -> list:
    return [
        len(payload),
        hashlib.sha256(payload).hexdigest(),
        zlib.crc32(payload[-64:]),
        len(form),
        hashlib.sha256(form).hexdigest(),
        byte_features(payload),
    ]


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media, chunks = store_media(read_table(spark, sf_dir, "documents"))
    found = read_media(
        media,
        chunks,
        describe,
        "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
    return found.withColumnRenamed("id", "doc_id")
