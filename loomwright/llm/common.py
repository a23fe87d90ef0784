"""Shared plumbing of the corpus operators: durable tables, and vectorised views of Arrow text columns.

Text leaves Spark in Arrow batches. The helpers here look at a batch as flat numpy arrays (UTF-8 bytes or code
points, with one offset per row), so that the operators work on whole batches and loop over rows only where a
row's own result needs it.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multipliers of the 64-bit mixers (fixed values of the splitmix64 finaliser).
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


# --- durable tables ---------------------------------------------------------------------------------------------


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session in one process may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root or os.path.join(tempfile.gettempdir(), "loomwright")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is deleted when the driver's JVM ends."""
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that store() wrote, once nothing reads them any more."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def store(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Writes df to the shared folder and reads it back: lineage ends at files that outlive any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def bound_batches(spark: SparkSession, rows: int = 2000, megabytes: int = 1, read_rows: int = 256) -> None:
    """Lowers three limits of the session where they are higher, for good: a row of text may be long, an executor holds
    several batches per task on both sides of the pipe to Python, and it keeps what it once allocated for them. They are
    the rows and bytes of an Arrow batch, and the rows that the Parquet reader decodes at once: with its 4096 rows of
    text at a time, arrays of many MB made the collector grow an executor's heap by half."""
    conf = spark.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.parquet.columnarReaderBatchSize", read_rows)):
        if int(conf.get(key)) > most:
            conf.set(key, str(most))
    now = conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower().rstrip("b")
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
    if int(now.rstrip("kmg")) * scale > megabytes << 20:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def id_crc(doc_id: Column) -> Column:
    """crc32 of an id written as decimal text; null stays null."""
    return F.crc32(doc_id.cast("string").cast("binary"))


# --- Arrow text as flat arrays -----------------------------------------------------------------------------------


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and its row offsets (length rows + 1, from 0). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:
        lens = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offs), 0)
        if (lens != np.diff(offs)).any():  # a null slot may own bytes
            flat = np.concatenate([flat[a : a + k] for a, k in zip(offs[:-1], lens, strict=True)] or [flat[:0]])
            offs = np.concatenate([[0], np.cumsum(lens)])
    return flat[offs[0] : offs[-1]], offs - offs[0]


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points (uint32) of a string column and its row offsets in code points. Nulls are empty."""
    flat, offs = string_bytes(column)
    starts = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
    points = np.frombuffer(flat.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    return points, starts[offs]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_B
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below at least n."""
    have = _POWERS.get((base, 0))
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[(base, 0)] = (out[0], out[1])
    return have


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A polynomial hash of values[start:end] for each range, equal for equal ranges wherever they stand."""
    up, down = _powers(base, len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=prefix[1:])
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def _solo(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the characters, in UTF-8, of scripts that are written without spaces between words: U+0E00 to
    0FFF, 1000 to 109F, 1780 to 17FF, 3000 to 9FFF, F900 to FAFF, FF00 to FFFF and 20000 to 3FFFF."""
    at = np.flatnonzero(flat >= 0xE0)
    lead, after = flat[at], flat[np.minimum(at + 1, max(len(flat) - 1, 0))]
    wide = (lead >= 0xE3) & (lead <= 0xE9) | (lead == 0xF0) & (after >= 0xA0) | (lead == 0xE0) & (after >= 0xB8)
    wide |= (lead == 0xE1) & ((after >= 0x80) & (after <= 0x82) | (after >= 0x9E) & (after <= 0x9F))
    wide |= (lead == 0xEF) & ((after >= 0xA4) & (after <= 0xAB) | (after >= 0xBC))
    at, lead = at[wide], lead[wide]
    return at, at + np.where(lead >= 0xF0, 4, 3)


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of a text column, A-Z lower-cased, as 64-bit hashes.

    hashes: one per word. start, end: byte ranges in flat. offs: rows' first words (rows + 1). With apart, a character of
    a script without spaces is a word by itself, and solo tells which words are.
    """

    def __init__(self, column: pa.Array, lower: bool = True, apart: bool = False):
        self.raw, self.byte_offs = string_bytes(column)
        flat = _LOWER[self.raw] if lower else self.raw
        gap = np.ones(len(flat) + 2, bool)
        gap[1:-1] = _SPACE[flat]
        first, last = gap[:-1].copy(), gap[1:].copy()
        first[self.byte_offs] = True  # a row's edge ends a word
        last[self.byte_offs] = True
        solo = np.zeros(len(flat) + 1, bool)
        if apart and len(flat):
            for edge in _solo(flat):
                first[edge] = True
                last[edge] = True
            solo[_solo(flat)[0]] = True
        body = ~gap[1:-1]
        self.start = np.flatnonzero(body & first[:-1])
        self.end = np.flatnonzero(body & last[1:]) + 1
        self.solo = solo[self.start]
        self.offs = np.searchsorted(self.start, self.byte_offs)
        a = range_hash(flat, self.start, self.end, 0x9E3779B97F4A7C15)
        b = range_hash(flat, self.start, self.end, 0xD6E8FEB86659FD93)
        self.hashes = mix64(a + (b << np.uint64(1)) + np.uint64(0x632BE59BD9B4E019))


MAX_SIEVE_BITS = 1 << 29


def spread(ids: np.ndarray, size: int) -> np.ndarray:
    """The two places of each id in a sieve of size bits."""
    one = mix64(ids.astype(np.int64).view(np.uint64))
    return (np.stack([one, mix64(one + MIX_A)]) & np.uint64(size - 1)).astype(np.int64)


def sieve_of_ids(ids: DataFrame) -> np.ndarray:
    """A bit array, in words of 64, that passes all of a column of longs, and few others.

    It has 16 to 32 bits for each of them, two of which are set, so it passes one other in a hundred; but it has
    MAX_SIEVE_BITS (64 MB) at most: beyond some 10^8 it passes a good part of others, which costs work and nothing else.
    """
    size = min(MAX_SIEVE_BITS, 1 << max(16, (16 * ids.count()).bit_length()))

    def positions(batches):
        for batch in batches:
            at = np.unique(spread(batch.column(0).to_numpy(), size).ravel())
            words, first = np.unique(at >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(bits.view(np.int64))], names=["word", "bits"])

    words = ids.mapInArrow(positions, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def passes(sieve: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = spread(ids, len(sieve) << 6)
    return (sieve[at >> 6] >> (at & 63) & 1).all(axis=0)


def slices(batches: Iterable[pa.RecordBatch], text: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds at most max_bytes of the text column, or one row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        _, offs = string_bytes(column)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offs, offs[at] + max_bytes, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def list_column(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def binary_column(parts: Iterable[bytes]) -> pa.Array:
    return pa.array(list(parts), pa.binary())
