"""Token-id store with bit-plane shuffled blocks.

File format. A store is a Parquet table of pages, written and read through Spark so that it works on any store Spark
reaches. A page holds whole documents in order and is one row, which says by itself how to read it:

    version int        of this format, 2
    width int          bytes of an id
    block_ids int      ids in a block
    bits boolean       bit planes rather than byte planes
    end_id long        the id behind each document
    tokenizer string   SHA-256 of the tokenizer's file, lower-case hex
    shard int          the ordered range of documents that it belongs to; shards follow one another
    page int           its number within the shard
    shard_start long   ids in the shard before it
    n_docs, n_ids      what it holds
    doc_ids, lengths   array<long>: the documents and the ids of each, end id included (a null doc_id stays null)
    chunk_index        array<int>: for each block, for each plane, the plane's end within planes
    planes binary      the compressed planes

A page's ids are cut into blocks of block_ids ids (the last may be shorter). A block of n ids of w bytes is transposed
into w byte planes, or 8w bit planes, plane 0 from the lowest byte or bit; each plane is compressed with zstandard on
its own. A plane that is all zero is stored as no bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, new_path, read_table, slices
from .tokenise import encoder, tokenizer_path

VERSION = 2
PAGES = (
    "version int, width int, block_ids int, bits boolean, end_id long, tokenizer string, shard int, page int, shard_start long, n_docs int, n_ids long, doc_ids array<bigint>, lengths array<bigint>, "
    "chunk_index array<int>, planes binary"
)


def shuffle_planes(ids: np.ndarray, width: int, bits: bool) -> list[bytes]:
    """The planes of a block of ids of width bytes."""
    raw = ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
    if bits:
        raw = np.unpackbits(raw, axis=1, bitorder="little")
        return [np.packbits(p, bitorder="little").tobytes() if p.any() else b"" for p in raw.T]
    return [np.ascontiguousarray(p).tobytes() if p.any() else b"" for p in raw.T]


def unshuffle_planes(planes: list[bytes], n: int, width: int, bits: bool) -> np.ndarray:
    """The block of n ids that shuffle_planes() took apart."""
    if bits:
        flat = np.zeros((n, 8 * width), np.uint8)
        for k, p in enumerate(planes):
            if p:
                flat[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        raw = np.packbits(flat, axis=1, bitorder="little")
    else:
        raw = np.zeros((n, width), np.uint8)
        for k, p in enumerate(planes):
            if p:
                raw[:, k] = np.frombuffer(p, np.uint8)
    return raw.reshape(-1).view(f"<u{width}")


def write_store(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    block_ids: int = 1 << 16,
    page_ids: int = 1 << 18,
    bits: bool = False,
    level: int = 3,
) -> None:
    """Writes the ids of every whole text, end_id after each document, in ascending order of doc_id.

    Null texts are empty documents and hold end_id alone. A null doc_id comes first. Rows with the same doc_id stay
    separate documents, in the order of their texts. Other columns are not read. An empty table gives an empty store.
    One range shuffle of (doc_id, text) brings the order about; a task holds one batch of texts and one page.
    """
    cctx_level = level

    def pages(batches):
        import zstandard
        from pyspark import TaskContext

        enc, press = encoder(tokenizer), zstandard.ZstdCompressor(level=cctx_level)
        width, shard = enc.dtype.itemsize, TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype).tobytes()
        page, start = 0, 0
        held, ids_of, lens, n = [], [], [], 0

        def flush():
            nonlocal page, start, held, ids_of, lens, n
            ids, ends, planes, at = np.frombuffer(b"".join(held), enc.dtype), [], [], 0
            for b in range(0, n, block_ids):
                for plane in shuffle_planes(ids[b : b + block_ids], width, bits):
                    planes.append(press.compress(plane) if plane else b"")
                    at += len(planes[-1])
                    ends.append(at)
            head = [VERSION, width, block_ids, bits, end_id, enc.digest]
            row = [*head, shard, page, start, len(ids_of), n, ids_of, lens, ends, b"".join(planes)]
            out = pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, ARROW_PAGES.types, strict=True)], schema=ARROW_PAGES
            )
            page, start, held, ids_of, lens, n = page + 1, start + n, [], [], [], 0
            return out

        for batch in slices(batches, "text", 1 << 22):
            done = enc.encode(batch.column(1).to_pylist())
            for key, raw in zip(batch.column(0).to_pylist(), done, strict=True):
                held += [raw, end]
                ids_of.append(key)
                lens.append(len(raw) // width + 1)
                n += lens[-1]
                if n >= page_ids:
                    yield flush()
        if ids_of:
            yield flush()

    bound_batches(docs.sparkSession, megabytes=2)  # words repeat more in longer batches
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(pages, PAGES).write.option("compression", "none").parquet(path)


ARROW_PAGES = pa.schema(
    [
        ("version", pa.int32()),
        ("width", pa.int32()),
        ("block_ids", pa.int32()),
        ("bits", pa.bool_()),
        ("end_id", pa.int64()),
        ("tokenizer", pa.string()),
        ("shard", pa.int32()),
        ("page", pa.int32()),
        ("shard_start", pa.int64()),
        ("n_docs", pa.int32()),
        ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("chunk_index", pa.list_(pa.int32())),
        ("planes", pa.binary()),
    ]
)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Reads a store back: doc_id long, start long (ids of all documents before it), n_tokens long, ids binary.

    ids holds unsigned 32-bit little-endian integers. Every page is read as its header says; one of another version is an
    error. Only the shards' sizes, one row each, are put in order.
    """
    table = spark.read.schema(PAGES).parquet(path)
    sizes = table.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    listed = sizes.agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("s")).collect()[0]["s"]  # a row a shard
    starts, total = {}, 0
    for row in listed or []:
        starts[row["shard"]], total = total, total + row["n"]

    def documents(batches):
        import zstandard

        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for version, width, block_ids, bits, shard, at, n, keys, lens, index, planes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if version != VERSION:
                    raise ValueError(f"a page of format version {version}; this reads {VERSION}")
                raw, parts, last, planes_a_block = memoryview(planes), [], 0, 8 * width if bits else width
                for b in range(0, len(index), planes_a_block):
                    size, block = min(block_ids, n - b // planes_a_block * block_ids), []
                    plain = (size + 7) // 8 if bits else size
                    for end in index[b : b + planes_a_block]:
                        block.append(press.decompress(raw[last:end], max_output_size=plain) if end > last else b"")
                        last = end
                    parts.append(unshuffle_planes(block, size, width, bits))
                ids = np.concatenate(parts).astype("<u4").tobytes()
                ends = np.cumsum(lens)
                begins = ends - lens
                out = [
                    pa.array(keys, pa.int64()),
                    pa.array(begins + (at + starts[shard]), pa.int64()),
                    pa.array(lens, pa.int64()),
                    pa.array([ids[4 * a : 4 * e] for a, e in zip(begins.tolist(), ends.tolist(), strict=True)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids"])

    pages = table.select("version", "width", "block_ids", "bits", "shard", "shard_start", "n_ids", "doc_ids", "lengths", "chunk_index", "planes")
    return pages.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' ids, written to a store and read back from it."""
    path = new_path(spark, "token-store")
    write_store(read_table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
