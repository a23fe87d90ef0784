"""Hierarchical multi-length packing of token ids into training sequences without padding.

Documents are cut into full windows of the longest length; what is left of each is routed to the tier of the shortest
window that holds it. Tiers are packed from the longest down. The gap that a document leaves in its window is filled
from shorter tiers: the longest piece that fits, or the head of the shortest piece when none does. What stays open when
the shorter tiers are used up is laid end to end and cut into longest windows, and the last part of a group into
powers of two. So every sequence is full at a power of two and none needs padding.

Sequences are dealt to step groups of about step_tokens tokens, the longest first and each to the group that holds the
fewest tokens so far. So the steps of a packing group differ by less than one window, and in their lengths' mixture by
about one sequence of each length.

Packing runs inside each input partition, over packing groups of about group_tokens tokens: no shuffle, bounded memory,
and a lost task packs the same rows again in the same way. The last packing group takes up to twice as many tokens, so
that the number of its steps fits its size and they are as large as the others, within 1 / (2 * steps a packing group).
"""

from __future__ import annotations

from bisect import bisect_right, insort
from heapq import heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, read_table, slices
from .tokenise import encoder, tokenizer_path

TIERS = (4096, 2048, 1024, 512)
SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
    "window int, step_group long"
)
#: A piece: (document's number in the group, first id, ids).
Piece = tuple[int, int, int]


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Piece]]]:
    """Sequences (window, pieces) that hold each id of documents of these lengths once and are all full."""
    longest, done = tiers[0], []
    routed: dict[int, list[tuple[int, int, int]]] = {w: [] for w in tiers}
    for doc, n in enumerate(lengths):
        full = n // longest * longest
        done += [(longest, [(doc, at, longest)]) for at in range(0, full, longest)]
        if n > full:
            tier = min((w for w in tiers if w >= n - full))
            routed[tier].append((n - full, doc, full))
    open_pieces: list[Piece] = []
    pool: list[tuple[int, int, int]] = []  # of all tiers shorter than the one in hand, by length
    shorter = {w: sorted(x for v in tiers if v < w for x in routed[v]) for w in tiers}
    left: set[tuple[int, int, int]] | None = None
    for window in tiers:
        own = sorted(routed[window], reverse=True)
        if left is not None:  # longer tiers have taken some of these and cut others
            own = sorted((x for x in left if x[0] > window // 2 or window == tiers[-1]), reverse=True)
            pool = sorted(x for x in left if not (x[0] > window // 2 or window == tiers[-1]))
        else:
            pool = shorter[window]
        if window == tiers[-1]:
            pool, own = sorted(own), []
        while own or (window == tiers[-1] and pool):
            n, doc, at = own.pop(0) if own else pool.pop()
            pieces, gap = [(doc, at, n)], window - n
            while gap and pool:
                k = bisect_right(pool, (gap, 1 << 62, 0)) - 1
                n, doc, at = pool.pop(max(k, 0))
                used = min(n, gap)
                pieces.append((doc, at, used))
                gap -= used
                if used < n:
                    insort(pool, (n - used, doc, at + used))
            if gap:
                open_pieces += pieces
            else:
                done.append((window, pieces))
        left = set(pool)
    return done + _lay_out(open_pieces, longest)


def _lay_out(pieces: list[Piece], longest: int) -> list[tuple[int, list[Piece]]]:
    """Pieces end to end, cut into windows of the longest length and, at the end, into falling powers of two."""
    total, done, at = sum(n for _, _, n in pieces), [], 0
    sizes = [longest] * (total // longest) + [1 << b for b in range(longest.bit_length(), -1, -1) if total % longest >> b & 1]
    queue = list(reversed(pieces))
    for size in sizes:
        held, gap = [], size
        while gap:
            doc, at, n = queue.pop()
            used = min(n, gap)
            held.append((doc, at, used))
            gap -= used
            if used < n:
                queue.append((doc, at + used, n - used))
        done.append((size, held))
    return done


def deal(windows: list[int], step_tokens: int) -> list[int]:
    """The step of each sequence of these lengths, given the longest first; at least one step, each about step_tokens."""
    n = max(1, (2 * sum(windows) + step_tokens) // (2 * step_tokens))
    fill, out = [(0, k) for k in range(n)], []
    for window in windows:
        tokens, k = fill[0]
        heapreplace(fill, (tokens + window, k))
        out.append(k)
    return out


def packed(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = 1 << 18,
    group_tokens: int = 1 << 22,
    max_memo: int = 800_000,
) -> DataFrame:
    """One row per piece of a document in a sequence, see SCHEMA; ids are unsigned 32-bit little-endian integers.

    Null texts are empty documents: end_id alone. Null and repeated doc_ids, and repeated rows, are documents like
    others. max_memo bounds the words that a worker remembers, and with them its memory. Very long texts fill as many
    windows as they need. Ties of length go by place in the partition. Other columns are not read. An empty table gives
    no rows.
    """

    def sequences(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer, max_memo)
        width, base = enc.dtype.itemsize, TaskContext.get().partitionId() << 40
        end, made, steps = np.array([end_id], enc.dtype).tobytes(), 0, 0
        keys: list = []
        raws: list[bytes] = []
        total, first, first_tokens = 0, 0, 0  # held; documents of the packing group that goes next, and their tokens

        def batch_of(cols: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, ARROW.types, strict=True)], schema=ARROW)

        def flush(upto: int):
            nonlocal made, steps, total
            lengths = [len(r) // width for r in raws[:upto]]
            found = sorted(pack(lengths, tiers), key=lambda s: -s[0])
            step_of = deal([w for w, _ in found], step_tokens)
            cols: list[list] = [[] for _ in range(9)]
            for (window, pieces), step in zip(found, step_of, strict=True):
                offset = 0
                for doc, at, n in pieces:
                    ids = np.frombuffer(raws[doc], enc.dtype, n, at * width).astype("<u4").tobytes()
                    row = keys[doc], at, n, ids, lengths[doc], base + made, offset, window, base + steps + step
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                    offset += n
                made += 1
                if len(cols[0]) >= 200:
                    yield batch_of(cols)
                    cols = [[] for _ in range(9)]
            if cols[0]:
                yield batch_of(cols)
            steps += max(step_of) + 1
            total -= sum(lengths)
            del keys[:upto], raws[:upto]

        for batch in slices(batches, "text", 1 << 22):
            ids = enc.encode(batch.column(1).to_pylist())
            for key, raw in zip(batch.column(0).to_pylist(), ids, strict=True):
                keys.append(key)
                raws.append(raw + end)
                total += len(raws[-1]) // width
                first += first_tokens < group_tokens
                first_tokens += len(raws[-1]) // width if first_tokens < group_tokens else 0
                if total >= 2 * group_tokens and first < len(raws):
                    yield from flush(first)
                    first, first_tokens = 0, 0
                    for r in raws:
                        if first_tokens >= group_tokens:
                            break
                        first, first_tokens = first + 1, first_tokens + len(r) // width
        if raws:
            yield from flush(len(raws))

    bound_batches(docs.sparkSession, megabytes=2)  # words repeat more in longer batches
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(sequences, SCHEMA)


ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("window", pa.int32()),
        ("step_group", pa.int64()),
    ]
)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group"
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(packed(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))
