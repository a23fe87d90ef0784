"""Tokenisation, the id store (op4) and packing (op8): exact round trips."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import packing, token_store
from loomwright.llm.common import new_path
from loomwright.llm.tokenise import Encoder, tokenizer_path

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_memo_encodes_like_the_library(name):
    rng = random.Random(2)
    odd = ["", " ", "  a", "a  b", "a \n b\n\n", "it's the'll  x ", "a\tb c d e", "x <|endoftext|> y", "trail  ", "İstanbul ΣΑΣ ß", "日本 語", "á b ́c", "12 3!! ?", " \n \n", "A. B, c; d: e!"]
    odd += ["".join(rng.choice(" \n ab'sÉ1!.,ñ\t́Z") for _ in range(rng.randrange(40))) for _ in range(1500)]
    parts = ["İ", "ı", "Σ", "ς", "\u0958", "\u0301", "\u0307", "\u1100\u1161", "\u212a", "ﬁ", "ß", "é", "日", "ไ", "א\u05b8", "Я", "\U0001f642", "'s", "'LL", "|", "½", "²", "٣", "7", "&&", "_", "the", "The", "ʰ", "\u200d", "\xad", "\ufeff", "\U00010400", "\u037e", "\x7f", *" \n.,!?;:"]
    odd += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(4000)]
    odd += [" ".join("".join(rng.choice(parts[:-8]) for _ in range(rng.randrange(1, 4))) + rng.choice(".,!?;: ").strip() for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    odd += ["x İ.", "İstanbul, İ! i̇?"]
    enc = Encoder(tokenizer_path(name), max_memo=300)
    want = [np.array(x.ids, "<u2").tobytes() for x in enc.tokenizer.encode_batch(odd, add_special_tokens=False)]
    assert [b for a in range(0, len(odd), 700) for b in enc.encode(odd[a : a + 700])] == want
    assert enc.encode([None, "a"]) == [b"", enc.encode(["a"])[0]]


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("width", [2, 4])
def test_planes_round_trip(bits, width):
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 1000):
        ids = rng.integers(0, 1 << (8 * width - 1), n, dtype=np.uint32).astype(f"<u{width}")
        planes = token_store.shuffle_planes(ids, width, bits)
        assert (token_store.unshuffle_planes(planes, n, width, bits) == ids).all()
        assert len(planes) == (8 * width if bits else width)


def expected(rows, name, end_id):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return [np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, end_id], "<u4") for r in rows]


@pytest.mark.parametrize("bits", [False, True])
def test_store_equals_brute_force(spark, docs, rows, bits):
    path = new_path(spark, "test-store")
    token_store.write_store(docs, path, tokenizer_path(BYTE), block_ids=64, page_ids=500, bits=bits)
    got = token_store.read_store(spark, path).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = expected(ordered, BYTE, 0)
    starts = np.cumsum([0] + [len(x) for x in ids])
    want = sorted((r[0] is not None, r[0] or 0, int(s), len(x), x.tobytes()) for r, s, x in zip(ordered, starts, ids, strict=False))
    assert sorted((g["doc_id"] is not None, g["doc_id"] or 0, g["start"], g["n_tokens"], bytes(g["ids"])) for g in got) == want


def test_op4_query(spark, tables, clean):
    got = {r["doc_id"]: r for r in token_store.op4_token_store(spark, tables).collect()}
    ordered = sorted(clean)
    start = 0
    for r, ids in zip(ordered, expected(ordered, BYTE, 0), strict=True):
        g = got[r[0]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_empty_store(spark, empty):
    path = new_path(spark, "empty-store")
    token_store.write_store(empty, path, tokenizer_path(BYTE))
    assert token_store.read_store(spark, path).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_pack_is_whole_and_full(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, rng.randint(1, 100), rng.randint(1, 5000), rng.randint(1, 30000), 4096, 512]) for _ in range(rng.randrange(60))]
    seen = [[] for _ in lengths]
    for window, pieces in packing.pack(lengths):
        assert sum(n for _, _, n in pieces) == window <= 4096 and window & (window - 1) == 0
        for d, a, n in pieces:
            assert n > 0
            seen[d].append((a, n))
    for d, n in enumerate(lengths):
        at = 0
        for a, k in sorted(seen[d]):
            assert a == at
            at += k
        assert at == n


def test_op8_query(spark, tables, clean):
    got = packing.op8_packing(spark, tables).collect()
    ids = dict(zip([r[0] for r in clean], expected(clean, WORD, 2), strict=True))
    pieces: dict = {}
    windows: dict = {}
    for g in got:
        part = ids[g["doc_id"]][g["start"] : g["start"] + g["length"]]
        assert len(part) == g["length"] and zlib.crc32(part.tobytes()) == g["ids_crc32"] and g["doc_tokens"] == len(ids[g["doc_id"]])
        pieces.setdefault(g["doc_id"], []).append((g["start"], g["length"]))
        windows.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for key, x in ids.items():
        assert sum(n for _, n in pieces[key]) == len(x)
    for parts in windows.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0


def test_packing_edge_tables(spark, empty, all_null, clashing):
    path = tokenizer_path(WORD)
    assert packing.packed(empty, path).count() == 0
    assert {r["doc_tokens"] for r in packing.packed(all_null, path).collect()} == {1}
    assert packing.packed(clashing, path).agg(F.sum("length")).first()[0] == packing.packed(clashing.select("doc_id", "text"), path).agg(F.sum("length")).first()[0]


@pytest.mark.parametrize("group_tokens", [1 << 14, 1 << 22])
def test_step_groups_are_balanced(spark, docs, group_tokens):
    """In a partition, steps hold the same number of tokens up to one window, or a partition's few tokens are one step."""
    target = 1 << 13
    packed = packing.packed(docs, tokenizer_path(WORD), step_tokens=target, group_tokens=group_tokens)
    rows = packed.groupBy(F.shiftright("step_group", 40).alias("part"), "step_group").agg(F.sum("length").alias("n")).collect()
    by_part: dict = {}
    for r in rows:
        by_part.setdefault(r["part"], []).append(r["n"])
    assert by_part and sum(map(sum, by_part.values())) == packed.agg(F.sum("length")).first()[0]
    for sizes in by_part.values():
        steps = sum(sizes) / len(sizes)
        assert len(sizes) == 1 or abs(steps - target) < target / 2
        if group_tokens > sum(sizes):
            assert max(sizes) - min(sizes) <= packing.TIERS[0]


@pytest.mark.parametrize("seed", range(5))
def test_deal_balances_tokens_and_lengths(seed):
    rng = random.Random(seed)
    windows = sorted([rng.choice([4096, 4096, 2048, 1024, 512]) for _ in range(rng.randrange(1, 900))] + [256, 64, 1], reverse=True)
    steps = packing.deal(windows, 1 << 18)
    size, mix = np.bincount(steps, windows), [np.bincount([s for s, w in zip(steps, windows, strict=True) if w == k], minlength=max(steps) + 1) for k in (4096, 512)]
    assert len(size) == max(1, round(sum(windows) / (1 << 18))) and size.max() - size.min() <= 4096
    assert np.ptp(mix[0]) <= 1


def test_packing_groups_of_a_partition_end_alike(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["river", "stone", "harbour"]) for _ in range(rng.randrange(1, 900)))) for i in range(600)]
    packed = packing.packed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), tokenizer_path(WORD), step_tokens=1 << 13, group_tokens=1 << 16)
    sizes = [r["n"] for r in packed.groupBy("step_group").agg(F.sum("length").alias("n")).collect()]
    assert len(sizes) > 16 and max(abs(n - (1 << 13)) for n in sizes) <= 4096 + (1 << 13) // 16
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.first("window").alias("w")).where("n <> w").count()
    assert full == 0 and packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("d")).where("n <> d").count() == 0
