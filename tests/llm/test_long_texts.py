"""A text of several MB, its copies and a hot group of short ones, through the operators that read whole texts."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from loomwright.llm import language, media, near_dedup, packing, quality, token_store, toxicity
from loomwright.llm.common import new_path
from loomwright.llm.tokenise import tokenizer_path

from .conftest import DOCS


@pytest.fixture(scope="module")
def long_rows():
    rng = random.Random(21)
    vocabulary = [f"word{k}" if k % 3 else f"Wört{k}," for k in range(30_000)]
    words = rng.choices(vocabulary, k=420_000)
    near = [*words[:1000], "changed", *words[1001:]]
    rows = [(1, " ".join(words)), (2, "short text"), (3, " ".join(words)), (4, " ".join(near)), (5, None)]
    rows += [(10 + i, "a small copy that a third of all rows hold") for i in range(40)]
    assert len(rows[0][1]) > 3_000_000
    return [(i, t, "en", f"s{i % 2}", None if t is None else len(t)) for i, t in rows]


@pytest.fixture(scope="module")
def long_docs(spark, long_rows):
    return spark.createDataFrame(long_rows, DOCS).repartition(4)


def ids_of(name, text, end):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_store_and_packing_hold_all_ids(spark, long_docs, long_rows):
    path = new_path(spark, "long-store")
    token_store.write_store(long_docs, path, tokenizer_path("byte_bpe_50k.json"))
    got = {r["doc_id"]: (r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in token_store.read_store(spark, path).collect()}
    start = 0
    for r in sorted(long_rows):
        ids = ids_of("byte_bpe_50k.json", r[1], 0)
        assert got[r[0]] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    pieces: dict = {}
    for p in packing.packed(long_docs, tokenizer_path("word_bpe_49k.json")).collect():
        pieces.setdefault(p["doc_id"], []).append((p["start"], bytes(p["ids"])))
    for r in long_rows:
        assert b"".join(b for _, b in sorted(pieces[r[0]])) == ids_of("word_bpe_49k.json", r[1], 2).tobytes()


def test_near_copies_of_a_long_text(long_docs):
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(long_docs, words=2).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 5)] == [1, 2, 1, 1, 5] and {got[10 + i] for i in range(40)} == {10}


def test_media_of_a_long_text(long_docs, long_rows):
    out = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    got = {r["id"]: r for r in media.read_media(*media.store_media(long_docs), media.describe, out).collect()}
    for r in long_rows:
        raw = (r[1] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (got[r[0]]["n_bytes"], got[r[0]]["payload_sha256"]) == (len(raw), hashlib.sha256(payload).hexdigest())
    assert got[1]["media_sha256"] == got[3]["media_sha256"] != got[4]["media_sha256"]


def test_learners_score_a_long_text(spark, long_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 50)], "doc_id long, quality int, toxic int")
    scores = [
        {r["doc_id"]: r["score"] for r in toxicity.toxicity(long_docs, labels).collect()},
        {r["doc_id"]: r["score"] for r in language.languages(long_docs).collect()},
        {r["doc_id"]: r["text_score"] for r in quality.quality(long_docs, labels).collect()},
    ]
    for s in scores:
        assert len(s) == 45 and s[1] == s[3] and all(0 <= x <= 1 for x in s.values())
