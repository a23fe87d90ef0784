"""Media chunks (op10) and Lempel-Ziv fingerprints (op6): exact round trips and brute force."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from loomwright.llm import fingerprint, media

from .conftest import DOCS

OUT = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload(text):
    raw = (text or "").encode()
    return raw, raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def test_gear_hash_rolls():
    data = np.random.default_rng(0).integers(0, 256, 500).astype(np.uint8)
    gears = media._gears().astype(object)
    whole = media.gear_hash(data)
    for i in (40, 123, 499):
        assert int(whole[i]) == sum(int(gears[data[i - k]]) << k for k in range(32)) % (1 << 32)


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    shared = bytes(rng.integers(97, 123, 40_000).astype(np.uint8)).decode()
    found = media.cuts(pa.array(["zz" + shared, "other start " * 90 + shared, "", None]), 512, 1 << 14)
    names = [{media.digest_of(c) for c in media.parts(p, e)} for p, e in found]
    assert len(names[0] & names[1]) >= 0.7 * len(names[0])
    for p, ends in found:
        assert ends[-1] == len(p) and all(b - a <= (1 << 14) + 63 for a, b in zip([0, *ends], ends, strict=False))


@pytest.mark.parametrize("bits", [1 << 16, 64])
def test_payloads_are_rebuilt(spark, docs, rows, bits):
    stored, chunks = media.store_media(docs, min_chunk=64, max_chunk=2048, max_sieve_bits=bits)
    got = media.read_media(stored, chunks, media.describe, OUT).collect()
    want = sorted((str(r[0]), len(payload(r[1])[0]), hashlib.sha256(payload(r[1])[1]).hexdigest(), zlib.crc32(payload(r[1])[1][-64:])) for r in rows)
    assert sorted((str(g["id"]), g["n_bytes"], g["payload_sha256"], g["tail_crc32"]) for g in got) == want
    forms: dict = {}
    for g in got:
        forms.setdefault(g["payload_sha256"], set()).add((g["media_sha256"], g["media_bytes"], g["feature"]))
    assert all(len(f) == 1 for f in forms.values())
    assert chunks.groupBy("digest").count().where("count > 1").count() == 0


def test_op10_query_and_odd_tables(spark, tables, clean, empty, all_null, clashing, rows):
    got = media.op10_media(spark, tables).collect()
    assert {(g["doc_id"], g["n_bytes"]) for g in got} == {(r[0], len(payload(r[1])[0])) for r in clean}
    assert media.read_media(*media.store_media(empty), media.describe, OUT).count() == 0
    assert {g["payload_bytes"] for g in media.read_media(*media.store_media(all_null), media.describe, OUT).collect()} == {64}
    assert media.read_media(*media.store_media(clashing), media.describe, OUT).count() == len(rows)


def test_chunks_depend_on_their_own_row(spark):
    with pytest.raises(ValueError, match="min_chunk"):
        media.store_media(spark.createDataFrame([(1, "a")], "doc_id long, text string"), min_chunk=16)
    shared = "".join(chr(97 + i * i % 26) for i in range(5000))
    alone, behind = media.cuts(pa.array([shared]), 32, 4096), media.cuts(pa.array(["x" * 31 + "y", shared]), 32, 4096)
    assert alone[0] == behind[1]


def test_damage_is_found(spark, docs):
    from pyspark.sql import functions as F

    stored, chunks = media.store_media(docs)
    bad = stored.withColumn("digests", F.concat(F.lit(b"\0"), F.expr("substring(digests, 2)")))
    with pytest.raises(Exception, match="damaged or missing"):
        media.read_media(bad, chunks, media.describe, OUT).collect()


def naive(text):
    """The phrases of an LZ78 parse."""
    seen, now, out = set(), "", []
    for c in text:
        now += c
        if now not in seen:
            seen.add(now)
            out.append(now)
            now = ""
    return out


@pytest.mark.parametrize("text", ["", "a", "aaaaaaaa", "abababab cdcd", "日本語日本語 x", "the cat the hat the bat"])
def test_parse_equals_naive(text):
    for cut in range(len(text) + 1):
        p = fingerprint.Parse(text[:cut])
        other = p.ends_with("zz" + text)
        ends = p.ends_with(text[cut:])
        assert [text[a:b] for a, b in zip([0, *ends], ends, strict=False)] == naive(text)
        mixed = text[:cut] + "zz" + text
        assert [mixed[a:b] for a, b in zip([0, *other], other, strict=False)] == naive(mixed)


def test_likeness_follows_shared_phrases():
    a = "the quick brown fox jumps over the lazy dog " * 30
    b, c = a[:-200] + "something else entirely " * 8, "".join(chr(33 + (i * i) % 90) for i in range(1300))
    f = fingerprint.fingerprint
    assert fingerprint.likeness(f(a), f(a)) == 1 and fingerprint.likeness(f(a), f(b)) > fingerprint.likeness(f(a), f(c))
    assert fingerprint.likeness(f(""), f("")) == 1 and fingerprint.likeness(f(""), f("abc")) == 0


def expected(rows):
    out = []
    for i, (key, text, *_) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        own, new, nxt = (fingerprint.fingerprint(t) for t in (text, edited, after))
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.written(own), fingerprint.written(new), fingerprint.likeness(own, new), fingerprint.likeness(own, nxt)))
    return out


def test_op6_query(spark, tables, clean):
    got = [tuple(r) for r in fingerprint.op6_lz_fingerprint(spark, tables).collect()]
    assert sorted(got) == sorted(expected(sorted(clean, reverse=True)))


def test_fingerprints_of_a_very_long_text(spark):
    """A text of several MB, its neighbours in the order, and many ranges."""
    import random

    rng = random.Random(1)
    words = [f"w{k}" for k in range(20_000)]
    rows = [(i, " ".join(rng.choices(words, k=400_000 if i == 7 else rng.randrange(60)))) for i in range(40)]
    assert len(rows[7][1]) > 2_000_000
    got = sorted(map(tuple, fingerprint.compared(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted(expected(sorted(rows, reverse=True)))


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100])
def test_places_among_cuts(spark, n):
    from pyspark.sql import functions as F

    cuts = sorted({(k * 37) % 1000 - 300 for k in range(n)})
    got = spark.range(-400, 800, 7).select("id", fingerprint.place_among(F.col("id"), cuts).alias("p")).collect()
    assert all(r["p"] == sum(c <= r["id"] for c in cuts) for r in got)


def test_fingerprints_of_odd_tables(spark, docs, rows, empty, all_null, clashing):
    assert fingerprint.compared(empty).count() == 0
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, fingerprint.compared(clashing).collect()), key=key) == sorted(expected(order), key=key)
    assert {r["near_next"] for r in fingerprint.compared(all_null).collect()} == {1.0}
    alone = fingerprint.compared(spark.createDataFrame([(5, "abcdef", "en", "s", 6)], DOCS)).collect()
    assert [tuple(r)[:3] for r in alone] == [(5, 6, hashlib.sha256(b"abcdab").hexdigest())]
