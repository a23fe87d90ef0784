"""Near-duplicate groups (op7) and substring dedup (op1) against brute force."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest

from loomwright.llm import near_dedup, substring
from loomwright.llm.common import Words


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows, k, percent=80):
    sets = [shingles(r[1], k) for r in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                up[max(x, y, key=lambda n: rows[n][0])] = min(x, y, key=lambda n: rows[n][0])
    return {r[0]: (len(s), rows[find(i)][0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))}


def test_words_are_split_and_hashed_alike():
    texts = ["Hello  World\tfoo", "", None, " A B\n", "héé Ünd", "x", "foo hello"]
    w = Words(pa.array(texts))
    for i, t in enumerate(texts):
        span = range(w.offs[i], w.offs[i + 1])
        assert [w.raw[w.start[k] : w.end[k]].tobytes().decode().lower() for k in span] == [x.lower() for x in words_of(t)]
    assert w.hashes[0] == w.hashes[w.offs[6] + 1] and w.hashes[2] == w.hashes[w.offs[6]]


@pytest.mark.parametrize("k", [2, 5])
def test_groups_equal_brute_force(spark, clean, k):
    df = spark.createDataFrame(clean, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, words=k).collect()}
    assert got == components(sorted(clean), k)


def test_group_of_many_near_copies(spark):
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):  # copies at every distance, many of them just under the threshold to one another
        w = list(base)
        for e in range(i % 9):
            w[(i * 7 + e * 13) % 120] = f"e{i}x{e}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, words=2).collect()}
    assert got == components(rows, 2)


def test_heads_of_all_their_buckets_are_verified(spark):
    """g < h < m: m meets g and h in bands, g and h meet in none, and only h and m are near copies."""
    rng, rows, met = random.Random(5), [], 0
    for i in range(300):
        m = [f"w{i}x{k}" for k in range(100)]
        h = [*m[:94], *(f"h{i}x{k}" for k in range(6))]
        g = [*(f"g{i}x{k}" for k in range(38)), *m[38:]] if i % 2 else [*m[:4], *(f"g{i}x{k}" for k in range(30)), *m[34:]]
        texts = [" ".join(x) for x in (g, h, m)]
        keys = [set(near_dedup.signature(near_dedup.shingle_sets(pa.array([t]), 2)[0])[0].tolist()) for t in texts]
        met += bool(keys[0] & keys[2]) and bool(keys[1] & keys[2]) and not keys[0] & keys[1]
        rows += [(3 * i + k, t) for k, t in enumerate(texts)]
    assert met >= 50
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, words=2).collect()}
    assert got == components(sorted(rows), 2)


def test_near_duplicates_of_odd_tables(spark, docs, rows, empty, all_null, clashing):
    assert near_dedup.near_duplicates(empty).count() == 0
    assert [tuple(r) for r in near_dedup.near_duplicates(all_null).collect()] == [(None, 0, None, True)] * 3
    got = near_dedup.near_duplicates(clashing).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, near_dedup.near_duplicates(docs).collect()))


def test_stage_keeps_one_of_each_group(spark, clashing, clean):
    kept = near_dedup.stage(spark, clashing, "")
    assert kept.columns == clashing.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    want = {c for _, c in components(sorted(clean), 5).values()}
    assert {i for i in ids if i is not None} == want and len([i for i in ids if i is not None]) == len(want)


SPACELESS = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3000-\u9fff\uf900-\ufaff\uff00-\uffff\U00020000-\U0003ffff]")


def units(text, window=3):
    """Words, the first word of each sentence or part of one, and the words' weights in half words."""
    at = [m.span() for m in re.finditer(f"{SPACELESS.pattern}|(?:(?!{SPACELESS.pattern})[^\x20\x09-\x0d])+", text)]
    hashes = Words(pa.array([text]), apart=True).hashes.tolist()
    assert len(hashes) == len(at)
    natural = [k for k, (s, _) in enumerate(at) if k == 0 or text[at[k - 1][1] - 1] in substring.STOPS or "\n" in text[at[k - 1][1] : s]]
    first = set(natural)
    for a, b in zip(natural, [*natural, len(at)][1:], strict=False):
        for k in range(a, b - window + 1):
            low = min(hashes[k : k + window])
            first.add(max(i for i in range(k, k + window) if hashes[i] == low))
    return at, sorted(first), [1 if SPACELESS.fullmatch(text[s:e]) else 2 for s, e in at]


def brute(rows, least=2, words=40):
    seen, out = set(), {}
    for key, text, *_ in sorted(rows):
        if text is None:
            out[key] = (None, 0)
            continue
        at, first, weight = units(text)
        ends, gone = first[1:] + [len(at)], set()
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), text[s:e]) for s, e in at]
        for j in range(len(first)):
            k = j + 1
            while k < len(first) and (k - j < least or sum(weight[first[j] : ends[k - 1]]) < 2 * words):
                k += 1
            if k - j < least or sum(weight[first[j] : ends[k - 1]]) < 2 * words:
                continue
            span = tuple(low[first[j] : ends[k - 1]])
            if span in seen:
                gone.update(range(j, k))
            seen.add(span)
        begin = [at[k][0] for k in first] + [len(text)]
        lead = text[: begin[0]] if 0 not in gone else ""
        out[key] = (lead + "".join(text[begin[j] : begin[j + 1]] for j in range(len(first)) if j not in gone), len(gone))
    return out


def test_spans_equal_brute_force(spark, clean):
    df = spark.createDataFrame(clean, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in substring.substring_dedup(df).collect()}
    assert got == brute(clean)


def test_shared_passage_stays_once(spark, clean):
    rows = {r[0]: r[1] for r in clean}
    passage = " ".join(set(rows[70].split()) & set(rows[71].split()))
    got = {r["doc_id"]: r["text"] for r in substring.substring_dedup(spark.createDataFrame(clean, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert got[70] == rows[70] and len(got[71].split()) <= len(rows[71].split()) - 50 and passage
    assert got[60] == "" and got[0] == rows[0]  # an exact copy is one span from end to end


def test_long_sentences_are_parted(spark):
    words = [f"word{i}" for i in range(400)]
    other = [*(f"else{i}" for i in range(50)), *words[100:260], *(f"more{i}" for i in range(50))]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "the " * 200), (4, "the " * 90)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split() for r in substring.substring_dedup(df).collect()}
    assert len(set(got[2]) & set(words[100:260])) < 70 and got[1] == words and len(got[4]) < 50


@pytest.mark.parametrize("marked", [True, False])
def test_no_long_passage_stays_whole(spark, marked):
    """Runs of 51 to 80 words pasted at any word of another text: no 50 words in a row of them are left."""
    rng, rows, runs, width = random.Random(3), [], [], 50

    def text(name, n):
        out, left = [], 0
        for k in range(n):
            first, left = left == 0, left - 1 if left else rng.randrange(3, 40)
            word = f"{name}{k}" if rng.random() < 0.5 else rng.choice("the of and river stone".split())
            out.append((word.capitalize() if first else word + "." * (left == 0)) if marked else word)
        return out

    for i in range(400):
        source, target, n = text(f"s{i}x", 150), text(f"t{i}x", 120), rng.randrange(51, 81)
        a, b = rng.randrange(150 - n), rng.randrange(120)
        runs.append(source[a : a + n])
        rows += [(2 * i, " ".join(source)), (2 * i + 1, " ".join(target[:b] + runs[-1] + target[b:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in substring.substring_dedup(df).collect()}
    whole = [i for i, r in enumerate(runs) if any(" ".join(r[k : k + width]) in got[2 * i + 1] for k in range(len(r) - width + 1))]
    assert whole == []


def test_scripts_without_spaces(spark):
    rng = random.Random(6)
    text = lambda n, low, high: "".join(chr(rng.randrange(low, high)) + rng.choice(["", "", "", "。", "！"]) * (rng.random() < 0.1) for _ in range(n))
    han, thai, shared = text(1600, 0x4E00, 0x9FA0), text(700, 0xE01, 0xE2F), text(150, 0x4E00, 0x9FA0)
    rows = [(1, han), (2, han), (3, thai), (4, text(300, 0xE01, 0xE2F) + thai[100:400]), (5, text(200, 0x4E00, 0x9FA0) + shared), (6, "短文" + shared + text(90, 0x4E00, 0x9FA0)), (7, "हिन्दी में एक वाक्य। " * 9), (8, text(60, 0x4E00, 0x9FA0)), (9, text(30, 0x3041, 0x3090) + shared[:70])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in substring.substring_dedup(df).collect()}
    assert got == brute(rows)
    assert got[2][0] == "" and len(got[4][0]) < 330 and len(got[6][0]) < 110 and got[1] == (han, 0) and got[9][1] == 0


def test_short_common_passages_stay(spark):
    """Fewer than 40 shared words are no copy, whatever their number of copies."""
    rng = random.Random(8)
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    line = words("common", 39) + "."
    rows = [(i, f"{words(f'a{i}x', rng.randrange(20, 60))}. {line} {words(f'b{i}x', rng.randrange(20, 60))}.") for i in range(30)]
    got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == dict(rows) and {r["n_removed"] for r in got} == {0}


def test_repeated_ids_and_a_very_long_text(spark):
    """Two texts of several MB that share their second half; rows that share a doc_id."""
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(50_000)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    half = text(350_000)
    rows = [(1, text(350_000) + " " + half), (2, text(300_000) + " " + half), (3, "x " * 500), (3, "y " * 500), (3, "x " * 500), (4, "x " * 300)]
    assert len(rows[0][1]) > 3_000_000
    got = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[0][1] == rows[0][1] and 300_000 <= len(got[1][1].split()) <= 300_010
    assert [len(t.split()) < 45 for _, t, _ in got[2:]] == [True] * 4 and got[-1][1] == ""


def test_substring_odd_tables(spark, docs, rows, empty, all_null, clashing):
    assert substring.substring_dedup(empty).count() == 0
    assert [r["text"] for r in substring.substring_dedup(all_null).collect()] == [None] * 3
    done = substring.substring_dedup(clashing)
    assert sorted(done.columns) == sorted(clashing.columns) and done.count() == len(rows)
    kept = substring.stage(spark, clashing, "")
    assert kept.columns == clashing.columns and kept.count() == len(rows)
    assert kept.where("n_chars <> length(text)").count() == 0
