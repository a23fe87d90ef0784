"""Small tables for the corpus operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the river runs over old stones while children watch slow boats drift towards evening harbour lights".split(),
    "de": "der alte fluss über steine während kinder langsame boote sehen die abends zum hafen treiben möchten".split(),
}


def prose(rng: random.Random, lang: str, n: int) -> str:
    out = []
    while len(out) < n:
        s = [rng.choice(WORDS[lang]) + str(rng.randrange(40)) * (rng.random() < 0.3) for _ in range(rng.randrange(4, 14))]
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
    return " ".join(out[:n])


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(11)
    made = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        made.append((i, prose(rng, lang, rng.choice([3, 12, 60, 150])), lang, f"s{i % 4 if i % 5 else 0}"))
    passage = prose(rng, "en", 60)
    for i, j in ((60, 5), (61, 6), (62, 7)):
        made.append((i, made[j][1], made[j][2], "s0"))
    for i in range(63, 70):
        words = made[8 if i % 2 else 10][1].split()
        words[rng.randrange(len(words))] = "changed"
        made.append((i, " ".join(words), "en", "s1"))
    for i in range(70, 75):
        made.append((i, f"{prose(rng, 'en', 40)} {passage} {prose(rng, 'en', 30)}", "en", "s2"))
    made += [(75, None, "en", None), (76, "", None, "s3"), (77, " \n\t ", "en", "s3"), (78, "!!! 123 ???", "en", "s3")]
    made += [(79, prose(rng, "de", 6000), "de", "s3"), (80, "x" * 30000, "en", "s3"), (81, "日本語 テキスト é ́", "en", "s3")]
    made += [made[3], (None, "no id here at all", "en", "s1"), (None, "no id here at all", "en", "s1")]
    return [(a, b, c, d, None if b is None else len(b)) for a, b, c, d in made]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def clean(rows):
    """The rows with distinct ids."""
    return [r for i, r in enumerate(rows) if r[0] is not None and r[0] not in {x[0] for x in rows[:i]}]


@pytest.fixture(scope="session")
def tables(spark, rows, clean, tmp_path_factory):
    """A data directory with documents and labels."""
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(clean, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], r[0] % 2, int(r[0] % 7 == 0)) for r in clean if r[0] % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns named like internal and output ones."""
    from pyspark.sql import functions as F

    names = ["id", "key", "hash", "set", "score", "__gone", "n_removed", "component_id", "__mark", "mix_epoch", "rep"]
    names += ["__id", "__lang", "__limit", "__quality", "__toxic", "__order", "__doc", "__text", "__long", "__source", "__blocks", "__tokens"]
    names += [f"__plan_{c}" for c in ("psrc", "blocks", "block", "epoch", "weight", "cut", "at")] + ["src", "tokens", "mark", "psrc", "block", "total"]
    names += ["__at_id", "__at_key", "__removed", "__dropped", "__toxicity", "at", "range", "extra", "o", "q", "known_id", "pooled", "x", "quality", "toxic", "media", "digest", "node", "root"]
    return docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def all_null(spark):
    kind = T.StructType([T.StructField(f.split()[0], T.LongType() if "long" in f else T.StringType()) for f in DOCS.split(", ")])
    return spark.createDataFrame([(None,) * 5] * 3, kind)
