"""Search and ranking operators (R)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalise import registry_text
from ..functions.similarity import dot
from ..operators import search as ops
from ..operators.filters import initial_of
from ..operators.ranking import page
from .joins import _DOT
from .views import Views, query

_LEX = """
, ix AS (SELECT c.cluster_id, c.category, c.canonical_name AS n, s.total_mentions FROM cluster c JOIN stats s ON c.cluster_id = s.cluster_id)
, lex AS (SELECT *, CASE WHEN n = '{q}' THEN 1.0 ELSE greatest(0.0,
    CASE WHEN contains(n, '{q}') OR contains('{q}', n) THEN 0.7 + 0.3 * least(length(n), {k}) / greatest(length(n), {k}) ELSE 0 END,
    CASE WHEN 1 - levenshtein(n, '{q}') / greatest(length(n), {k}) > 0.6 THEN (1 - levenshtein(n, '{q}') / greatest(length(n), {k})) * 0.8 ELSE 0 END,
    CASE WHEN contains(lower(category), '{q}') OR contains('{q}', lower(category)) THEN 0.3 ELSE 0 END) END AS lexical FROM ix)
"""


def _index(v: Views) -> DataFrame:
    return v.cluster.select("cluster_id", "category", "canonical_name").join(v.stats.select("cluster_id", "total_mentions"), "cluster_id")


def _lexical(q: str):
    return ops.cluster_score(q, F.array("canonical_name"), F.col("category"), [])


@query("r01_lexical_score", _LEX.format(q="red gear", k=8) + "SELECT cluster_id, round(lexical, 6) AS score FROM lex")
def r01(v: Views) -> DataFrame:
    return _index(v).select("cluster_id", F.round(_lexical("red gear"), 6).alias("score"))


_HYBRID = f", sem AS (SELECT e.vec_id AS cluster_id, round({_DOT.format(a='e.embedding', b='q.embedding')}, 6) AS sem FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


@query(
    "r02_hybrid_score",
    _LEX.format(q="red gear", k=8) + _HYBRID + " SELECT l.cluster_id, round(CASE WHEN lexical >= 0.9 THEN 0.3 * sem + 0.7 * lexical WHEN lexical >= 0.6 THEN 0.5 * sem + 0.5 * lexical ELSE 0.65 * sem + 0.35 * lexical END, 5) AS score FROM lex l JOIN sem s ON l.cluster_id = s.cluster_id",
)
def r02(v: Views) -> DataFrame:
    asked = v.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))  # one row
    sem = v.embeddings.crossJoin(F.broadcast(asked)).select(F.col("vec_id").alias("cluster_id"), F.round(dot(F.col("embedding"), F.col("q")), 6).alias("sem"))
    return _index(v).join(sem, "cluster_id").select("cluster_id", F.round(ops.hybrid_score(_lexical("red gear"), F.col("sem")), 5).alias("score"))


@query("r03_search", _LEX.format(q="gear", k=4) + "SELECT cluster_id, round(lexical, 6) AS score FROM lex WHERE category = 'SMALL' AND lexical > 0 ORDER BY score DESC, total_mentions DESC, cluster_id LIMIT 20")
def r03(v: Views) -> DataFrame:
    found = ops.search(_index(v), "gear", _lexical("gear"), 20, "SMALL", [F.desc("total_mentions"), F.col("cluster_id")])
    return found.select("cluster_id", "score")


_ENT = """
, sc AS (SELECT id, name, category, cnt, CASE WHEN name = 'hot' THEN 1.0 WHEN starts_with(name, 'hot') THEN 0.95 WHEN contains(name, 'hot') OR contains('hot', name) THEN 0.75 + 0.2 * least(length(name), 3) / greatest(length(name), 3) WHEN 1 - levenshtein(name, 'hot') / greatest(length(name), 3) >= 0.65 THEN (1 - levenshtein(name, 'hot') / greatest(length(name), 3)) * 0.8 ELSE 0.0 END AS score FROM entity)
"""


@query("r04_entity_score", _ENT + "SELECT id, round(CAST(score AS DOUBLE), 6) AS score FROM sc WHERE score > 0.2")
def r04(v: Views) -> DataFrame:
    q = registry_text(F.lit("Hot"))
    scored = v.entity.select("id", F.round(ops.entity_score(q, F.array("name"), F.col("category")), 6).alias("score"))
    return scored.where("score > 0.2")


@query(
    "r05_entities_page",
    _ENT + "SELECT id, name, round(CAST(score AS DOUBLE), 6) AS score, (SELECT count(*) FROM sc WHERE score > 0.2 AND category = 'LARGE' AND name LIKE 'h%') AS total FROM sc WHERE score > 0.2 AND category = 'LARGE' AND name LIKE 'h%' ORDER BY score DESC, cnt DESC, id LIMIT 10 OFFSET 10",
)
def r05(v: Views) -> DataFrame:
    rows = v.entity.where("category = 'LARGE'").where(initial_of(F.col("name")) == "H")
    score = F.round(ops.entity_score(registry_text(F.lit("Hot")), F.array("name"), F.col("category")), 6)
    scored = rows.withColumn("score", score).where("score > 0.2")
    total = scored.agg(F.count("*").alias("total"))
    return page(scored, [F.desc("score"), F.desc("cnt"), F.col("id")], 2, 10).select("id", "name", "score").crossJoin(F.broadcast(total))


@query(
    "r06_evidence",
    "SELECT id, round(CASE WHEN contains(name, 'gear') THEN 2.0 WHEN contains(lower(subcategory), 'gear') THEN 0.5 ELSE 0 END + CASE WHEN contains(name, 'hot') THEN 2.0 ELSE 0 END + CASE WHEN length(name) > 3 AND contains('what is a hot gear', name) THEN 4.0 + 3.0 ELSE 0 END + 0.05 * ln(cnt + 1), 6) AS score FROM entity ORDER BY score DESC, id LIMIT 15",
)
def r06(v: Views) -> DataFrame:
    score = ops.evidence_score(["gear", "hot"], "What is a hot gear", F.col("name"), F.array("name"), F.array("subcategory"), F.col("cnt"))
    return v.entity.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(15)


@query(
    "r07_semantic_candidates",
    _HYBRID + ", t AS (SELECT cluster_id AS id, sem FROM sem WHERE sem > 0.1 ORDER BY sem DESC, cluster_id LIMIT 25) SELECT t.id, e.name, t.sem FROM t JOIN entity e ON t.id = e.id",
)
def r07(v: Views) -> DataFrame:
    asked = v.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    sem = v.embeddings.crossJoin(F.broadcast(asked))
    sem = sem.select(F.col("vec_id").alias("id"), F.round(dot(F.col("embedding"), F.col("q")), 6).alias("sem")).where("sem > 0.1")
    return sem.orderBy(F.desc("sem"), "id").limit(25).join(v.entity.select("id", "name"), "id")


@query(
    "r08_voice_excerpts",
    ", x AS (SELECT conv_id, turn, text FROM conversations WHERE length(text) BETWEEN 80 AND 250 AND NOT contains(text, '|')), f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1), g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY substr(text, 1, 40) ORDER BY conv_id) = 1) SELECT conv_id, turn FROM g ORDER BY conv_id LIMIT 3",
)
def r08(v: Views) -> DataFrame:
    x = v.conversations.where(F.length("text").between(80, 250) & ~F.col("text").contains("|"))
    x = x.withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("rn = 1")
    x = x.withColumn("rn", F.row_number().over(Window.partitionBy(F.substring("text", 1, 40)).orderBy("conv_id"))).where("rn = 1")
    return x.orderBy("conv_id").limit(3).select("conv_id", "turn")


#: A question a category, the three most counted entities of it as evidence; types stand for categories.
_EVIDENCE = """
, k AS (SELECT category, CASE category WHEN 'PROMO' THEN 'SUBSTANCE' WHEN 'ECONOMY' THEN 'PLANT' ELSE category END AS kind FROM entity GROUP BY 1)
, ranked AS (SELECT e.*, k.kind, row_number() OVER (PARTITION BY e.category ORDER BY cnt DESC, id) AS r FROM entity e JOIN k ON e.category = k.category QUALIFY r <= 3)
, q AS (SELECT category, any_value(kind) AS kind, CASE WHEN length(category) % 2 = 0 THEN 'How to make ' || lower(category) || '?' ELSE 'What is ' || lower(category) || '?' END AS question,
  string_agg('- [' || id || '] ' || name || ' (' || cnt || ' mentions)' || CASE WHEN any_known THEN chr(10) || '  Context: ' || subcategory ELSE '' END, chr(10) ORDER BY r) AS lines
  FROM (SELECT *, kind IN ('SUBSTANCE', 'PLANT') AS any_known FROM ranked) GROUP BY 1)
"""


def _asked(v: Views) -> DataFrame:
    from ..operators.ranking import top_per_group

    kind = F.when(F.col("category") == "PROMO", "SUBSTANCE").when(F.col("category") == "ECONOMY", "PLANT").otherwise(F.col("category"))
    t = top_per_group(v.entity.withColumn("kind", kind), ["category"], [F.desc("cnt"), F.col("id")], 3)
    piece = F.struct(
        F.col("id").cast("string").alias("id"), F.col("kind").alias("category"), F.col("name").alias("canonical_name"), F.col("name").alias("local_name"),
        F.array("name").alias("names"), F.col("cnt").cast("long").alias("count"), F.array("subcategory").alias("contexts"), F.lit(None).cast("array<string>").alias("excerpts"),
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", piece.alias("e")))), lambda s: s["e"])  # three a category
    low = F.lower("category")
    question = F.when(F.length("category") % 2 == 0, F.concat(F.lit("How to make "), low, F.lit("?"))).otherwise(F.concat(F.lit("What is "), low, F.lit("?")))
    return t.groupBy("category").agg(listed.alias("evidence")).withColumn("question", question)


@query(
    "r09_prompt",
    _EVIDENCE
    + """SELECT category, 'A reader asks: "' || question || '"' || chr(10) || chr(10) || 'Evidence from your text, by kind:' || chr(10) || chr(10) || '**' || kind || ':**' || chr(10) || lines || chr(10) || chr(10)
|| 'Answer as the author would, in the first person, from the above alone.' || chr(10) || 'The year is 1650; a modern term is unknown to you and answered by analogy.' || chr(10) || 'Let the question set the length. No headings or remarks about the answer.'
|| CASE WHEN length(category) % 2 = 0 THEN chr(10) || 'The question asks for a procedure: give a table of items, reasons and cautions.' ELSE '' END AS message FROM q""",
)
def r09(v: Views) -> DataFrame:
    from ..operators.prompts import user_message

    message = user_message(F.col("question"), F.col("evidence"), F.lit("the author"), F.lit(1650))
    # the line with the JSON form is the same in all
    return _asked(v).select("category", F.regexp_replace(message, r"(?s)\nReply with one JSON object: .*$", "").alias("message"))


@query(
    "r09b_validation",
    _EVIDENCE
    + """, n AS (SELECT category, list(CAST(id AS VARCHAR) ORDER BY r) AS ids, list(name ORDER BY r) AS names, string_agg('| ' || name || ' | ' || kind || ' | ' || subcategory || ' |', chr(10) ORDER BY r) AS tab FROM ranked GROUP BY 1)
SELECT q.category, 'Made of it.' || CASE WHEN length(q.category) % 2 = 0 THEN chr(10) || chr(10) || '## Evidence' || chr(10) || chr(10) || '| Item | Kind | Reason |' || chr(10) || '|---|---|---|' || chr(10) || tab ELSE '' END AS response,
ids[1] || ',' || list_last(list_filter(list_zip(names, ids), lambda p: p[1] = names[2]))[2] AS cited, 'moderate' AS confidence FROM q JOIN n ON q.category = n.category""",
)
def r09b(v: Views) -> DataFrame:
    """Replies that cite an id, a name and something that was never retrieved."""
    from ..operators.prompts import parsed_reply, validated

    cite = lambda id, name: F.concat(F.lit('{"entity_id":"'), id, F.lit('","entity_name":"'), name, F.lit('"}'))
    e = lambda k: F.element_at("evidence", k)
    cited = F.concat_ws(",", cite(e(1)["id"], F.lit("x")), cite(F.lit("?"), F.upper(e(2)["local_name"])), cite(F.lit("?"), F.lit("never seen")))
    reply = F.concat(F.lit('```json\n{"response":"## Response\\nMade of it.","evidence_used":['), cited, F.lit('],"confidence":"sure"}\n```'))
    done = _asked(v).withColumn("v", validated(parsed_reply(reply), F.col("evidence"), F.col("question")))
    ids = F.array_join(F.transform("v.evidence_used", lambda u: u["entity_id"]), ",")
    return done.select("category", "v.response", ids.alias("cited"), "v.confidence")


@query("r10_translate", "SELECT item_id, 'xx:' || text AS answer FROM benchmark")
def r10(v: Views) -> DataFrame:
    from ..sources.providers import ask

    heads = v.benchmark.select("item_id", "text")
    return ask(heads, "text", lambda keys: ["xx:" + k for k in keys]).select("item_id", "answer")
