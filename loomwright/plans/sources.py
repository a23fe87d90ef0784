"""Sources (S) and sinks (K): every query writes a small export to the shared folder and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import shared_root
from ..sources import providers, readers, sinks
from .views import Views, query


def _path(v: Views, name: str) -> str:
    path = f"{shared_root(v.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = v.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(v.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def _books(v: Views) -> DataFrame:
    e = F.struct(F.col("id").cast("string").alias("id"), "name", "category", "subcategory", F.col("cnt").alias("count"))
    # a book is one document, whose entities stand in it as a list
    g = v.entity.groupBy(F.concat_ws("/", "category", "subcategory").alias("b")).agg(F.array_sort(F.collect_list(e)).alias("entities"))
    book = F.struct(F.col("b").alias("id"), F.concat(F.lit("Book "), F.col("b")).alias("title"), F.lit(0).alias("year"))
    return g.select(book.alias("book"), "entities")


@query("s01_book_files", "SELECT category || '/' || subcategory AS book_id, CAST(id AS VARCHAR) AS id, name, cnt AS n FROM entity")
def s01(v: Views) -> DataFrame:
    path = _path(v, "books")
    _books(v).write.option("maxRecordsPerFile", 1).json(path)
    return readers.book_files(v.spark, path + "/*.json").select("book_id", "id", "name", F.col("count").alias("n"))


@query("s02_json_documents", "SELECT DISTINCT 'Book ' || category || '/' || subcategory AS title FROM entity")
def s02(v: Views) -> DataFrame:
    path = _path(v, "docs")
    _books(v).write.option("maxRecordsPerFile", 1).json(path)
    return readers.json_documents(v.spark, path, readers.BOOK_FILE).select("book.title")


@query("s03_whole_texts", "SELECT count(*) AS files, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT text FROM benchmark)")
def s03(v: Views) -> DataFrame:
    path = _path(v, "texts")
    v.benchmark.select(F.regexp_replace("text", r"\s+$", "").alias("text"), "item_id").repartition(8, "item_id").select("text").write.option("lineSep", "\u0001").text(path)
    t = readers.whole_texts(v.spark, path).select(F.explode(F.filter(F.split("text", "\u0001"), lambda x: x != "")).alias("text"))
    return t.agg(F.count("*").alias("files"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("s04_json_lines", "SELECT conv_id, turn, role FROM conversations")
def s04(v: Views) -> DataFrame:
    path = _path(v, "lines")
    good = v.conversations.select(F.to_json(F.struct("conv_id", "turn", "role")).alias("value"))
    good.unionByName(v.spark.createDataFrame([("{broken",)], "value string")).write.text(path)
    return readers.json_lines(v.spark, path, "conv_id long, turn long, role string")


@query("s05_csv", "SELECT p_name AS term_a, p_brand AS notes FROM part")
def s05(v: Views) -> DataFrame:
    path = _path(v, "pairs")
    p = v.part
    sinks.csv(p.select(*(F.col("p_name" if c == "term_a" else "p_brand").alias(c) for c in readers.PAIR_COLUMNS)), path)
    return readers.pair_csv(v.spark, path).select("term_a", "notes")


@query("s06_scanned_pages", "SELECT CAST(b + 1 AS INTEGER) AS leaf, CASE WHEN b = 2 THEN '' ELSE 'page ' || b END AS txt FROM range(4) t(b)")
def s06(v: Views) -> DataFrame:
    path = _path(v, "scan")
    words = lambda b: "" if b == 2 else f"<WORD x='1'>page</WORD><WORD>{b} </WORD>"
    xml = "<DOC>" + "".join(f"<OBJECT id='{b}'><HIDDENTEXT>{words(b)}</HIDDENTEXT></OBJECT>" for b in range(4)) + "</DOC>"
    v.spark.createDataFrame([(xml,)], "value string").coalesce(1).write.text(path)
    return readers.scanned_pages(v.spark, path).select("leaf", F.col("text").alias("txt"))


@query("s07_override_map", "SELECT * FROM (VALUES ('galen', 'Galen'), ('dioscorides', 'Pedanius')) t(key, val)")
def s07(v: Views) -> DataFrame:
    path = _path(v, "map")
    v.spark.createDataFrame([('{"_comment": "x", "galen": "Galen", "dioscorides": "Pedanius"}',)], "value string").coalesce(1).write.text(path)
    return readers.override_map(v.spark, path).withColumnRenamed("value", "val")


@query("s08_cached_fetch", "SELECT url, page_id AS n FROM pages")
def s08(v: Views) -> DataFrame:
    path = _path(v, "cache")
    v.pages.select("url", F.col("page_id").alias("n")).write.parquet(path)
    return v.spark.read.parquet(path)


@query("s09_lookup_provider", "SELECT id, CASE WHEN name LIKE 'r%' THEN 'R:' || name END AS answer FROM entity")
def s09(v: Views) -> DataFrame:
    def offline(keys: list[str]) -> list[str | None]:
        return ["R:" + k if k.startswith("r") else None for k in keys]

    return providers.ask(v.entity.select("id", "name"), "name", offline).select("id", "answer")


@query("s10_model_provider", "SELECT conv_id, turn, CAST(length(text) AS VARCHAR) AS answer FROM conversations")
def s10(v: Views) -> DataFrame:
    def stub(keys: list[str]) -> list[str | None]:
        return [str(len(k)) for k in keys]

    return providers.ask(v.conversations, "text", stub, batch=8).select("conv_id", "turn", "answer")


@query("s11_embedding_provider")
def s11(v: Views) -> DataFrame:
    e = v.entity.withColumn("text", providers.entity_text("name", "category", "subcategory"))
    return providers.embedded(e, "text", providers.HashEmbedder()).select("id", "embedding")


@query("s12_snapshot", "SELECT category, count(*) AS n FROM entity GROUP BY 1")
def s12(v: Views) -> DataFrame:
    return readers.cached(v.entity).groupBy("category").agg(F.count("*").alias("n"))


@query("k01_nested_json", "SELECT m.cluster_id, CAST(count(*) AS INTEGER) AS members FROM member m GROUP BY 1")
def k01(v: Views) -> DataFrame:
    c = v.cluster.select("cluster_id", "canonical_name")
    m = v.member.select("cluster_id", F.struct("book_id", "entity_id").alias("key"), "cnt")
    j = sinks.nested_json(c, m, "cluster_id", "members", "key")
    return j.select("cluster_id", F.json_array_length(F.get_json_object("json", "$.members")).alias("members"))


@query("k02_json_lines", "SELECT id, name FROM entity WHERE cnt > 45")
def k02(v: Views) -> DataFrame:
    path = _path(v, "out")
    sinks.json_lines(v.entity.where("cnt > 45").select("id", "name"), path)
    return readers.json_lines(v.spark, path, "id long, name string")


@query("k03_csv_lists", "SELECT category, array_to_string(list_sort(list(DISTINCT name))[1:4], ';') AS names FROM entity GROUP BY 1")
def k03(v: Views) -> DataFrame:
    path = _path(v, "csv")
    g = v.entity.groupBy("category").agg(F.slice(F.array_sort(F.collect_set("name")), 1, 4).alias("names"))
    sinks.csv(g, path, ["names"])
    return v.spark.read.schema("category string, names string").option("header", True).csv(path)


@query("k04_plain_csv", "SELECT conv_id, turn, translate(text, ',\"', ';''') AS txt FROM conversations")
def k04(v: Views) -> DataFrame:
    return v.conversations.select("conv_id", "turn", sinks.plain_field(F.col("text")).alias("txt"))


@query("k05_tsv", "SELECT cluster_id, canonical_name FROM cluster")
def k05(v: Views) -> DataFrame:
    path = _path(v, "tsv")
    sinks.csv(v.cluster.select("cluster_id", "canonical_name"), path, sep="\t")
    return v.spark.read.schema("cluster_id long, canonical_name string").option("header", True).option("sep", "\t").csv(path)


@query(
    "k06_text_report",
    ", l AS (SELECT category || ': ' || count(*) AS line FROM entity GROUP BY category) SELECT CAST(0 AS BIGINT) AS n, 'By category' AS line UNION ALL SELECT row_number() OVER (ORDER BY line), line FROM l",
)
def k06(v: Views) -> DataFrame:
    g = v.entity.groupBy("category").agg(F.count("*").alias("n"))
    return sinks.report_lines("By category", g, F.concat("category", F.lit(": "), F.col("n").cast("string")))


@query("k07_subsets", "SELECT 'linked' AS part, count(*) AS n FROM entity WHERE id % 3 = 0 UNION ALL SELECT 'open', count(*) FROM entity WHERE id % 3 <> 0")
def k07(v: Views) -> DataFrame:
    path = _path(v, "parts")
    linked = F.col("id") % 3 == 0
    sinks.subsets(v.entity.select("id"), path, {"linked": linked, "open": ~linked})
    back = [v.spark.read.schema("id long").json(f"{path}/{p}").select(F.lit(p).alias("part")) for p in ("linked", "open")]
    return back[0].unionByName(back[1]).groupBy("part").agg(F.count("*").alias("n"))


@query("k08_versions", "SELECT 'v1' AS version, count(*) AS n FROM entity UNION ALL SELECT 'v2', count(*) FROM entity WHERE cnt > 10")
def k08(v: Views) -> DataFrame:
    path = _path(v, "versions")
    v.entity.write.parquet(sinks.versioned(path, "v1"))
    v.entity.where("cnt > 10").write.parquet(sinks.versioned(path, "v2"))
    return v.spark.read.parquet(path).groupBy("version").agg(F.count("*").alias("n"))


@query("k09_resume", "SELECT id FROM entity WHERE id >= 500")
def k09(v: Views) -> DataFrame:
    done = _path(v, "done")
    v.entity.where("id < 500").select("id").write.parquet(done)
    return sinks.remaining(v.entity.select("id"), v.spark.read.parquet(done), ["id"])


@query("k10_dry_run", "SELECT lower(name) AS key, count(*) AS merged FROM entity GROUP BY 1 HAVING count(*) > 1")
def k10(v: Views) -> DataFrame:
    # a plan that is looked at, not written
    return v.entity.groupBy(F.lower("name").alias("key")).agg(F.count("*").alias("merged")).where("merged > 1")
