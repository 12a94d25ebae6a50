"""Sinks, sources and remaining operators by way of the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text
from lexmill.operators import encode, tables
from lexmill.plans.registry import documents, query, table
from lexmill.sources import readers
from lexmill.sources.shared import shared_dir


def folder(s):
    return f"{shared_dir(s)}/table-{uuid.uuid4().hex}"


@query("k3_k9_process_documents", """
WITH d AS (SELECT n_chars % 2 = 0 AS early, doc_id % 13 = 0 AS bad, coalesce(length(text) + CASE WHEN doc_id % 13 = 0 THEN 6 ELSE 0 END, 0) >= 10 AS long FROM documents)
SELECT 1 AS run, count(*) FILTER (early AND long AND NOT bad) AS embedded, count(*) FILTER (early AND long AND bad) AS errors, count(*) FILTER (early AND NOT long) AS skipped FROM d
UNION ALL SELECT 2, count(*) FILTER (NOT early AND long AND NOT bad), count(*) FILTER (NOT early AND long AND bad), count(*) FILTER (early OR NOT long) FROM d
UNION ALL SELECT 3, 0, 0, count(*) FROM d""")
def k3(s, d):
    """Documents are encoded in three runs: some, all, all again. The encoder fails on marked texts, which concerns no others."""
    docs = documents(s, d).select("doc_id", "n_chars", F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("\\u0000"))).otherwise(F.col("text")).alias("text"))

    def load():
        own = encode.hashed(8)()

        def guarded(texts):
            if any("\\u0000" in t for t in texts):
                raise ValueError("marked")
            return own(texts)

        return guarded

    path, out = folder(s), []
    for run, rows in enumerate((docs.where("n_chars % 2 = 0"), docs, docs), 1):
        counts = encode.processed(rows.select("doc_id", "text"), load, path, "doc_id", "text", 10)
        out.append((run, counts["embedded"], counts["errors"], counts["skipped"]))
    return s.createDataFrame(out, "run int, embedded long, errors long, skipped long")


@query("r16_v5_encoded", "SELECT doc_id, token, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS token FROM documents) GROUP BY 1, 2")
def r16_encoded(s, d):
    """Dense and sparse output of whole texts in one pass; here the sparse one."""
    told = encode.encode(documents(s, d).select("doc_id", "text"), encode.hashed(8), "doc_id")
    return told.select("doc_id", F.explode("sparse").alias("token", "weight")).withColumn("weight", F.col("weight").cast("double"))


@query("k2_k6_k22_full_refresh", "SELECT lang, count(*) AS n FROM documents WHERE lang <> 'en' GROUP BY lang")
def k6(s, d):
    path = folder(s)
    docs = table(s, d, "documents").select("doc_id", "lang")
    docs.write.parquet(path)
    docs.where("lang <> 'en'").write.mode("overwrite").parquet(path)
    return s.read.parquet(path).groupBy("lang").agg(F.count("*").alias("n"))


@query("k5_k21_bulk_load", "SELECT count(*) AS points, round(sum(embedding[1]), 3) AS total FROM (SELECT CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)")
def k5(s, d):
    path = folder(s)
    readers.write_points(table(s, d, "embeddings"), path, 100)
    got = s.read.parquet(path)
    return got.agg(F.count("*").alias("points"), F.round(F.sum(F.get("embedding", 0).cast("double")), 3).alias("total"))


@query("k4_k8_json_lines", "SELECT user_id, CAST(sum(event_id) AS BIGINT) AS tokens FROM events GROUP BY user_id")
def k8(s, d):
    path = folder(s)
    rows = table(s, d, "events").select("user_id", "event_id")
    for part in (0, 1):
        readers.append_usage(rows.where(F.col("event_id") % 2 == part), path)
    return s.read.schema("user_id long, event_id long").json(path).groupBy("user_id").agg(F.sum("event_id").alias("tokens"))


@query("k16_k23_threads", "SELECT conv_id, count(*) AS messages, max(turn) AS updated_at, bool_or(role = 'system') AS is_active FROM conversations GROUP BY conv_id")
def k23(s, d):
    rows = table(s, d, "conversations")
    threads = rows.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("updated_at"), F.bool_or(F.col("role") == "system").alias("s")).withColumn("is_active", F.lit(True))
    return tables.set_where(threads, ~F.col("s"), {"is_active": F.lit(False)}).drop("s")


@query("k18_cleanup_victims", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)")
def k18(s, d):
    return tables.missing(table(s, d, "part").select("p_partkey"), table(s, d, "supplier").select(F.col("s_suppkey").alias("p_partkey")), "p_partkey")


@query("k19_review_rows", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS _index FROM labels ORDER BY doc_id LIMIT 30")
def k19(s, d):
    rows = table(s, d, "labels").select("doc_id").orderBy("doc_id").limit(30)
    return rows.withColumn("_index", F.row_number().over(Window.orderBy("doc_id")))


@query("s10_s11_existing_ids", "SELECT DISTINCT doc_id FROM labels WHERE doc_id IS NOT NULL")
def s11(s, d):
    return readers.ids(table(s, d, "labels"), "doc_id")


@query("s1_s3_json_sources", "SELECT doc_id AS n, CASE WHEN doc_id % 10 <> 0 THEN lang END AS language, doc_id % 10 = 0 AS broken FROM documents")
def s1(s, d):
    """Articles as JSON lines, one in ten cut short; what doesn't parse is told, not lost."""
    path = folder(s)
    docs = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("language"), F.col("doc_id") % 10 == 0)
    line = F.to_json(F.struct("id", "language"))
    docs.select(F.when(docs[2], F.concat(F.lit('{"id":"'), "id", F.lit('", "language'))).otherwise(line)).write.text(path)
    got = readers.checked(s, path, readers.ARTICLE)
    lost = F.regexp_extract("_broken", r'"id":"(\d+)"', 1)
    return got.select(F.coalesce("id", lost).cast("long").alias("n"), "language", F.col("_broken").isNotNull().alias("broken"))


@query("s10_s11_existing_ids", "SELECT DISTINCT doc_id FROM labels WHERE doc_id IS NOT NULL")
def s11(s, d):
    return readers.ids(table(s, d, "labels"), "doc_id")


@query("s1_s3_json_sources", "SELECT doc_id AS n, lang AS language FROM documents")
def s1(s, d):
    """Articles written as JSON and read with the explicit schema."""
    path = folder(s)
    docs = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("language"))
    docs.write.json(path)
    return s.read.schema(readers.ARTICLE).option("mode", "DROPMALFORMED").json(path).select(F.col("id").cast("long").alias("n"), "language")


@query("s8_s9_s24_uploads", "SELECT doc_id, left(sha256(text), 16) AS file_hash FROM documents")
def s8(s, d):
    """Uploads come as many (name, content) rows a file, so files are as large as the table wants them, not one a document."""
    path = folder(s)
    docs = table(s, d, "documents")
    docs.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.encode("text", "UTF-8").alias("content")).write.parquet(path)
    got = s.read.parquet(path)
    return got.select(F.regexp_extract("name", r"^doc(\d+)$", 1).cast("long").alias("doc_id"), text.file_hash(F.col("content")).alias("file_hash"))


@query("p2_p10_scope_routing", "SELECT 'laws' AS scope, count(*) AS n FROM documents WHERE lang = 'de' AND source = 'src1' UNION ALL SELECT 'decisions', count(*) FROM documents WHERE lang = 'fr'")
def p10(s, d):
    docs = table(s, d, "documents")
    one = lambda k, c: docs.where(c).agg(F.count("*").alias("n")).select(F.lit(k).alias("scope"), "n")
    return one("laws", "lang = 'de' and source = 'src1'").unionByName(one("decisions", "lang = 'fr'"))


@query("p17_citation_lookup", "SELECT doc_id, quality FROM labels WHERE doc_id = 4")
def p17(s, d):
    return table(s, d, "labels").where("doc_id = 4").select("doc_id", "quality")


@query("p19_registry_sanity", "SELECT p_partkey FROM part WHERE length(p_name) BETWEEN 2 AND 20 AND NOT regexp_matches(p_name, '^[0-9]+$') AND p_brand <> '' AND p_type <> ''")
def p19(s, d):
    return table(s, d, "part").where(F.length("p_name").between(2, 20) & ~F.col("p_name").rlike("^[0-9]+$") & (F.col("p_brand") != "") & (F.col("p_type") != "")).select("p_partkey")


@query("p20_optional_predicate", "SELECT doc_id FROM documents WHERE source = 'src2'")
def p20(s, d):
    return table(s, d, "documents").where("source = 'src2'").select("doc_id")


@query("j15_results_to_chunks", "WITH f AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_partkey = 7 ORDER BY 1 LIMIT 10) SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem SEMI JOIN f ON l_orderkey = k QUALIFY n <= 50")
def j15(s, d):
    rows = table(s, d, "lineitem")
    first = rows.where("l_partkey = 7").select("l_orderkey").distinct().orderBy("l_orderkey").limit(10)
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return rows.join(F.broadcast(first), "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("n")).where("n <= 50")


@query("j21_answer_references", "SELECT doc_id, CAST(n AS INT) AS row_no FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM labels ORDER BY doc_id LIMIT 30) WHERE n IN (2, 7, 12)")
def j21(s, d):
    rows = table(s, d, "labels").select("doc_id").orderBy("doc_id").limit(30)
    rows = rows.withColumn("row_no", F.row_number().over(Window.orderBy("doc_id")))
    answer = s.createDataFrame([("see Document #2, Document #7 and Document 12; Document #99",)], "a string")
    refs = answer.select(F.explode(F.array_distinct(F.regexp_extract_all("a", F.lit(r"[Dd]ocument #?(\d+)"), F.lit(1)))).alias("r")).select(F.col("r").cast("int").alias("row_no"))
    return rows.join(F.broadcast(refs), "row_no").select("doc_id", "row_no")


@query("w10_page_offsets", "SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM conversations")
def w10(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(s, d, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).alias("char_start"))


@query("w12_last_exchange", "SELECT conv_id, turn, left(text, 500) AS content FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def w12(s, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(s, d, "conversations").withColumn("n", F.row_number().over(w)).where("n <= 2").select("conv_id", "turn", F.substring("text", 1, 500).alias("content"))


@query("f33_f36_formats", "SELECT doc_id, '## Decision ' || doc_id || chr(10) || chr(10) || 'Language: ' || lang || chr(10) || chr(10) || text AS block FROM documents")
def f33(s, d):
    n = F.col("doc_id").cast("string")
    return table(s, d, "documents").select("doc_id", F.concat_ws("\n\n", F.concat(F.lit("## Decision "), n), F.concat(F.lit("Language: "), F.col("lang")), F.col("text")).alias("block"))


@query("f52_f54_dates", "SELECT o_orderkey, date_trunc('month', o_orderdate) AS month_start, o_orderdate + INTERVAL 24 HOUR AS expires FROM orders")
def f52(s, d):
    return table(s, d, "orders").select("o_orderkey", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month_start"), (F.col("o_orderdate") + F.expr("interval 24 hours")).alias("expires"))


@query("st2_incremental_state", "SELECT CASE WHEN l.doc_id IS NULL THEN 'parse' WHEN l.quality = 1 THEN 'done' ELSE 'embed' END AS step, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def st2(s, d):
    rows = table(s, d, "documents").select("doc_id").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy(F.when(F.col("quality").isNull(), "parse").when(F.col("quality") == 1, "done").otherwise("embed").alias("step")).agg(F.count("*").alias("n"))
