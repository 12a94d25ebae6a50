"""Parsers, contexts for prompts, reviews, reports and table upkeep."""

from __future__ import annotations

import uuid

from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from lexmill.functions import pii, text, vocab
from lexmill.operators import filters, many, retrieve, review, tables
from lexmill.plans.registry import documents, query, table
from lexmill.plans.retrieval import asked, best, points
from lexmill.plans.texts import PII_SPANS, pii_masked
from lexmill.sources import parsers, readers
from lexmill.sources.shared import landed, shared_dir


def folder(s):
    return f"{shared_dir(s)}/table-{uuid.uuid4().hex}"


WORD_ROWS = r"SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, unnest(range(0, len(string_split(text, ' ')))) AS i FROM conversations"


@query("a19_ordered_distinct", f"SELECT conv_id, turn, string_agg(w, ' ' ORDER BY i) AS words FROM (SELECT conv_id, turn, w, min(i) AS i FROM ({WORD_ROWS}) GROUP BY ALL) GROUP BY ALL")
def a19(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words"))


@query("a20_sorted_distinct", f"SELECT conv_id, turn, array_to_string(list_sort(list(DISTINCT w)), ' ') AS words FROM ({WORD_ROWS}) GROUP BY ALL")
def a20(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(F.array_distinct(F.split("text", " "))), " ").alias("words"))


@query("t9_recent_reviews", "SELECT conv_id, max(turn) AS updated_at FROM conversations GROUP BY 1")
def t9(s, d):
    return tables.recent(table(s, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated_at")), "updated_at", "conv_id")


@query("t11_first_of_each", "SELECT p_brand, list(p_name ORDER BY n) AS p_names FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_name) AS n FROM part) WHERE n <= 5 GROUP BY 1")
def t11(s, d):
    return tables.first_of_each(table(s, d, "part"), "p_brand", "p_size", "p_name", 5)


@query("t12_s2_file_order", "SELECT lang AS file, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def t12(s, d):
    """Files of a folder in the order of their names."""
    path = folder(s)
    table(s, d, "documents").where("lang is not null").select(F.col("lang").alias("f"), "doc_id").write.partitionBy("f").json(path)
    rows = s.read.schema("doc_id long").option("recursiveFileLookup", True).json(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"/f=([^/]+)/", 1).alias("file"))
    return rows.groupBy("file").agg(F.count("*").alias("n")).orderBy("file")


@query("r13_multilingual", f"SELECT query_id, id, rank FROM {best(15)}")
def r13(s, d):
    """A multilingual question uses the dense arm alone."""
    return many.dense(points(s, d), asked(s, d), 15).select("query_id", "id", "rank")


@query("u6_entity_difference", f"WITH {PII_SPANS} SELECT doc_id, list_sort(list_filter(list_distinct(list_transform(s, lambda x: x['entity_type'])), lambda t: t NOT IN ('CREDIT_CARD', 'SWISS_POSTCODE'))) AS types FROM spans")
def u6(s, d):
    return documents(s, d).select("doc_id", pii.kinds(pii.found(F.col("text")), ["CREDIT_CARD", "SWISS_POSTCODE"]).alias("types"))


@query("v3_own_recogniser", r"SELECT doc_id, 'CASE_NUMBER' AS entity_type, unnest(regexp_extract_all(text, '\b[A-Z]{2,4}-\d{3,}\b')) AS text FROM documents")
def v3(s, d):
    return pii.detect(documents(s, d), "doc_id", "text", ["CASE_NUMBER"], more=(("CASE_NUMBER", r"\b[A-Z]{2,4}-\d{3,}\b", 0.9),)).select("doc_id", "entity_type", "text")


@query("v6_counted_write", "SELECT count(*) AS rows, count(*) FILTER (text IS NULL) AS empty, CAST(coalesce(max(length(text)), 0) AS BIGINT) AS longest FROM documents")
def v6(s, d):
    got = tables.written(table(s, d, "documents"), folder(s), empty=F.count_if(F.col("text").isNull()), longest=F.coalesce(F.max(F.length("text")), F.lit(0)).cast("long"))
    return s.createDataFrame([(got["rows"], got["empty"], got["longest"])], "rows long, empty long, longest long")


@query("v1_payload_builder", "SELECT doc_id AS id, upper(lang) AS language, length(text) AS n FROM documents")
def v1(s, d):
    """The payload is any function from DataFrame to DataFrame."""
    build = lambda rows: rows.select(F.col("doc_id").alias("id"), F.upper("lang").alias("language"), F.length("text").alias("n"))
    return table(s, d, "documents").transform(build)


@query("v2_parse_decisions")
def v2_decisions(s, d):
    """Every document as a decision of the common schema."""
    rows = documents(s, d).select(F.col("doc_id").alias("id"), F.concat(F.lit("CH_"), "source", F.lit("_"), F.col("doc_id").cast("string")).alias("file_name"), "text")
    # a struct that is read at one place is taken apart, so judges and lower courts aren't looked for
    got = parsers.parse(rows, "decision").select("id", "date", "year", "language", "court", "outcome", "metadata.citations", F.length("content.reasoning").alias("reasoning"))
    return got.select("id", "date", "year", "language", "court", "outcome", F.size("citations.cases").alias("cases"), F.size("citations.laws").alias("laws"), "reasoning")


@query("f27_cantonal_decisions")
def f27(s, d):
    """Every document by the cantonal rules."""
    rows = documents(s, d).select(F.col("doc_id").alias("id"), F.concat(F.lit("TI_TRAC_"), F.col("doc_id").cast("string")).alias("file_name"), "text")
    got = parsers.parse(rows, "cantonal decision")
    return got.select("id", "date", "court", "outcome", *(F.length(f"content.{k}").alias(k) for k in ("facts", "reasoning", "decision")))


@query("m5_parse_status", "SELECT source, CASE WHEN coalesce(length(trim(text)), 0) = 0 THEN 'error' WHEN length(trim(text)) < 50 THEN 'skipped' ELSE 'success' END AS status, count(*) AS n FROM documents GROUP BY ALL")
def m5(s, d):
    return parsers.attempted(table(s, d, "documents"), 50).groupBy("source", "status").agg(F.count("*").alias("n"))


@query("f34_numbered_laws", "SELECT p_partkey, '### ' || p_size || '. ' || p_brand || ' Art. ' || p_partkey || CASE WHEN p_size < 25 THEN ' - ' || p_name ELSE '' END || ' (SR ' || p_type || ', DE)' || chr(10) || chr(10) || p_name AS line FROM part")
def f34(s, d):
    part = table(s, d, "part")
    return part.select("p_partkey", text.law_line("p_size", "p_brand", F.col("p_partkey").cast("string"), F.when(F.col("p_size") < 25, F.col("p_name")), "p_type", F.lit("de"), "p_name").alias("line"))


@query("f35_decision_context", f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM (SELECT * FROM {best(30)} QUALIFY row_number() OVER (PARTITION BY query_id, doc_key ORDER BY rank) = 1)) SELECT query_id, count(*) AS n_decisions, string_agg('### ' || doc_key || ' (' || year || ') - C' || (id % 5) || ' [' || upper(lang) || ']' || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS context FROM r WHERE n <= 10 GROUP BY query_id")
def f35(s, d):
    """The first ten decisions of each query with headings, separated by rules."""
    rows = retrieve.dedupe(retrieve.dense_many(points(s, d), asked(s, d), 30), "doc_key", 10, "query_id")
    line = text.decision_line("doc_key", "year", "court", "lang", "text")
    parts = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return rows.groupBy("query_id").agg(F.count("*").alias("n_decisions"), F.array_join(F.transform(parts, lambda x: x["line"]), "\n\n---\n\n").alias("context"))


@query("f39_shown_text", "WITH r AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Bundesgericht ' || p_name WHEN p_size % 3 = 1 THEN p_name END AS a, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS b, p_brand AS c FROM part) SELECT p_partkey, CASE WHEN a IS NOT NULL AND NOT starts_with(a, 'Bundesgericht') THEN a WHEN b <> '' THEN b ELSE c END AS shown FROM r")
def f39(s, d):
    size = F.col("p_size")
    regeste = F.when(size % 3 == 0, F.concat(F.lit("Bundesgericht "), "p_name")).when(size % 3 == 1, F.col("p_name"))
    return table(s, d, "part").select("p_partkey", text.shown_text(regeste, F.when(size % 2 == 0, F.col("p_type")).otherwise(""), F.concat(F.lit("Erwägungen I\n"), "p_brand"), F.lit("")).alias("shown"))


@query("f53_st8_year_window", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 1990 WHEN datediff('day', o_orderdate, TIMESTAMP '1998-08-02') <= 30 THEN 1996 ELSE 1993 END AS first_year, 1998 AS last_year FROM orders")
def f53(s, d):
    rows = table(s, d, "orders").withColumn("last_run", F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")))
    first, last = text.year_window("last_run", F.lit("1998-08-02").cast("date"), 1990, 1998)
    return rows.select("o_orderkey", first.alias("first_year"), last.alias("last_year"))


@query("f64_mmr_score", "SELECT event_id, round(0.98 * value - (1 - 0.98) * (user_id % 7) / 10.0, 6) AS score FROM events")
def f64(s, d):
    return table(s, d, "events").select("event_id", F.round(retrieve.mmr_score(F.col("value"), (F.col("user_id") % 7) / 10.0), 6).alias("score"))


@query("f71_prompt_budget", "SELECT doc_id, CASE WHEN length(text) // 4 + 500 > 1200 THEN left(text, 2800) ELSE text END AS context FROM documents")
def f71(s, d):
    return table(s, d, "documents").select("doc_id", text.prompt_budget("text", F.lit(500), 1200).alias("context"))


@query("f87_encrypted_texts", "SELECT doc_id, text, CASE WHEN text IS NOT NULL THEN TRUE END AS changed FROM documents")
def f87(s, d):
    """Texts after encryption and decryption; the key is the caller's (here a test's)."""
    key = F.lit("0123456789abcdef")
    rows = table(s, d, "documents").select("doc_id", F.col("text").alias("plain"), text.encrypted("text", key).alias("cipher"))
    return rows.select("doc_id", text.decrypted("cipher", key).alias("text"), (F.col("cipher") != F.col("plain")).alias("changed"))


@query("k14_m8_failed_logins", "WITH f AS (SELECT lower(trim('  User' || user_id || '@X.CH ')) AS email, ts FROM events WHERE event_type = 'error'), ok AS (SELECT DISTINCT 'user' || user_id || '@x.ch' AS email FROM events WHERE event_type = 'signup') SELECT email, count(*) AS n FROM f WHERE email NOT IN (SELECT email FROM ok) GROUP BY 1")
def m8(s, d):
    """Failures by cleaned address; those of addresses that logged in are cleared."""
    events = table(s, d, "events")
    mail = F.lower(F.trim(F.concat(F.lit("  User"), F.col("user_id").cast("string"), F.lit("@X.CH "))))
    failed, fine = events.where("event_type = 'error'").select(mail.alias("email")), events.where("event_type = 'signup'").select(mail.alias("email"))
    return tables.missing(failed, fine, "email").groupBy("email").agg(F.count("*").alias("n"))


@query("m2_processed_ids", "SELECT count(DISTINCT p_brand || '_' || (p_size % 3)) AS done, 8 AS next_number FROM part")
def m2(s, d):
    """Ids in written point files, and the number of the next file."""
    path = folder(s)
    part = table(s, d, "part").select(F.concat_ws("_", "p_brand", (F.col("p_size") % 3).cast("string"), F.lit("chunk"), F.col("p_partkey").cast("string")).alias("id"), F.format_string("embeddings_%05d", (F.col("p_partkey") % 8).cast("int")).alias("f"))
    part.write.partitionBy("f").json(path)
    rows = s.read.schema("id string").option("recursiveFileLookup", True).json(path)
    paths = rows.select(F.col("_metadata.file_path").alias("path")).distinct()
    return tables.base_ids(rows).agg(F.count("*").alias("done")).join(tables.next_number(paths), how="cross")  # a row each


@query("m3_m4_import_by_court", "SELECT source AS court, count(DISTINCT doc_id) AS points FROM documents GROUP BY 1")
def m4(s, d):
    """Each court's points go to a folder of its own; all are imported twice, and later ones replace earlier ones."""
    path = folder(s)
    rows = table(s, d, "documents").select("doc_id", F.col("source").alias("court"))
    for at in (1, 2):
        rows.withColumn("written_at", F.lit(at)).write.mode("append").partitionBy("court").parquet(path)
    return tables.latest(s.read.parquet(path), "doc_id", "written_at").groupBy("court").agg(F.count("*").alias("points"))


@query("m6_m15_run_summary", "SELECT lang AS language, count(*) AS files, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS kept, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS removed FROM documents GROUP BY 1")
def m6(s, d):
    known = table(s, d, "labels").select("doc_id").distinct().withColumn("k", F.lit(1))
    rows = table(s, d, "documents").select("doc_id", "lang").join(known, "doc_id", "left")
    return rows.groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("files"), F.count("k").alias("kept"), F.count_if(F.col("k").isNull()).alias("removed"))


@query("m7_shared_abbreviations", "SELECT p_name AS abbr, count(DISTINCT p_brand) AS laws FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def m7(s, d):
    return table(s, d, "part").groupBy(F.col("p_name").alias("abbr")).agg(F.countDistinct("p_brand").alias("laws")).where("laws > 1")


@query("m9_token_usage", "SELECT conv_id, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, count(*) AS turns FROM conversations GROUP BY 1")
def m9(s, d):
    path = folder(s)
    readers.append_usage(table(s, d, "conversations").select("conv_id", "turn", text.estimate_tokens("text").alias("tokens")), path)
    return s.read.schema("conv_id long, turn long, tokens long").json(path).groupBy("conv_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("turns"))


@query("m10_widened_table", "SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT doc_id, NULL, NULL FROM documents")
def m10(s, d):
    path = folder(s)
    table(s, d, "documents").select("doc_id").write.parquet(f"{path}/part=old")
    table(s, d, "labels").select("doc_id", "quality", "toxic").write.parquet(f"{path}/part=new")
    return tables.widened(s, path).select("doc_id", "quality", "toxic")


FIELDS = [("toxic", "Toxic", 2, "boolean"), ("quality", "Quality", 1, "integer")]


def label_cells(s, d):
    return table(s, d, "labels").select(F.col("doc_id").alias("doc"), F.explode(F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string"))).alias("field", "value"))


@query("m11_review_context", "SELECT doc_id AS doc, concat_ws(chr(10), '- **Quality**: ' || quality, '- **Toxic**: ' || CASE toxic WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' END) AS context FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL")
def m11(s, d):
    return review.context(label_cells(s, d), s.createDataFrame(FIELDS, "name string, display_name string, position int, kind string"))


@query("m11_w11_history", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10")
def m11_history(s, d):
    return review.history(table(s, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


@query("m12_review_changes", "SELECT doc_id, CASE WHEN quality = 1 THEN 'completed' ELSE 'open' END AS status FROM labels WHERE NOT (coalesce(toxic, 0) = 1 AND doc_id % 2 = 0)")
def m12(s, d):
    """Reviews are made, completed by a condition and deleted by their owner only."""
    rows = table(s, d, "labels").withColumn("status", F.lit("open"))
    rows = tables.set_where(rows, F.col("quality") == 1, {"status": F.lit("completed")})
    return tables.delete(rows, (F.col("toxic") == 1) & (F.col("doc_id") % 2 == 0)).select("doc_id", "status")


@query("m13_cell_maps", "SELECT doc_id AS doc, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic, 2 AS n FROM labels")
def m13(s, d):
    return review.as_map(label_cells(s, d)).select("doc", F.col("fields")["quality"].alias("quality"), F.col("fields")["toxic"].alias("toxic"), F.size("fields").alias("n"))


@query("m14_download_status", "SELECT CASE WHEN strlen(html) > 10000 THEN 'success' WHEN starts_with(html, '<') THEN 'skipped' ELSE 'missing' END AS status, count(*) AS n FROM pages GROUP BY 1")
def m14(s, d):
    status = F.when(F.octet_length("html") > 10000, "success").when(F.col("html").startswith("<"), "skipped").otherwise("missing")
    return table(s, d, "pages").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("m16_result_cards", "SELECT p_partkey, '**' || p_size || '. ' || p_brand || ' Art. ' || p_partkey || '**' || chr(10) || 'SR ' || p_type || ' • `FR` • Score: 0.50' || chr(10) || chr(10) || '> ' || p_name || chr(10) AS card, CASE p_size % 3 WHEN 0 THEN '🟢 Einheitliche Rechtslage (hohe Konfidenz)' ELSE '🟡 Gemischte Rechtslage (mittlere Konfidenz)' END AS label FROM part")
def m16(s, d):
    part, third = table(s, d, "part"), F.col("p_size") % 3 == 0
    card = text.law_card("p_size", "p_brand", F.col("p_partkey").cast("string"), "p_type", F.lit("fr"), F.lit(0.5), "p_name")
    return part.select("p_partkey", card.alias("card"), text.consistency_label(F.when(third, "CONSISTENT"), F.when(third, "high")).alias("label"))


@query("m18_x8_masked_for_logs", f"WITH {PII_SPANS} SELECT doc_id, {pii_masked('[REDACTED:{entity_type}]')} AS masked FROM spans")
def m18(s, d):
    return pii.scrubbed_for_logging(documents(s, d), "text", "masked").select("doc_id", "masked")


@query("s12_chunks_of_decision", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) <= 50")
def s12(s, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").withColumn("n", F.row_number().over(w)).where("n <= 50").drop("n")


@query("s14_no_whitelist", "SELECT doc_id FROM documents")
def s14(s, d):
    """Without a whitelist nothing is filtered."""
    return filters.active_only(table(s, d, "documents").select("doc_id", "source"), None, "doc_id").select("doc_id")


@query("s15_code_union", "SELECT p_brand AS code FROM part UNION SELECT n_name FROM nation UNION SELECT r_name FROM region")
def s15(s, d):
    one = lambda t, c: table(s, d, t).select(F.col(c).alias("code"))
    return tables.dimension(one("part", "p_brand"), one("nation", "n_name"), one("region", "r_name"))


@query("s18_landed_pages", "SELECT source, least(count(*), 9500) AS hits FROM documents GROUP BY 1")
def s18(s, d):
    """Pages of hits as landed JSON: 500 a page, of each source at most 9,500 as the interface gives no more."""
    path = folder(s)
    table(s, d, "documents").select("doc_id", "source").write.option("maxRecordsPerFile", 500).json(path)
    return s.read.schema("doc_id long, source string").json(path).groupBy("source").agg(F.least(F.count("*"), F.lit(9500)).alias("hits"))


@query("s20_s22_preferred_path", "SELECT p_brand, arg_min(p_name, (p_size, p_name)) AS p_name FROM part GROUP BY 1")
def s20(s, d):
    return tables.preferred(table(s, d, "part"), "p_brand", "p_name", "p_size")


#: A preset and answers that expressions make of each document: fenced JSON with a quote, a wrong option, a broken one.
REVIEW_FIELDS = [("opening", "string", None), ("language", "enum", ["de", "fr", "en"]), ("chars", "integer", None), ("note", "string", None)]
PAGE = 500
ANSWERS_SQL = r"""
d AS (SELECT doc_id AS doc, text, lang, n_chars, substr(text, CAST(length(text) // 2 + 1 AS BIGINT), 60) AS q FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc, nullif(q, '') AS quote, lower(trim(regexp_replace(left(q, 50), '[ \t\n\x0b\f\r]+', ' ', 'g'), ' ')) AS look FROM d WHERE doc % 9 <> 0),
p AS (SELECT doc, page, lower(trim(regexp_replace(substr(text, (page - 1) * 500 + 1, 500), '[ \t\n\x0b\f\r]+', ' ', 'g'), ' ')) AS t FROM (SELECT doc, text, unnest(range(1, CAST(greatest(1, ceil(length(text) / 500.0)) AS BIGINT) + 1)) AS page FROM d)),
f AS (SELECT doc, min(page) AS page FROM q JOIN p USING (doc) WHERE contains(t, look) AND quote IS NOT NULL GROUP BY doc),
c AS (
  SELECT d.doc, 'opening' AS field, CASE WHEN d.doc % 9 <> 0 THEN 'word ' || d.doc END AS value, CASE WHEN quote IS NOT NULL THEN coalesce(f.page, 99) END AS page, q.quote, CASE WHEN d.doc % 9 = 0 THEN 'no object' END AS error FROM d LEFT JOIN q USING (doc) LEFT JOIN f USING (doc)
  UNION ALL SELECT doc, 'language', CASE WHEN doc % 9 <> 0 THEN lang END, NULL, NULL, CASE WHEN doc % 9 = 0 THEN 'no object' WHEN lang NOT IN ('de', 'fr', 'en') THEN 'no option' END FROM d
  UNION ALL SELECT doc, 'chars', CASE WHEN doc % 9 <> 0 THEN CASE WHEN doc % 4 = 0 THEN 'many' ELSE CAST(n_chars AS VARCHAR) END END, NULL, NULL, CASE WHEN doc % 9 = 0 THEN 'no object' WHEN doc % 4 = 0 THEN 'no integer' END FROM d
  UNION ALL SELECT doc, 'note', NULL, NULL, NULL, CASE WHEN doc % 9 = 0 THEN 'no object' END FROM d)
"""


def review_cells(s, d):
    fields = [Row(name=n, kind=k, options=o) for n, k, o in REVIEW_FIELDS]
    docs = documents(s, d).where("text is not null").select(F.col("doc_id").alias("doc"), "text", "lang", "n_chars")
    quote = F.expr("substring(text, cast(length(text) div 2 + 1 as int), 60)")
    opening = F.struct(F.concat(F.lit("word "), F.col("doc").cast("string")).alias("value"), quote.alias("quote"), F.lit(99).alias("page"))
    chars = F.when(F.col("doc") % 4 == 0, "many").otherwise(F.col("n_chars").cast("string"))
    told = F.to_json(F.struct(opening.alias("opening"), F.col("lang").alias("language"), chars.alias("chars")))
    answer = F.when(F.col("doc") % 9 == 0, F.concat(F.lit("{broken "), told)).otherwise(F.concat(F.lit("```json\n"), told, F.lit("\n```")))
    cut = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0)))
    pages = docs.select("doc", F.posexplode(cut).alias("k", "text")).select("doc", (F.col("k") + 1).alias("page"), "text")
    return review.cells(docs.select("doc", answer.alias("answer")), fields, pages), fields


@query("f82_v4_review_cells", f"WITH {ANSWERS_SQL} SELECT * FROM c")
def f82(s, d):
    """The cells of every document's answer, with pages of quotes and errors."""
    return review_cells(s, d)[0].select("doc", "field", "value", F.col("page").cast("long").alias("page"), "quote", "error")


@query("k7_export_sheets", rf"""WITH {ANSWERS_SQL}
SELECT 'data' AS sheet, concat_ws('|', doc, max(value) FILTER (field = 'opening'), max(value) FILTER (field = 'language'), max(value) FILTER (field = 'chars'), max(value) FILTER (field = 'note')) AS line FROM c GROUP BY doc
UNION ALL SELECT 'citations', concat_ws('|', doc, field, page, trim(regexp_replace(quote, '[ \t\n\x0b\f\r]+', ' ', 'g'), ' ')) FROM c WHERE quote IS NOT NULL
UNION ALL SELECT 'summary', concat_ws('|', field, count(value), count(quote), count(error)) FROM c GROUP BY field""")
def k7(s, d):
    """The three sheets of a review, written as CSV and read again."""
    path, out = folder(s), None
    cells, fields = review_cells(s, d)
    for name, rows in review.sheets(landed(cells), fields).items():
        columns = [F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns]
        rows.select(*columns).write.option("header", True).option("escape", '"').option("emptyValue", '""').csv(f"{path}/{name}")
        got = s.read.schema(", ".join(f"`{c}` string" for c in rows.columns)).option("header", True).option("escape", '"').csv(f"{path}/{name}")
        line = got.select(F.lit(name).alias("sheet"), F.concat_ws("|", *got.columns).alias("line"))
        out = line if out is None else out.unionByName(line)
    return out
