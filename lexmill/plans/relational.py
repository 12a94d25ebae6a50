"""Joins, aggregates, windows, paging and set operations over the relational tables (A*, J*, W*, T*, U*, P*, K*)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text, vector
from lexmill.operators import filters, many, review, tables
from lexmill.plans.registry import documents, query, table
from lexmill.sources.shared import shared_dir

AS_OF = "1998-03-15"


def usage(s, d):
    """Orders in the part of usage records: a user, a model, a cost, and tokens."""
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("model"), F.col("o_totalprice").alias("cost"), F.pmod(F.col("o_orderkey"), F.lit(1000)).alias("tokens"), F.col("o_orderdate").alias("used_at"))


USAGE = "(SELECT o_orderkey AS id, o_custkey AS user_id, o_orderpriority AS model, o_totalprice AS cost, o_orderkey % 1000 AS tokens, o_orderdate AS used_at FROM orders) u"
MONTH = "used_at >= TIMESTAMP '1998-03-01' AND used_at < TIMESTAMP '1998-04-01'"


def in_month(at="used_at"):
    """the half-open month of AS_OF."""
    start = F.date_trunc("month", F.lit(AS_OF).cast("timestamp_ntz")).cast("timestamp_ntz")
    return (F.col(at) >= start) & (F.col(at) < F.add_months(start, 1).cast("timestamp_ntz"))


@query("a1_monthly_totals", f"SELECT CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, round(coalesce(sum(cost), 0), 2) AS cost, count(*) AS n FROM {USAGE} WHERE {MONTH}")
def a1(s, d):
    return usage(s, d).where(in_month()).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 2).alias("cost"), F.count("*").alias("n"))


@query("a2_by_model", f"SELECT model, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 2) AS cost, count(*) AS n FROM {USAGE} WHERE {MONTH} GROUP BY model")
def a2(s, d):
    return usage(s, d).where(in_month()).groupBy("model").agg(F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 2).alias("cost"), F.count("*").alias("n"))


@query("a3_j9_users_over_threshold", f"SELECT c_custkey AS user_id, round(coalesce(sum(cost), 0), 2) AS total FROM customer LEFT JOIN {USAGE} ON c_custkey = user_id AND {MONTH} GROUP BY c_custkey HAVING coalesce(sum(cost), 0) >= 100000")
def a3(s, d):
    used = usage(s, d).where(in_month()).groupBy("user_id").agg(F.sum("cost").alias("cost"))  # sums go through the join, not rows
    users = table(s, d, "customer").select(F.col("c_custkey").alias("user_id"))
    total = F.coalesce("cost", F.lit(0.0))
    return users.join(used, "user_id", "left").where(total >= 100000).select("user_id", F.round(total, 2).alias("total"))


@query("a4_failed_logins", "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' AND ts > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 6 HOUR AND ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY user_id")
def a4(s, d):
    now = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return table(s, d, "events").where((F.col("event_type") == "error") & (F.col("ts") > now - F.expr("interval 6 hours")) & (F.col("ts") <= now)).groupBy("user_id").agg(F.count("*").alias("n"))


@query("a5_store_stats", "SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS parts, round(sum(size) / 1048576.0, 2) AS mb FROM (SELECT len(string_split(coalesce(text, ''), chr(10))) AS n, strlen(coalesce(text, '')) AS size FROM documents)")
def a5(s, d):
    t = F.coalesce("text", F.lit(""))
    return table(s, d, "documents").select(F.size(F.split(t, "\n")).alias("n"), F.octet_length(t).alias("size")).agg(F.count("*").alias("documents"), F.sum("n").alias("parts"), F.round(F.sum("size") / 1048576.0, 2).alias("mb"))


@query("a6_collection_stats", "SELECT 'lang' AS dim, lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY 2 UNION ALL SELECT 'size', CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END, count(*) FROM documents WHERE n_chars IS NOT NULL GROUP BY 2")
def a6(s, d):
    docs = table(s, d, "documents").select("lang", "source", F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "medium").when(F.col("n_chars").isNotNull(), "long").alias("size"))
    # one pass: each row gives a (dimension, value) pair for each dimension, combined map-side
    pairs = docs.select(F.explode(F.array(*(F.struct(F.lit(c).alias("dim"), F.col(c).alias("value")) for c in docs.columns))).alias("x")).select("x.*")
    return pairs.where("value is not null").groupBy("dim", "value").agg(F.count("*").alias("n"))


@query("a7_period_buckets", "SELECT CASE WHEN y >= 2000 THEN '>=2000' WHEN y >= 1998 THEN '1998-1999' WHEN y >= 1996 THEN '1996-1997' ELSE '<1996' END AS period, count(*) AS n FROM (SELECT year(o_orderdate) AS y FROM orders) WHERE y IS NOT NULL AND y <> 0 GROUP BY 1")
def a7(s, d):
    y = F.year("o_orderdate")
    bucket = F.when(y >= 2000, ">=2000").when(y >= 1998, "1998-1999").when(y >= 1996, "1996-1997").otherwise("<1996")
    return table(s, d, "orders").where(y.isNotNull() & (y != 0)).groupBy(bucket.alias("period")).agg(F.count("*").alias("n"))


@query("a8_top_counts", "WITH c AS (SELECT source AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS r FROM documents GROUP BY 1) SELECT value, CAST(n AS BIGINT) AS n FROM c WHERE r <= 10 UNION ALL SELECT '(rest)', CAST(coalesce(sum(n), 0) AS BIGINT) FROM c WHERE r > 10")
def a8(s, d):
    counts = table(s, d, "documents").groupBy(F.col("source").alias("value")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "value").limit(10)
    rest = counts.agg(F.sum("n").alias("t")).join(top.agg(F.sum("n").alias("u")), how="cross")  # a row each
    return top.unionByName(rest.select(F.lit("(rest)").alias("value"), (F.coalesce("t", F.lit(0)) - F.coalesce("u", F.lit(0))).alias("n")))


@query("a9_quality_pct", "SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS good, CAST(100 * count(*) FILTER (quality = 1) // greatest(1, count(*)) AS BIGINT) AS pct FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def a9(s, d):
    rows = table(s, d, "documents").select("doc_id", "lang").join(table(s, d, "labels"), "doc_id")
    good = F.count_if(F.col("quality") == 1)
    return rows.groupBy("lang").agg(F.count("*").alias("n"), good.alias("good"), F.expr("100 * count_if(quality = 1) div greatest(1, count(*))").alias("pct"))


@query("a10_article_stats", "SELECT coalesce(lang, 'unknown') AS language, count(*) AS articles, count(*) FILTER (n_chars > 5000) AS partial FROM documents GROUP BY 1")
def a10(s, d):
    return table(s, d, "documents").groupBy(F.coalesce("lang", F.lit("unknown")).alias("language")).agg(F.count("*").alias("articles"), F.count_if(F.col("n_chars") > 5000).alias("partial"))


@query("a11_score_statistics", "SELECT label, round(max(CAST(embedding[1] AS DOUBLE)), 6) AS top_score, round(var_pop(CAST(embedding[1] AS DOUBLE)), 6) AS score_variance FROM embeddings GROUP BY label")
def a11(s, d):
    x = F.get("embedding", 0).cast("double")
    return table(s, d, "embeddings").groupBy("label").agg(F.round(F.max(x), 6).alias("top_score"), F.round(F.var_pop(x), 6).alias("score_variance"))


@query("a13_session_stats", "SELECT conv_id, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, CAST(round(sum(length(text) // 4 * 0.000002), 4) AS DOUBLE) AS cost, CAST(sum(length(text) // 4) // count(*) AS BIGINT) AS per_turn FROM conversations GROUP BY conv_id")
def a13(s, d):
    rows = table(s, d, "conversations").select("conv_id", text.estimate_tokens("text").alias("t"))
    return rows.groupBy("conv_id").agg(F.sum("t").alias("tokens"), F.round(F.sum(F.col("t") * 0.000002), 4).alias("cost"), F.expr("sum(t) div count(*)").alias("per_turn"))


@query("a14_cost_flat", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS z FROM conversations) SELECT conv_id, count(*) < 3 OR avg(length(text)) FILTER (z <= 3) < 1.2 * avg(length(text)) FILTER (a <= 3) AS flat FROM r GROUP BY conv_id")
def a14(s, d):
    w = Window.partitionBy("conv_id")
    rows = table(s, d, "conversations").select("conv_id", F.length("text").alias("c"), F.row_number().over(w.orderBy("turn")).alias("a"), F.row_number().over(w.orderBy(F.desc("turn"))).alias("z"))
    avg = lambda c: F.avg(F.when(F.col(c) <= 3, F.col("c")))
    return rows.groupBy("conv_id").agg(((F.count("*") < 3) | (avg("z") < 1.2 * avg("a"))).alias("flat"))


@query("a15_tier_min_max", "WITH t AS (SELECT label, CASE WHEN m > 0.25 THEN 4 WHEN m > 0.15 THEN 3 WHEN m > 0.05 THEN 2 ELSE 1 END AS r FROM (SELECT label, vec_id % 5 AS lane, max(embedding[1]) AS m FROM embeddings GROUP BY 1, 2)) SELECT label, ['NONE', 'LOW', 'MEDIUM', 'HIGH'][min(r)] AS least, ['NONE', 'LOW', 'MEDIUM', 'HIGH'][max(r)] AS most FROM t GROUP BY label")
def a15(s, d):
    lanes = table(s, d, "embeddings").groupBy("label", (F.col("vec_id") % 5).alias("lane")).agg(F.max(F.get("embedding", 0)).alias("m"))
    tier = F.when(F.col("m") > F.lit(0.25).cast("float"), "HIGH").when(F.col("m") > F.lit(0.15).cast("float"), "MEDIUM").when(F.col("m") > F.lit(0.05).cast("float"), "LOW").otherwise("NONE")
    rows = lanes.withColumn("t", tier).withColumn("r", vector.tier_rank(F.col("t")))
    return rows.groupBy("label").agg(F.min_by("t", "r").alias("least"), F.max_by("t", "r").alias("most"))


@query("a16_a17_registry_min_status", "WITH f AS (SELECT p_brand, p_name, p_size, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part) SELECT p_brand AS sr_number, max(p_name) AS abbr, array_to_string(list_sort(list(DISTINCT p_name)), ',') AS all_abbr FROM f WHERE r = 1 GROUP BY p_brand")
def a16(s, d):
    part = table(s, d, "part")
    # the lowest status of each number, by an aggregate; then its rows
    least = part.groupBy("p_brand").agg(F.min("p_size").alias("p_size"))
    return part.join(least, ["p_brand", "p_size"], "left_semi").groupBy(F.col("p_brand").alias("sr_number")).agg(F.max("p_name").alias("abbr"), F.array_join(F.sort_array(F.collect_set("p_name")), ",").alias("all_abbr"))


@query("a18_ordered_concat", "SELECT conv_id, string_agg('[' || upper(role) || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def a18(s, d):
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("["), F.upper("role"), F.lit("]\n"), F.col("text")).alias("x"))))
    return table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["x"]), "\n\n").alias("context"))


@query("a21_correction_counts", "SELECT old || ' -> ' || new AS change, count(*) AS n FROM (SELECT p_type AS old, CASE WHEN p_size % 2 = 0 THEN upper(p_brand) ELSE p_type END AS new FROM part) WHERE old <> new GROUP BY 1 ORDER BY n DESC, change LIMIT 20")
def a21(s, d):
    part = table(s, d, "part").select(F.col("p_type").alias("old"), F.when(F.col("p_size") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_type")).alias("new"))
    return part.where("old <> new").groupBy(F.concat_ws(" -> ", "old", "new").alias("change")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "change").limit(20)


@query("a22_rollup_totals", "SELECT CASE WHEN grouping(source) = 1 THEN 'ALL' ELSE source END AS court, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (source)")
def a22(s, d):
    rows = table(s, d, "documents").rollup("source").agg(F.grouping("source").alias("all"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return rows.select(F.when(F.col("all") == 1, "ALL").otherwise(F.col("source")).alias("court"), "n", "chars")  # a missing source is no total


@query("a24_usage_per_request", "SELECT conv_id, turn // 2 AS request, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM conversations GROUP BY 1, 2")
def a24(s, d):
    return table(s, d, "conversations").groupBy("conv_id", F.expr("turn div 2").alias("request")).agg(F.sum(text.estimate_tokens("text")).alias("tokens"))


@query("a25_unique_counts", "SELECT count(DISTINCT p_brand) AS laws, count(DISTINCT p_type) AS kinds FROM part")
def a25(s, d):
    return table(s, d, "part").agg(F.countDistinct("p_brand").alias("laws"), F.countDistinct("p_type").alias("kinds"))


@query("a26_thread_counts", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1")
def a26(s, d):
    return table(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))


@query("a27_pipeline_analysis", "WITH r AS (SELECT source, doc_id, doc_id IN (SELECT doc_id FROM labels) AS parsed, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS embedded FROM documents) SELECT source AS court, count(*) AS raw, count(*) FILTER (parsed) AS parsed, count(*) FILTER (NOT parsed) AS to_parse, count(*) FILTER (parsed AND NOT embedded) AS to_embed, count(*) FILTER (parsed AND embedded) AS done FROM r GROUP BY 1")
def a27(s, d):
    state = table(s, d, "labels").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("e"))
    rows = table(s, d, "documents").select("source", "doc_id").join(state, "doc_id", "left")
    parsed, embedded = F.col("e").isNotNull(), F.coalesce(F.col("e") == 1, F.lit(False))
    n = F.count_if
    return rows.groupBy(F.col("source").alias("court")).agg(F.count("*").alias("raw"), n(parsed).alias("parsed"), n(~parsed).alias("to_parse"), n(parsed & ~embedded).alias("to_embed"), n(parsed & embedded).alias("done"))


@query("a29_file_totals", "SELECT lang, count(*) AS files, round(sum(strlen(coalesce(text, ''))) / 1048576.0, 2) AS mb FROM documents GROUP BY lang")
def a29(s, d):
    return table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("files"), F.round(F.sum(F.octet_length(F.coalesce("text", F.lit("")))) / 1048576.0, 2).alias("mb"))


@query("p1_filter_year_range", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) >= 1996 AND year(o_orderdate) <= 1997 AND o_orderstatus IN ('O', 'F') AND o_orderpriority = '2-HIGH'")
def p1(s, d):
    rows = table(s, d, "orders").withColumn("year", F.year("o_orderdate"))
    return rows.where(filters.compile_filter({"year_range": {"min": 1996, "max": 1997}, "o_orderstatus": ["O", "F"], "o_orderpriority": "2-HIGH", "sources": []})).select("o_orderkey")


@query("p4_active_laws", "SELECT doc_id FROM documents WHERE source = 'src1' OR doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def p4(s, d):
    docs = table(s, d, "documents").select("doc_id", F.when(F.col("source") == "src1", "ticino").otherwise(F.col("source")).alias("source"))
    active = table(s, d, "labels").where("quality = 1").select("doc_id")
    return filters.active_only(docs, active, "doc_id").select("doc_id")


@query("p5_p6_ordinance_split", "WITH f AS (SELECT lang, doc_id, contains(text, 'sch') AS o, row_number() OVER (PARTITION BY lang, contains(text, 'sch') ORDER BY doc_id) AS r FROM documents) SELECT lang, doc_id, o AS is_ordinance, row_number() OVER (PARTITION BY lang ORDER BY o, doc_id) AS rank FROM f WHERE r <= CASE WHEN o THEN 10 ELSE 15 END")
def p6(s, d):
    """The first laws and ordinances of each language."""
    from lexmill.operators.retrieve import split_laws

    docs = table(s, d, "documents").select("lang", "doc_id", F.when(F.col("text").contains("sch"), "Verordnung").otherwise("Gesetz").alias("sr_name"), F.col("doc_id").alias("rank"))
    return split_laws(docs, by="lang").select("lang", "doc_id", "is_ordinance", "rank")


@query("p8_p9_name_filters", "SELECT url FROM pages WHERE url LIKE '%/en/%' AND url NOT LIKE 'http://%'")
def p8(s, d):
    return table(s, d, "pages").where(F.col("url").contains("/en/") & ~F.col("url").startswith("http://")).select("url")


@query("p11_p12_payload", "SELECT doc_id, CAST(doc_id AS VARCHAR) || '_chunk_0' AS chunk_id, lang AS language, left(text, 200) AS text_preview, n_chars > 5000 AS is_partial, CAST([] AS VARCHAR[]) AS citations FROM documents WHERE length(text) >= 50")
def p11(s, d):
    return table(s, d, "documents").where(F.length("text") >= 50).select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_0")).alias("chunk_id"), F.col("lang").alias("language"), F.substring("text", 1, 200).alias("text_preview"), (F.col("n_chars") > 5000).alias("is_partial"), F.expr("cast(array() as array<string>)").alias("citations"))


@query("p15_p16_k7_review_pivot", "SELECT doc_id, max(v) FILTER (f = 'quality') AS quality, max(v) FILTER (f = 'toxic') AS toxic FROM (SELECT doc_id, 'quality' AS f, CASE WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS v FROM labels UNION ALL SELECT doc_id, 'toxic', CASE WHEN toxic = 1 THEN 'Yes' ELSE 'No' END FROM labels WHERE toxic IS NOT NULL) GROUP BY doc_id")
def p15(s, d):
    yes = lambda c: F.when(F.col(c) == 1, "Yes").otherwise("No")
    cells = table(s, d, "labels").select("doc_id", F.explode(F.create_map(F.lit("quality"), yes("quality"), F.lit("toxic"), F.when(F.col("toxic").isNotNull(), yes("toxic")))).alias("f", "v"))
    return tables.pivoted(cells, "doc_id", "f", "v", ["quality", "toxic"])


@query("p18_j8_active_sessions", "SELECT event_id, user_id, c_name FROM events JOIN customer ON user_id = c_custkey WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' AND ts + INTERVAL 24 HOUR > TIMESTAMP '2024-01-20 00:00:00' AND c_acctbal > 0")
def p18(s, d):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    alive = table(s, d, "events").where((F.col("ts") <= now) & (F.col("ts") + F.expr("interval 24 hours") > now))
    users = table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), "c_name")
    return alive.join(users, "user_id").select("event_id", "user_id", "c_name")


@query("p21_point_lookup", "SELECT doc_id, lang, source FROM documents WHERE doc_id = 17")
def p21(s, d):
    return table(s, d, "documents").where("doc_id = 17").limit(1).select("doc_id", "lang", "source")


@query("p22_conversation_export", "SELECT conv_id, count(*) AS n, to_json(list({'role': role, 'n': length(text)} ORDER BY turn)) AS turns FROM conversations GROUP BY conv_id")
def p22(s, d):
    parts = F.array_sort(F.collect_list(F.struct("turn", F.struct("role", F.length("text").alias("n")).alias("x"))))
    return table(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.to_json(F.transform(parts, lambda p: p["x"])).alias("turns"))


@query("j1_j2_left_lookup_correct", "SELECT s_suppkey, CASE WHEN coalesce(n_name, '') <> '' AND coalesce(s_name, '') <> '' THEN n_name ELSE s_name END AS s_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def j1(s, d):
    new = table(s, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    filled = (F.coalesce("n_name", F.lit("")) != "") & (F.coalesce("s_name", F.lit("")) != "")
    return table(s, d, "supplier").join(new, "s_nationkey", "left").select("s_suppkey", F.when(filled, F.col("n_name")).otherwise(F.col("s_name")).alias("s_name"))


@query("j4_j5_containment_fallback", "SELECT b.item_id, min(d.doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def j4(s, d):
    """Substring containment: items are blocked by a piece of theirs, so no pair of unlike texts is made.

    A piece is 16 characters from a word's start. A document is keyed by all its pieces, an item by its
    first piece after a blank, which every text that contains the item has too. Only equal keys meet, and
    containment is checked. Items too short for a piece are sought by automata, in blocks.
    """
    from lexmill.functions.text import pieces

    docs = documents(s, d).select("doc_id", F.col("text").alias("t"))
    items = table(s, d, "benchmark").select("item_id", "text", F.xxhash64(F.get(pieces("text", inner=True), 0)).alias("k"), (F.size(pieces("text", inner=True)) > 0).alias("long"))
    # keys travel without texts; only candidates fetch theirs
    keyed = docs.select("doc_id", F.explode(F.array_distinct(F.transform(pieces("t"), lambda x: F.xxhash64(x)))).alias("k"))
    candidates = keyed.join(items.where("long").select("k", "item_id", "text"), "k").drop("k")
    hits = docs.join(candidates, "doc_id").where("contains(t, text)").select("item_id", "doc_id")
    short = many.containing(docs.select(F.col("doc_id").alias("id"), F.col("t").alias("text")), items.where("not long")).select("item_id", F.col("id").alias("doc_id"))
    return hits.unionByName(short).groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))


@query("j6_enrich_fallback", "SELECT d.doc_id, coalesce(nullif(b.text, ''), d.text) AS full_content FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id")
def j6(s, d):
    full = table(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("full"))
    return table(s, d, "documents").join(full, "doc_id", "left").select("doc_id", F.coalesce(F.nullif("full", F.lit("")), F.col("text")).alias("full_content"))


@query("j7_chunks_by_ids", "SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey IN (1, 5, 77, 1024)")
def j7(s, d):
    chunks = table(s, d, "lineitem").where(F.col("l_orderkey").isin(1, 5, 77, 1024))
    docs = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return chunks.join(docs, "l_orderkey").select("l_orderkey", "l_linenumber", "o_orderpriority").orderBy("l_orderkey", "l_linenumber")


@query("j10_user_firms", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'BUILDING'")
def j10(s, d):
    firms = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(s, d, "customer").where("c_mktsegment = 'BUILDING'").join(firms, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("j11_u3_skip_existing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j11(s, d):
    return tables.missing(table(s, d, "documents").select("doc_id"), table(s, d, "labels"), "doc_id")


@query("j16_j17_code_lookup", "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON upper(replace('#sup-' || p_partkey % 1009, '#', '')) = upper('Sup-' || s_suppkey)")
def j16(s, d):
    """Every part's code, in another case and with a mark, in a registry of one row a code."""
    parts = table(s, d, "part").select("p_partkey", F.upper(F.replace(F.concat(F.lit("#sup-"), (F.col("p_partkey") % 1009).cast("string")), F.lit("#"), F.lit(""))).alias("k"))
    dim = table(s, d, "supplier").select("s_suppkey", F.upper(F.concat(F.lit("Sup-"), F.col("s_suppkey").cast("string"))).alias("k"))
    return parts.join(dim, "k").select("p_partkey", "s_suppkey")


@query("j18_cross_language", "SELECT a.doc_id AS a_id, b.doc_id AS b_id FROM documents a JOIN documents b ON a.doc_id // 8 = b.doc_id // 8 AND a.lang < b.lang")
def j18(s, d):
    """Versions of an article (here eight numbers in a row) in other languages: a group is as large as its number of versions."""
    docs = table(s, d, "documents").select("doc_id", F.expr("doc_id div 8").alias("article"), "lang")
    other = docs.select(F.col("doc_id").alias("b_id"), "article", F.col("lang").alias("b_lang"))
    return docs.join(other, "article").where("lang < b_lang").select(F.col("doc_id").alias("a_id"), "b_id")


@query("j19_w10_page_at", "WITH p AS (SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a, length(text) + 1 AS n FROM conversations) SELECT conv_id, 100 * k AS pos, turn AS page FROM p JOIN (SELECT unnest(range(0, (SELECT max(a + n) // 100 + 1 FROM p))) AS k) ON a <= 100 * k AND 100 * k < a + n")
def j19(s, d):
    """Every hundredth position of a conversation and the turn that holds it, by bins of positions."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("text") + 1
    pages = table(s, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.coalesce(F.sum(size).over(w), F.lit(0)).alias("char_start"), size.alias("n"))
    pages = pages.withColumn("char_end", F.col("char_start") + F.col("n"))
    ends = pages.groupBy("doc").agg(F.max("char_end").alias("end"))
    marks = ends.where("end > 0").select("doc", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(end - 1) div 100"))).alias("k")).select("doc", (F.col("k") * 100).alias("pos"))
    return review.page_at(marks, pages).select(F.col("doc").alias("conv_id"), "pos", "page")


@query("j20_field_cells", "SELECT l.doc_id, f.name AS field, CASE f.name WHEN 'quality' THEN l.quality WHEN 'toxic' THEN l.toxic END AS value FROM labels l, (VALUES ('quality'), ('toxic'), ('missing')) f(name)")
def j20(s, d):
    fields = ["quality", "toxic", "missing"]  # a preset's fields: few
    value = F.create_map(F.lit("quality"), F.col("quality"), F.lit("toxic"), F.col("toxic"))
    return table(s, d, "labels").select("doc_id", F.explode(F.array(*map(F.lit, fields))).alias("field"), value.alias("v")).select("doc_id", "field", F.try_element_at("v", F.col("field")).alias("value"))


@query("u1_u4_set_ops", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'only', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'all', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)")
def u1(s, d):
    a, b = table(s, d, "documents").select("doc_id"), table(s, d, "labels").select("doc_id")
    one = lambda k, x: x.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return one("both", a.intersect(b)).unionByName(one("only", a.subtract(b))).unionByName(one("all", a.union(b).distinct()))


@query("u5_u7_merge_first_source", "SELECT doc_id, arg_min(origin, p) AS origin FROM (SELECT doc_id, 'file' AS origin, 0 AS p FROM labels UNION ALL SELECT doc_id, 'memory', 1 FROM documents) GROUP BY doc_id")
def u7(s, d):
    rows = table(s, d, "labels").select("doc_id", F.lit("file").alias("origin"), F.lit(0).alias("p")).unionByName(table(s, d, "documents").select("doc_id", F.lit("memory").alias("origin"), F.lit(1).alias("p")))
    return rows.groupBy("doc_id").agg(F.min_by("origin", "p").alias("origin"))


@query("t6_t8_paged_list", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def t6(s, d):
    return table(s, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").offset(40).limit(20)


@query("t7_has_next_page", "SELECT count(*) > 20 AS has_next, min(doc_id) AS first_id, max(doc_id) FILTER (r <= 20) AS last_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents WHERE lang = 'en') WHERE r <= 21")
def t7(s, d):
    page = table(s, d, "documents").where("lang = 'en'").select("doc_id").orderBy("doc_id").limit(21)
    rows = page.withColumn("r", F.row_number().over(Window.orderBy("doc_id")))
    return rows.agg((F.count("*") > 20).alias("has_next"), F.min("doc_id").alias("first_id"), F.max(F.when(F.col("r") <= 20, F.col("doc_id"))).alias("last_id"))


@query("s21_t10_latest_version", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01' GROUP BY 1")
def t10(s, d):
    return table(s, d, "orders").where("o_orderdate <= timestamp_ntz'1998-01-01'").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("w11_last_turns", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4")
def w11(s, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(s, d, "conversations").select("conv_id", "turn").withColumn("r", F.row_number().over(w)).where("r <= 4").drop("r")


@query("w13_w16_sequence", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq FROM conversations")
def w13(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("seq"))


@query("k1_upsert_latest", "WITH n AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS v FROM events GROUP BY 1), o AS (SELECT c_custkey AS user_id, c_mktsegment AS v FROM customer) SELECT * FROM n UNION ALL SELECT * FROM o WHERE user_id NOT IN (SELECT user_id FROM n)")
def k1(s, d):
    old = table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("v"))
    new = table(s, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("v"))
    return old.join(new.select("user_id"), "user_id", "left_anti").unionByName(new)


@query("k1_k11_upsert_at_rest", "WITH n AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS v FROM events GROUP BY 1), o AS (SELECT c_custkey AS user_id, c_mktsegment AS v FROM customer) SELECT * FROM n UNION ALL SELECT * FROM o WHERE user_id NOT IN (SELECT user_id FROM n)")
def k1_at_rest(s, d):
    """The same into a table of buckets, twice: the second run changes nothing."""
    path = f"{shared_dir(s)}/table-{uuid.uuid4().hex}"
    tables.create(table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("v"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("long").alias("event_id")), path, "user_id", 16)
    for _ in range(2):
        new = table(s, d, "events").select("user_id", F.col("event_type").alias("v"), "ts", "event_id")
        last = new.groupBy("user_id").agg(F.max_by(F.struct("v", "ts", "event_id"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.*")
        tables.upsert_at_rest(last, path, "user_id", "ts", 16)
    return tables.at_rest(s, path).select("user_id", "v")


RANKS = "CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 99 END"


@query("a16_a17_registry_names", f"""
WITH e AS (SELECT p_brand AS sr_number, ['de', 'fr', 'it'][1 + p_partkey % 3] AS language, arg_max(p_name, (-({RANKS}), p_partkey)) AS name FROM part GROUP BY 1, 2)
SELECT sr_number, language, name FROM e""")
def a16_names(s, d):
    """Of each number and language the name with the best status: in force, then repealed, then unknown."""
    part = table(s, d, "part").withColumns({"language": F.get(F.array(F.lit("de"), F.lit("fr"), F.lit("it")), (F.col("p_partkey") % 3).cast("int")), "status": F.when(F.col("p_size") % 4 == 0, "in force").when(F.col("p_size") % 4 == 1, "repealed").when(F.col("p_size") % 4 == 2, "odd")})
    got = tables.registry(part, "p_brand", "language", "p_name", "status", "p_partkey", {"in force": 0, "repealed": 3})
    return got.select(F.col("p_brand").alias("sr_number"), F.explode("names").alias("language", "name"))


@query("a16_inverse_index", "SELECT p_type AS code, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS numbers FROM part GROUP BY 1")
def a16_inverse(s, d):
    return tables.inverse(table(s, d, "part"), "p_brand", "p_type").select(F.col("p_type").alias("code"), F.array_join("numbers", ",").alias("numbers"))


@query("k10_k12_replace_group", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, 1, 0.0 FROM orders WHERE o_orderkey % 7 = 0")
def k12(s, d):
    old = tables.delete(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), F.col("l_orderkey") % 7 == 0)
    new = table(s, d, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(0.0).alias("l_quantity"))
    return tables.replace_group(old, new, "l_orderkey")


@query("k13_k15_conditional_update", "SELECT s_suppkey, CASE WHEN s_nationkey = 3 AND s_acctbal > 0 THEN 'fixed' ELSE s_name END AS s_name FROM supplier")
def k13(s, d):
    return tables.set_where(table(s, d, "supplier"), F.expr("s_nationkey = 3 and s_acctbal > 0"), {"s_name": F.lit("fixed")}).select("s_suppkey", "s_name")


@query("k20_j22_patch", "SELECT s_suppkey, coalesce(n_name, s_name) AS s_name FROM supplier LEFT JOIN nation ON s_suppkey = n_nationkey")
def k20(s, d):
    fixes = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("s_suppkey"), F.col("n_name").alias("s_name"))
    return tables.patched(table(s, d, "supplier").select("s_suppkey", "s_name"), fixes, "s_suppkey")


@query("f69_cost", "SELECT event_id, round(event_id / 1e6 * 3.0 + user_id / 1e6 * 15.0, 6) AS cost FROM events")
def f69(s, d):
    return table(s, d, "events").select("event_id", text.cost("event_id", "user_id", 3.0, 15.0).alias("cost"))


@query("f80_f83_json_props", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def f83(s, d):
    return table(s, d, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k")).groupBy("event_type").agg(F.sum("k").alias("k"))


@query("f61_f62_recency", "SELECT o_orderkey, round((greatest(1900, least(2026, year(o_orderdate))) - 1900) / 126.0, 6) AS recency FROM orders")
def f61(s, d):
    return table(s, d, "orders").select("o_orderkey", F.round(vector.recency(F.year("o_orderdate"), 2026), 6).alias("recency"))
