"""Text functions, parsing, chunking and personal data over documents and pages (F*, C*, X*, S*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import pii, text, vocab
from lexmill.operators import chunk
from lexmill.plans.registry import documents, pages, query, table


def sql(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def either(words, c="t") -> str:
    return "(" + " OR ".join(f"contains({c}, {sql(w)})" for w in words) + ")"


def case(table_: dict, c="t", default="NULL") -> str:
    return "CASE " + " ".join(f"WHEN {either(ws, c)} THEN {sql(k)}" for k, ws in table_.items()) + f" ELSE {default} END"




SQUEEZED = r"trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g'))"
LAST_BLANK = "(length({c}) - instr(reverse({c}), ' '))"


@query("f5_preview_batch", f"WITH p AS (SELECT doc_id, {SQUEEZED} AS s FROM documents), q AS (SELECT *, left(s, 500) AS c FROM p) SELECT doc_id, CASE WHEN length(s) <= 500 THEN s WHEN contains(c, ' ') AND {LAST_BLANK.format(c='c')} > 250 THEN left(c, {LAST_BLANK.format(c='c')}) || '...' ELSE c || '...' END AS preview FROM q")
def f5(s, d):
    return documents(s, d).select("doc_id", text.preview_batch("text").alias("preview"))


@query("f6_preview_decision", f"WITH q AS (SELECT doc_id, left({SQUEEZED}, 200) AS c FROM documents) SELECT doc_id, CASE WHEN length(c) < 200 THEN c WHEN contains(c, ' ') THEN left(c, {LAST_BLANK.format(c='c')}) || '...' ELSE c || '...' END AS preview FROM q")
def f6(s, d):
    return documents(s, d).select("doc_id", text.preview_decision("text").alias("preview"))


@query("f7_preview_law", f"SELECT doc_id, left({SQUEEZED}, 200) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END AS preview FROM documents")
def f7(s, d):
    return documents(s, d).select("doc_id", text.preview_law("text").alias("preview"))


@query("f2_document_key", "SELECT p_partkey, coalesce(CASE WHEN p_size < 10 THEN p_brand END, CASE WHEN p_size < 20 THEN upper(replace(p_name, ' ', '-')) END, CASE WHEN p_size < 30 THEN p_type END, CAST(p_partkey AS VARCHAR)) AS doc_key FROM part")
def f2(s, d):
    at = lambda n, c: F.when(F.col("p_size") < n, F.col(c)).otherwise("")
    return table(s, d, "part").select("p_partkey", text.document_key(at(10, "p_brand"), at(20, "p_name"), at(30, "p_type"), F.lit(""), F.col("p_partkey").cast("string")).alias("doc_key"))


def count_of(words):
    return " + ".join(f"CAST(contains(lower(text), {sql(w)}) AS INT)" for w in words)


@query("f4_query_context", f"SELECT doc_id, CASE WHEN it > fr AND it > de AND it >= 2 THEN 'it' WHEN fr > it AND fr > de AND fr >= 2 THEN 'fr' WHEN de > 0 THEN 'de' END AS language, {case({k: [k] for k in vocab.CANTONS}, 'lower(text)')} AS place FROM (SELECT *, {count_of(vocab.MARKERS['it'])} AS it, {count_of(vocab.MARKERS['fr'])} AS fr, {count_of(vocab.MARKERS['de'])} AS de FROM documents)")
def f4(s, d):
    place = text.first_key(F.lower("text"), {k: [k] for k in vocab.CANTONS})
    return documents(s, d).select("doc_id", text.query_language("text").alias("language"), place.alias("place"))


@query("f8_f9_clean_values")
def f8(s, d):
    return documents(s, d).select("doc_id", text.clean_federal("text").alias("federal"), text.join_lines("text").alias("ticino"))


@query("f10_clean_law", r"SELECT doc_id, array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '^\d+\s*$', '', 'gm'), '(Art\.\s*\d{1,4}[a-z]?(?:bis|ter|quater|quinquies)?)(\d{3,})', '\1', 'g'), '  +', ' ', 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), chr(10)) AS cleaned FROM documents")
def f10(s, d):
    return documents(s, d).select("doc_id", text.clean_law("text").alias("cleaned"))


@query("f13_law_type", "SELECT p_partkey, CASE WHEN p_partkey < 100 THEN 'international' WHEN p_partkey < 200 THEN 'constitutional' WHEN p_partkey < 300 THEN 'civil' WHEN p_partkey < 400 THEN 'criminal' WHEN p_partkey < 500 THEN 'education' WHEN p_partkey < 600 THEN 'defense' WHEN p_partkey < 700 THEN 'finance' WHEN p_partkey < 800 THEN 'infrastructure' WHEN p_partkey < 900 THEN 'social' WHEN p_partkey < 1000 THEN 'economic' ELSE 'other' END AS law_type FROM part")
def f13(s, d):
    return table(s, d, "part").select("p_partkey", text.law_type(F.concat(F.col("p_partkey").cast("string"), F.lit(".0"))).alias("law_type"))


@query("f14_domain", f"SELECT doc_id, {case(vocab.DOMAINS, 'lower(text)', sql('general'))} AS domain FROM documents")
def f14(s, d):
    return documents(s, d).select("doc_id", text.domain("text").alias("domain"))


@query("f15_hierarchy_path", "SELECT p_partkey, concat_ws(' > ', p_name, CASE WHEN p_size < 20 THEN p_type END, p_brand, 'Art. ' || p_size) AS path FROM part")
def f15(s, d):
    none = F.lit(None).cast("string")
    return table(s, d, "part").select("p_partkey", text.hierarchy_path("p_name", F.when(F.col("p_size") < 20, F.col("p_type")), F.col("p_brand"), none, none, F.col("p_size").cast("string")).alias("path"))


OFFICIAL = r"(?i)(?:BGE|ATF|DTF)\s+(\d+)\s+([IV]+)\s+(\d+)"
F19_SQL = rf"""
WITH c AS (
  SELECT doc_id, list_zip(regexp_extract_all(text, '{OFFICIAL}', 1), regexp_extract_all(text, '{OFFICIAL}', 2), regexp_extract_all(text, '{OFFICIAL}', 3)) AS official,
    regexp_extract_all(text, '(?i)(?:BVGE|ATAF)\s+(\d{{4}}/\d+)', 1) AS admin, regexp_extract_all(text, '(?i)\b([A-Z0-9]+[\-_.]\d+/\d{{4}})\b', 1) AS files
  FROM documents)
SELECT doc_id, list_sort(list_distinct(list_transform(official, lambda x: concat_ws(' ', 'BGE', x[1], x[2], x[3])) || list_transform(admin, lambda x: 'BVGE ' || x) || list_transform(files, lambda x: upper(x)))) AS cases FROM c
"""


@query("f19_case_citations", F19_SQL)
def f19(s, d):
    return documents(s, d).select("doc_id", text.case_citations("text").alias("cases"))


@query("f21_outcome", f"SELECT doc_id, {case(vocab.OUTCOMES, 'lower(right(text, 3000))', sql('unknown'))} AS outcome FROM documents")
def f21(s, d):
    return documents(s, d).select("doc_id", text.outcome("text").alias("outcome"))


@query("f28_f30_names", "SELECT url, CASE WHEN contains(upper(url), 'BGE') OR contains(upper(url), 'ATF') THEN 'CH_BGE' WHEN contains(upper(url), 'BGER') THEN 'CH_BGer' WHEN contains(upper(url), 'BVGE') OR contains(upper(url), 'ATAF') THEN 'CH_BVGE' WHEN contains(upper(url), 'BSTG') OR contains(upper(url), 'TPF') THEN 'CH_BStGer' ELSE 'CH_FED' END AS court, CASE WHEN starts_with(url, 'CH_TI') OR contains(url, 'TI_') THEN 'ticino' ELSE 'federal' END AS source FROM pages")
def f28(s, d):
    return table(s, d, "pages").select("url", text.court("url").alias("court"), text.source_of("url").alias("source"))


F37_SQL = f"""
WITH q AS (SELECT doc_id, {SQUEEZED} AS s FROM documents),
r AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN substring(s, length(s) // 2 + 1, 40) WHEN 1 THEN substring(s, length(s) // 2 + 1, 60) || ' #' ELSE '# ' || left(s, 10) END AS quote FROM q),
t AS (SELECT *, trim(regexp_replace(quote, ' +', ' ', 'g')) AS q FROM r),
u AS (SELECT *, length(q) AS n, CASE WHEN instr(lower(s), lower(q)) > 0 THEN instr(lower(s), lower(q)) ELSE instr(lower(s), lower(left(q, 50))) END AS hit FROM t),
p AS (SELECT *, greatest(hit - 200, 1) AS a, least(hit + n + 200, length(s) + 1) AS e FROM u)
SELECT doc_id, CASE WHEN n > 0 AND hit > 0 THEN (CASE WHEN a > 1 THEN '...' ELSE '' END) || substring(s, a, e - a) || (CASE WHEN e <= length(s) THEN '...' ELSE '' END) ELSE '' END AS context FROM p
"""


@query("f37_context_around", F37_SQL)
def f37(s, d):
    """Each text with a quote from its middle: exact, with a changed end, or absent."""
    docs = documents(s, d).withColumn("s", text.squeeze("text"))
    middle = lambda n: F.substring("s", F.floor(F.length("s") / 2).cast("int") + 1, F.lit(n))
    which = F.col("doc_id") % 3
    quote = F.when(which == 0, middle(40)).when(which == 1, F.concat(middle(60), F.lit(" #"))).otherwise(F.concat(F.lit("# "), F.substring("s", 1, 10)))
    return docs.select("doc_id", text.context_around(F.col("text"), quote).alias("context"))


@query("f38_f41_names_and_prompts", "SELECT s_suppkey, left(regexp_replace(s_name, '[^A-Za-z0-9]', '_', 'g'), 50) || '_20240131.xlsx' AS file, '- ' || s_name || ' (one of: a, b): x' AS prompt FROM supplier")
def f38(s, d):
    return table(s, d, "supplier").select("s_suppkey", text.file_name("s_name", F.lit("2024-01-31").cast("date")).alias("file"), text.prompt_field("s_name", F.lit("enum"), F.lit("x"), F.array(F.lit("a"), F.lit("b"))).alias("prompt"))


MONTH_SQL = "CASE " + " ".join(f"WHEN lower(g.m) IN ({', '.join(map(sql, names))}) THEN '{k:02d}'" for k, names in enumerate(vocab.MONTHS, 1)) + r" WHEN regexp_matches(g.m, '^\d+$') THEN lpad(g.m, 2, '0') END"
F50_SQL = rf"""
WITH m AS (SELECT doc_id, regexp_extract(text, '(\d{{1,2}})\.?\s+(\d{{1,2}}|[a-zA-Zäöüéà]+)\.?\s+(\d{{4}})', ['d', 'm', 'y']) AS g FROM documents)
SELECT doc_id, CASE WHEN g.y <> '' THEN g.y || '-' || {MONTH_SQL} || '-' || lpad(g.d, 2, '0') END AS date FROM m
"""


@query("f50_date", F50_SQL)
def f50(s, d):
    return documents(s, d).select("doc_id", text.date_of("text").alias("date"))


HEAD, GAP = "chr(10) || '## '", "chr(10) || chr(10)"
F70_SQL = f"""
WITH c AS (SELECT *, left(text, 600) AS c FROM documents),
l AS (SELECT *, CASE WHEN contains(c, {HEAD}) THEN 600 - instr(reverse(c), reverse({HEAD})) - 3 ELSE 0 END AS h, CASE WHEN contains(c, {GAP}) THEN 600 - instr(reverse(c), {GAP}) - 1 ELSE 0 END AS g FROM c)
SELECT doc_id, length(text) // 4 AS tokens, CASE WHEN length(text) <= 600 THEN text ELSE left(c, CASE WHEN h > 300 THEN h WHEN g > 420 THEN g ELSE 600 END) || chr(10) || chr(10) || '[...]' END AS context FROM l
"""


@query("f68_f70_budget", F70_SQL)
def f70(s, d):
    return documents(s, d).select("doc_id", text.estimate_tokens("text").alias("tokens"), text.truncate_context("text", 600).alias("context"))


@query("f84_f85_ids_and_hashes", "SELECT doc_id, left(sha256(text), 16) AS hash FROM documents")
def f85(s, d):
    return documents(s, d).select("doc_id", text.file_hash(F.encode("text", "UTF-8")).alias("hash"))


@query("f86_sparse_vectors", "SELECT event_id, CAST(user_id AS INT) AS token, value AS weight FROM events WHERE value > 5")
def f86(s, d):
    raw = table(s, d, "events").select("event_id", F.create_map(F.col("user_id").cast("string"), F.col("value"), F.lit("word"), F.lit(1.0)).alias("m"))
    kept = F.map_filter("m", lambda k, v: k.try_cast("int").isNotNull() & (v > 5))
    return raw.select("event_id", F.explode(kept).alias("token", "weight")).select("event_id", F.col("token").cast("int").alias("token"), "weight")


@query("p7_text_fallback", "SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderstatus END, ''), nullif(o_orderpriority, ''), '') AS body FROM orders")
def p7(s, d):
    return table(s, d, "orders").select("o_orderkey", text.first_filled(F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderstatus")), "o_orderpriority").alias("body"))


@query("p13_p14_validity", "SELECT url, length(url) >= 40 AS long_enough, regexp_matches(url, '[0-9]') AND length(url) >= 5 AS id_ok FROM pages")
def p14(s, d):
    return table(s, d, "pages").select("url", (F.length("url") >= 40).alias("long_enough"), text.display_id_ok("url").alias("id_ok"))


@query("a23_document_language", "WITH w AS (SELECT doc_id, regexp_extract_all(left(lower(text), 5000), '[\\p{L}\\p{N}_]+') AS w FROM documents), n AS (SELECT doc_id, " + ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(map(sql, v))}))) AS {k}" for k, v in vocab.STOP_WORDS.items()) + " FROM w) SELECT doc_id, CASE WHEN fr > de AND fr >= it THEN 'fr' WHEN it > de AND it > fr THEN 'it' ELSE 'de' END AS language FROM n")
def a23(s, d):
    return documents(s, d).select("doc_id", text.document_language("text").alias("language"))


@query("s4_s5_html_to_text")
def s4(s, d):
    return pages(s, d).select("page_id", text.html_to_text("html").alias("text"))


@query("s19_logged_files", r"SELECT DISTINCT unnest(regexp_extract_all(html, 'href=\"/([A-Za-z]+)\"', 1)) AS file FROM pages")
def s19(s, d):
    return table(s, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="/([A-Za-z]+)"'), F.lit(1))).alias("file")).distinct()


WORDS = r"len(list_filter(regexp_split_to_array({c}, '\s+'), lambda x: x <> ''))"
C1_SQL = r"""
WITH RECURSIVE p AS (
  SELECT doc_id, text, CASE WHEN %s <= 100 THEN [text] ELSE regexp_split_to_array(text, '\n\n+|\n') END AS a FROM documents),
e AS (SELECT doc_id, len(a) AS m, unnest(a) AS s, generate_subscripts(a, 1) AS i FROM p),
c AS (SELECT *, %s AS n FROM e),
w AS (
  SELECT doc_id, m, i, n, n AS run, 1 AS chunk FROM c WHERE i = 1
  UNION ALL
  SELECT c.doc_id, c.m, c.i, c.n, CASE WHEN w.run + c.n > 100 THEN c.n ELSE w.run + c.n END, CASE WHEN w.run + c.n > 100 THEN w.chunk + 1 ELSE w.chunk END
  FROM w JOIN c ON c.doc_id = w.doc_id AND c.i = w.i + 1),
g AS (SELECT doc_id, chunk, CAST(sum(n) AS BIGINT) AS n_words FROM w GROUP BY 1, 2)
SELECT doc_id, chunk - 1 AS chunk_index, n_words FROM g
""" % (WORDS.format(c="text"), WORDS.format(c="s"))


@query("c1_pack_paragraphs", C1_SQL)
def c1(s, d):
    packed = chunk.whole_or(F.col("text"), 100, chunk.pack(F.split("text", r"\n\n+|\n"), 100, 0, "\n"))
    rows = documents(s, d).select("doc_id", F.posexplode(packed).alias("chunk_index", "c"))
    return rows.select("doc_id", "chunk_index", chunk.n_words(F.col("c")).alias("n_words"))


@query("c2_c3_chunk_decision")
def c3(s, d):
    docs = documents(s, d).select("doc_id", F.coalesce(text.regeste("text"), F.lit("")).alias("regeste"), F.col("text").alias("reasoning"))
    return chunk.chunk_sections(docs, "doc_id", ["regeste", "reasoning"], 200, 50)


@query("c4_chunk_dossier")
def c4(s, d):
    return documents(s, d).select("doc_id", F.posexplode(chunk.chunk_dossier(F.col("text"), 200)).alias("chunk_index", "text"))


@query("c5_c7_char_windows")
def c5(s, d):
    docs = documents(s, d).select("doc_id", "text")
    both = docs.select("doc_id", F.explode(F.create_map(F.lit("embed"), chunk.chunk_chars(F.col("text")), F.lit("extract"), chunk.chunk_for_extraction(F.col("text")))).alias("kind", "b"))
    return both.select("doc_id", "kind", F.posexplode("b").alias("chunk_index", "x")).select("doc_id", "kind", "chunk_index", F.col("x.start").alias("start"), F.col("x.end").alias("end"))


@query("w8_w9_line_spans", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) SELECT doc_id, i AS line_no, lead(i, 1, i + 1) OVER (PARTITION BY doc_id ORDER BY i) AS end_line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS ahead FROM l")
def w8(s, d):
    from pyspark.sql import Window

    rows = documents(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    return rows.select("doc_id", "line_no", F.coalesce(F.lead("line_no").over(w), F.col("line_no") + 1).alias("end_line"), F.lead("line").over(w).alias("ahead"))



def pii_hits() -> str:
    """SQL: every pattern's matches h and the pieces g between them, of each text."""
    one = "SELECT r, text, {t} AS entity_type, {s} AS base, {c} AS context, regexp_extract_all(text, {p}) AS h, string_split_regex(text, {p}) AS g FROM texts WHERE regexp_matches(text, {p})"
    words = lambda t: f"[{', '.join(sql(f' {w} ') for w in vocab.PII_CONTEXT.get(t, []))}]::VARCHAR[]"
    return " UNION ALL ".join(one.format(t=sql(t), s=f"CAST({s} AS DOUBLE)", p=sql(p), c=words(t)) for t, p, s in vocab.PII)


#: The kept spans of each document, by start: a fold takes them from the best on, unless they meet one that was taken.
PII_SPANS = rf"""
texts AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
hits AS ({pii_hits()}),
ends AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM hits),
placed AS (SELECT r, text, entity_type, base, context, length(h[i]) AS n, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1 : i - 1], lambda x: length(x))), 0) AS pos FROM ends),
told AS (SELECT *, ' ' || array_to_string(regexp_extract_all(lower(substr(text, greatest(1, CAST(pos AS BIGINT) - 199), least(200, CAST(pos AS BIGINT)))), '[\p{{L}}\p{{N}}_]+')[-5:], ' ') || ' ' AS before FROM placed),
scored AS (SELECT r, CAST(pos AS INT) AS "start", CAST(pos + n AS INT) AS "end", entity_type, CASE WHEN len(list_filter(context, lambda w: contains(before, w))) > 0 THEN least(1.0, round(base + 0.35, 9)) ELSE base END AS score FROM told),
listed AS (SELECT r, list({{'entity_type': entity_type, 'start': "start", 'end': "end", 'score': score}} ORDER BY score DESC, "end" - "start" DESC, "start", entity_type) AS l FROM scored GROUP BY r),
kept AS (SELECT r, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda k: k['start'] < x[1]['end'] AND x[1]['start'] < k['end'])) > 0 THEN a ELSE list_concat(a, x) END) AS s FROM listed),
spans AS (SELECT texts.r, doc_id, text, coalesce(list_sort(list_transform(s, lambda x: {{'start': x['start'], 'end': x['end'], 'entity_type': x['entity_type'], 'score': x['score']}})), []) AS s FROM texts LEFT JOIN kept USING (r))
"""


def pii_masked(form: str) -> str:
    """SQL: the text with its spans replaced."""
    head, tail = map(sql, form.split("{entity_type}"))
    pieces = f"list_transform(s, lambda x, i: substr(text, 1 + coalesce(s[i - 1]['end'], 0), x['start'] - coalesce(s[i - 1]['end'], 0)) || {head} || x['entity_type'] || {tail})"
    return f"CASE WHEN len(s) = 0 THEN text ELSE array_to_string({pieces}, '') || substr(text, 1 + s[len(s)]['end']) END"


@query("x1_x6_pii_detect", f"WITH {PII_SPANS} SELECT doc_id, x['entity_type'] AS entity_type, substr(text, x['start'] + 1, x['end'] - x['start']) AS text, x['start'] AS \"start\", x['end'] AS \"end\", x['score'] AS score FROM (SELECT doc_id, text, unnest(s) AS x FROM spans)")
def x6(s, d):
    """Every kept span with its place and score."""
    return pii.detect(documents(s, d), "doc_id", "text")


@query("x7_pii_scrub", f"WITH {PII_SPANS} SELECT doc_id, {pii_masked('<{entity_type}>')} AS scrubbed FROM spans")
def x7(s, d):
    return pii.scrubbed(documents(s, d), "text", "scrubbed").select("doc_id", "scrubbed")


@query("x8_x9_pii_summary", f"WITH {PII_SPANS} SELECT x['entity_type'] AS entity_type, count(*) AS n FROM (SELECT unnest(s) AS x FROM spans) GROUP BY 1")
def x9(s, d):
    return pii.summary(documents(s, d), "doc_id", "text")


@query("a28_pii_types", f"WITH {PII_SPANS} SELECT doc_id, len(s) > 0 AS has_pii, list_sort(list_distinct(list_transform(s, lambda x: x['entity_type']))) AS types FROM spans")
def a28(s, d):
    rows = documents(s, d).select("doc_id", pii.found(F.col("text")).alias("spans"))
    return rows.select("doc_id", (F.size("spans") > 0).alias("has_pii"), pii.kinds(F.col("spans")).alias("types"))
