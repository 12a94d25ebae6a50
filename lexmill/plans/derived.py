"""Queries whose inputs expressions make of the given tables: ids, questions, statutes, judgments, answers, file names.

(F1, F3, F11, F12, F16-F18, F20, F22-F24, F26, F30, F32, F33, F36, F40, F51, F55, F80, F81, F84, R13, S7, S18, S25, C6, W7-W9.)
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import bench, prompts, text, vocab
from lexmill.operators import articles, retrieve
from lexmill.plans.registry import documents, query, table
from lexmill.plans.retrieval import FUSED, asked, asked_tokens, best, points, vectors
from lexmill.plans.texts import sql
from lexmill.sources import parsers, readers
from lexmill.sources.shared import landed, shared_dir

S = F.expr


@query("f1_normalize_decision_id", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'BGE-' || doc_id || '-IA-' || n_chars WHEN 1 THEN upper('BGer-' || source || '-1C-' || doc_id) || '-' || upper(coalesce(lang, '')) WHEN 2 THEN upper(source) || '-' || n_chars ELSE upper(source) || '--' || doc_id END AS id FROM documents
""")
def f1(s, d):
    """Ids of four shapes: with a chunk's suffix, with blanks (doubled ones, too), padded, with three hyphens."""
    raw = S("""CASE doc_id % 4 WHEN 0 THEN 'BGE-' || doc_id || '-IA-' || n_chars || '_chunk_' || doc_id % 7 WHEN 1 THEN 'BGer ' || source || ' 1C-' || doc_id || '  ' || coalesce(lang, '') || ' chunk ' || n_chars
        WHEN 2 THEN '  ' || source || '  ' || n_chars || ' ' ELSE source || '---' || doc_id END""")
    return table(s, d, "documents").select("doc_id", text.normalize_decision_id(raw).alias("id"))


TRIGGERS = list(vocab.EXPANSIONS)
EXPANDED = " || ".join(f"CASE WHEN contains(lower(q), {sql(k)}) THEN [{', '.join(map(sql, v.split()))}] ELSE [] END" for k, v in vocab.EXPANSIONS.items())


@query("f3_expand_query", f"""
WITH t AS (SELECT [{', '.join(map(sql, TRIGGERS))}] AS k),
r AS (SELECT conv_id, turn, coalesce(text, '') || CASE WHEN turn % 3 = 2 THEN '' ELSE ' ' || upper(k[1 + (conv_id + turn) % {len(TRIGGERS)}]) || '?' END AS q FROM conversations, t),
e AS (SELECT conv_id, turn, q, {EXPANDED} AS l FROM r)
SELECT conv_id, turn, CASE WHEN len(l) = 0 THEN q ELSE q || ' ' || array_to_string(list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE list_concat(a, x) END), ' ') END AS expanded FROM e
""")
def f3(s, d):
    """Every turn as a question; two of three mention a trigger, in capitals."""
    keys = F.array(*map(F.lit, TRIGGERS))
    more = F.concat(F.lit(" "), F.upper(F.get(keys, ((F.col("conv_id") + F.col("turn")) % len(TRIGGERS)).cast("int"))), F.lit("?"))
    rows = table(s, d, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 3 == 2, "").otherwise(more)).alias("q"))
    return rows.select("conv_id", "turn", text.expand_query("q").alias("expanded"))


@query("f11_f12_law_text", """
SELECT doc_id, 'Bundesgesetz Nr. ' || doc_id AS name, 'SR ' || doc_id || chr(10) || chr(10) || 'Bundesgesetz Nr. ' || doc_id || chr(10) || 'Art. ' || doc_id % 1000 || ' Zweck' AS law, 'Absatz ' || n_chars || ' hier.' || chr(10) || chr(10) || 'weiter' AS article FROM documents
""")
def f11(s, d):
    """The name, the cleaned text and a cleaned article of a law that each document numbers: page lines, raised digits, notes, a closing reference."""
    law = S(r"'SR ' || doc_id || '\n\n\n\n' || doc_id % 90 || '\n12 / 40\nBundesgesetz Nr. ' || doc_id || '\nArt.  ' || doc_id % 1000 || '756 Zweck  '")
    named = S(r"'SR\n12 / 40\n1.2\nBundesgesetz Nr. ' || doc_id || '\nArt. 1'")
    article = S(r"'Absatz¹² ' || n_chars || ' hier.\n\n\n\nweiter\nEingefügt durch Ziff. ' || doc_id || '\nSR ' || doc_id || '.1 '")
    cleaned = F.regexp_replace(text.clean_law(law), r"\n12 / 40", "")
    return table(s, d, "documents").select("doc_id", text.law_name(named).alias("name"), F.regexp_replace(cleaned, r"\n{3,}", "\n\n").alias("law"), text.clean_article(article).alias("article"))


@query("f16_f17_article_refs", """
SELECT o_orderkey, list_sort(list_distinct([o_custkey || 'a', o_orderkey || 'bis', CAST(o_custkey AS VARCHAR)])) AS refs,
  'SR_' || o_orderkey || '_' || o_custkey % 10 || '_Art_' || o_custkey || 'a' || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '_p' || o_orderkey % 5 END || '_de' AS id FROM orders
""")
def f16(s, d):
    body = S("'Art. ' || o_custkey || 'a und Art.' || o_orderkey || 'bis, Art. ' || o_custkey || 'a; Art. ' || o_custkey || ' ' || o_orderpriority")
    part = S("CASE WHEN o_orderkey % 2 <> 0 THEN o_orderkey % 5 END")
    number = S("o_orderkey || '.' || o_custkey % 10")
    return table(s, d, "orders").select("o_orderkey", text.article_refs(body).alias("refs"), text.article_id(number, S("o_custkey || 'a'"), part, F.lit("de")).alias("id"))


#: Three words of a text as names, in Spark and in DuckDB.
NAMES = "transform(slice(concat(array_distinct(regexp_extract_all(text, '[a-z]{4,12}', 0)), array('arnold', 'berger', 'conrad')), 1, 3), x -> concat(upper(left(x, 1)), substring(x, 2)))"
NAMES_SQL = "list_transform((list_reduce(list_transform(regexp_extract_all(coalesce(text, ''), '[a-z]{4,12}') || ['arnold', 'berger', 'conrad'], lambda x: [x]), lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE list_concat(a, x) END))[:3], lambda x: upper(x[1]) || x[2:])"


@query("f22_f23_judges", f"""
WITH n AS (SELECT doc_id, {NAMES_SQL} AS n FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN n WHEN 1 THEN [n[1] || ' ' || n[2]] WHEN 2 THEN n ELSE [] END AS judges, n AS cantonal FROM n
""")
def f22(s, d):
    """Benches of all documents: under a heading, one judge alone, a list after the role, none; and the cantonal form."""
    rows = documents(s, d).select("doc_id", S(NAMES.replace("(text", "(coalesce(text, '')")).alias("n"))
    told = S(r"""CASE doc_id % 4
        WHEN 0 THEN 'Besetzung\nBundesrichter ' || n[0] || ', Präsident,\nBundesrichterin Dr. ' || n[1] || ' und ' || n[2] || ',\nGerichtsschreiber Hug.\nParteien'
        WHEN 1 THEN 'La juge fédérale ' || n[0] || ' ' || n[1] || ' a statué.'
        WHEN 2 THEN 'Richter: ' || n[0] || ', ' || n[1] || '; Frau ' || n[2] || '\n\nSachverhalt'
        ELSE 'Richter sind hier keine genannt.' END""")
    cantonal = S(r"'La Camera, composta dai giudici:\n' || n[0] || ', presidente, ' || n[1] || ' e ' || n[2] || '\nsegretario: Rossi'")
    return rows.select("doc_id", bench.judges(told).alias("judges"), bench.cantonal_judges(cantonal).alias("cantonal"))


@query("f18_f30_parse_judgments", f"""
WITH n AS (SELECT doc_id, n_chars, {NAMES_SQL} AS n FROM documents)
SELECT doc_id, list_sort(list_distinct(['Art. ' || doc_id % 900 || ' OR', 'Art. ' || (doc_id % 900 + 1) || ' OR', 'Art. ' || (doc_id % 900 + 2) || 'a OR', 'Art. ' || n_chars || ' Abs. 2 STGB', 'Art. 7 SR ' || doc_id || '.1'])) AS laws,
  'Obergerichts ' || n[1] AS lower_court, CASE WHEN doc_id % 2 = 0 THEN '6B_' || doc_id || '/2020' ELSE '6B_' || doc_id || '_a' END AS case_id, 'TI_CATI_' || doc_id AS file_case, CAST(2000 + doc_id % 20 AS INT) AS file_year,
  'Kopf' AS regeste, 'Sachverhalt:' || chr(10) || n[1] || ' klagt.' AS facts, 'Erwägung:' || chr(10) || n[2] AS reasoning, 'Demnach erkennt das Gericht:' || chr(10) || n[3] || ' wird abgewiesen.' AS decision FROM n
""")
def f18(s, d):
    """Judgments composed from all documents: lists of articles with codes, the case's number (labelled or in brackets), the lower court, sections."""
    rows = documents(s, d).select("doc_id", "n_chars", S(NAMES.replace("(text", "(coalesce(text, '')")).alias("n"))
    label = S(r"CASE WHEN doc_id % 2 = 0 THEN 'Geschäftsnummer: 6B_' || doc_id || '/2020' ELSE 'Urteil vom 3. März 2020 (6B ' || doc_id || ' a)' END")
    cited = S("'Art. ' || doc_id % 900 || ', ' || (doc_id % 900 + 1) || ' und ' || (doc_id % 900 + 2) || 'a des OR; § ' || n_chars || ' Abs. 2 StGB. Art. 7 (SR ' || doc_id || '.1)'")
    lower = S("'Gegen das Urteil des Obergerichts ' || n[0] || ' vom 1. Mai 2019'")
    whole = S(r"'Kopf\nSachverhalt:\n' || n[0] || ' klagt.\nErwägung:\n' || n[1] || '\nDemnach erkennt das Gericht:\n' || n[2] || ' wird abgewiesen.'")
    name = S("'TI_CATI_' || doc_id || '_' || (2000 + doc_id % 20) || '-09-16'")
    return rows.select("doc_id", text.legal_citations(cited, vocab.CODES).alias("laws"), text.lower_court(lower).alias("lower_court"), text.case_id(label).alias("case_id"), text.case_id_of_file(name).alias("file_case"), text.year_of_id(name).alias("file_year"), text.sections(whole, F.lit("de")).alias("s")).select("*", "s.*").drop("s")


@query("f40_logged_names", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'CH_BGer/Zürich_' || page_id || '.html' WHEN 1 THEN 'ti/plain' || page_id || '.html' WHEN 2 THEN 'ti/bad\\u00zz' || page_id ELSE 'a/b' || page_id || '.html' END AS name FROM pages
""")
def f40(s, d):
    """Names as logs tell them: with escapes, bare and padded, with a broken escape, with a folder."""
    raw = F.concat(
        S("element_at(array('CH_BGer\\\\u002fZ\\\\u00fcrich_', ' plain', 'bad\\\\u00zz', 'a/b'), 1 + cast(page_id % 4 as int))"), F.col("page_id").cast("string"), S("element_at(array('.html', '.html ', '', '.html'), 1 + cast(page_id % 4 as int))")
    )
    return table(s, d, "pages").select("page_id", text.logged_name(raw, F.lit("ti")).alias("name"))


@query("f51_f55_years", """
SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 7 IN (0, 1) THEN 1950 + o_custkey % 70 WHEN o_orderkey % 7 < 5 THEN year(o_orderdate) ELSE 2000 END AS INT) AS year, CASE WHEN o_orderkey % 7 <> 6 THEN CAST(year(o_orderdate) AS INT) END AS id_year FROM orders
""")
def f51(s, d):
    """Years by their order of trust: metadata, the row, its date in two forms, the day of the decision, none, one out of range; and of ids."""
    at = lambda k, x: S(f"CASE WHEN o_orderkey % 7 = {k} THEN {x} END")
    year, iso, dotted = "cast(1950 + o_custkey % 70 as int)", "date_format(o_orderdate, 'yyyy-MM-dd')", "date_format(o_orderdate, 'dd.MM.yyyy')"
    date = F.coalesce(at(2, iso), at(3, dotted), at(5, "'9999-01-01'"))
    ids = S(f"CASE WHEN o_orderkey % 7 <> 6 THEN 'BGer 1C-' || o_custkey || ' ' || {iso} ELSE 'BGE ' || o_custkey END")
    return table(s, d, "orders").select("o_orderkey", text.year_of(at(0, year), at(1, year), date, at(4, iso), 2026).alias("year"), text.year_of_id(ids).alias("id_year"))


@query("f81_consistency", """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN CASE WHEN quality = 1 THEN 'MIXED' ELSE 'DIVERGENT' END WHEN 1 THEN 'DIVERGENT' WHEN 2 THEN 'CONSISTENT' WHEN 3 THEN 'MIXED' ELSE 'CONSISTENT' END AS verdict FROM labels
""")
def f81(s, d):
    """Answers to each label: fenced JSON, words in a sentence, bare JSON, neither, a broken fence with a word."""
    answer = S(r"""CASE doc_id % 5 WHEN 0 THEN 'So:\n```json\n{"consistency": "' || CASE WHEN quality = 1 THEN 'mixed' ELSE 'divergent' END || '"}\n``` and more' WHEN 1 THEN 'these are divergent, not consistent'
        WHEN 2 THEN '{"consistency": "consistent", "n": ' || doc_id || '}' WHEN 3 THEN 'no verdict' ELSE '```json\n{"consistency": \n``` all consistent' END""")
    return table(s, d, "labels").select("doc_id", text.consistency(answer).alias("verdict"))


@query("s25_sr_of_file", "SELECT p_partkey, p_size || CASE WHEN p_partkey % 2 = 0 THEN '.' || p_partkey ELSE '' END AS sr FROM part")
def s25(s, d):
    name = S("'SR_' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '_' || p_partkey ELSE '' END || element_at(array('_de', '_fr', '_it'), 1 + cast(p_partkey % 3 as int)) || '.pdf'")
    return table(s, d, "part").select("p_partkey", text.sr_of_file(name).alias("sr"))


#: A statute of each document: its sentences, every ninth under a title, every third an article, some with the heading below.
STATUTE = r"""transform(split(coalesce(text, ''), '[.\n]+'), (x, i) -> concat(
    case when i % 18 = 0 then concat(1 + i div 18, '. Teil: Teil ', i, '\n') when i % 9 = 0 then concat(i div 9, '. Titel: Titel ', i, '\n') else '' end,
    case when i % 6 = 0 then concat('Art. ', i, '\n', 'Von ', i, '\n', i, ' / 90\n') when i % 3 = 0 then concat('Art. ', i, 'a Zu ', i, '\n') else '' end, '1 ', trim(x)))"""
PLACES = r"""
l AS (SELECT doc_id, unnest(x) AS x, generate_subscripts(x, 1) - 1 AS i, len(x) AS n FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '[.\n]+') AS x FROM documents)),
a AS (SELECT doc_id, i, (i // 3) * 3 AS k, trim('1 ' || trim(x), ' ') AS line FROM l)
"""
ARTICLES_SQL = f"""
WITH {PLACES},
g AS (SELECT doc_id, k, string_agg(line, chr(10) ORDER BY i) AS body FROM a GROUP BY 1, 2)
SELECT doc_id, CASE WHEN k % 6 = 0 THEN CAST(k AS VARCHAR) ELSE k || 'a' END AS article_number, CASE WHEN k % 6 = 0 THEN 'Von ' || k ELSE 'Zu ' || k END AS article_title, (1 + k // 18) || '. Teil: Teil ' || (k // 18) * 18 AS part,
  CASE WHEN k % 18 >= 9 THEN (k // 9) || '. Titel: Titel ' || (k // 9) * 9 END AS title, CAST(NULL AS VARCHAR) AS chapter, length(body) AS body_chars FROM g
"""


def statutes(s, d):
    return documents(s, d).select(F.col("doc_id").alias("id"), F.array_join(S(STATUTE), "\n").alias("text"))


@query("c6_w7_articles", ARTICLES_SQL)
def c6(s, d):
    """Articles of a statute made of each document, under their parts and titles; an article's text goes to the next heading line of any kind."""
    got = parsers.parse(statutes(s, d).withColumn("file_name", F.lit("SR")), "law")
    # headings between articles belong to the text before them
    body = F.regexp_replace("article_text", r"(?m)\n*^\d+\. (?:Teil: Teil|Titel: Titel) \d+$", "")
    return got.select(F.col("id").alias("doc_id"), "article_number", "article_title", "part", "title", "chapter", F.length(body).cast("long").alias("body_chars"))


@query("c6_paragraphs")
def c6_paragraphs(s, d):
    """The parts of long articles: numbered ones here."""
    got = articles.articles(statutes(s, d), "id", "text")
    return got.select(F.col("id").alias("doc_id"), "article_number", F.posexplode(articles.paragraphs(F.col("article_text"), 60)).alias("paragraph", "text"))


@query("f33_decision_blocks", "SELECT doc_id, '=== DECISION: ' || doc_id || ' ===' || chr(10) || 'Court: ' || coalesce(source, 'Unknown Court') || chr(10) || 'Date: Unknown Date' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '--- REGESTE (Summary) ---' || chr(10) || lang || chr(10) ELSE '' END || CASE WHEN coalesce(text, '') <> '' THEN chr(10) || '--- REASONING ---' || chr(10) || text || chr(10) ELSE '' END AS block FROM documents")
def f33_decisions(s, d):
    parts = {"regeste": F.when(F.col("doc_id") % 3 == 0, F.col("lang")), "facts": F.lit(""), "reasoning": F.col("text")}
    return documents(s, d).select("doc_id", prompts.decision_block(F.col("doc_id").cast("string"), F.col("source"), F.lit(None).cast("string"), parts).alias("block"))


@query("f33_law_blocks", """
WITH a AS (SELECT l_orderkey AS law, l_linenumber AS n, l_returnflag AS title, l_shipdate FROM lineitem),
k AS (SELECT * FROM a WHERE law % 2 = 1 OR n % 2 = 1 OR law NOT IN (SELECT law FROM a WHERE n % 2 = 1))
SELECT law, '=== LAW: SR ' || law || ' ===' || chr(10) || string_agg(chr(10) || 'Art. ' || n || ' ' || title || chr(10) || 'Text ' || n || chr(10), '' ORDER BY n, title) AS block FROM k GROUP BY law
""")
def f33_laws(s, d):
    """Lines of orders as articles of laws; of every other law those of odd numbers are asked for."""
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("law"), F.col("l_linenumber").cast("string").alias("number"), F.col("l_returnflag").alias("title"), F.concat(F.lit("Text "), F.col("l_linenumber").cast("string")).alias("body"), F.col("l_linenumber").alias("n"))
    return prompts.law_blocks(rows, "law", "number", "title", "body", "n", rows.where("law % 2 = 0 and n % 2 = 1"))


@query("f36_tagged_context", """
WITH r AS (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN 'dossier' WHEN 1 THEN 'codex' ELSE 'library' END AS lane FROM conversations),
l AS (SELECT conv_id, lane, string_agg('- ' || turn || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS x FROM r GROUP BY 1, 2)
SELECT conv_id, string_agg(CASE lane WHEN 'codex' THEN '[CODEX - Swiss Laws]' WHEN 'library' THEN '[LIBRARY - Case Law]' ELSE '[DOSSIER - Your Documents]' END || chr(10) || x || chr(10) || CASE lane WHEN 'codex' THEN '[END CODEX]' WHEN 'library' THEN '[END LIBRARY]' ELSE '[END DOSSIER]' END,
  chr(10) || chr(10) ORDER BY CASE lane WHEN 'codex' THEN 0 WHEN 'library' THEN 1 ELSE 2 END) AS context FROM l GROUP BY conv_id
""")
def f36(s, d):
    lane = F.when(F.col("turn") % 3 == 0, "dossier").when(F.col("turn") % 3 == 1, "codex").otherwise("library")
    return prompts.tagged(table(s, d, "conversations").withColumn("lane", lane), "conv_id", "lane", "turn", "text", "turn")


@query("f36_history", "WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, '[CHAT HISTORY]' || chr(10) || string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || coalesce(text, ''), chr(10) ORDER BY turn) || chr(10) || '[END CHAT HISTORY]' AS history FROM n WHERE n <= 4 GROUP BY conv_id")
def f36_history(s, d):
    return prompts.history_block(table(s, d, "conversations"), "conv_id", "turn", "role", "text", 2)


@query("f32_citations", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'BGE ' || p_size || ' III ' || p_partkey WHEN 1 THEN p_brand || ' Art. ' || p_size ELSE 'SR ' || p_partkey END AS citation FROM part")
def f32(s, d):
    """References of decisions with hyphens, of laws with and without an abbreviation."""
    at = lambda k, x: S(f"CASE WHEN p_partkey % 4 = {k} THEN {x} END")
    number = F.col("p_partkey").cast("string")
    return table(s, d, "part").select("p_partkey", prompts.citation(F.coalesce(at(0, "'CH-BGE-' || p_size || '-iii-' || p_partkey"), at(3, "'BGer 1C'")), F.coalesce(at(1, "p_brand"), at(2, "''")), F.col("p_size").cast("string"), number).alias("citation"))


@query("f80_guarded_json", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'general' ELSE event_type END AS intent, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) ELSE 'none' END AS target FROM events")
def f80(s, d):
    """Answers that are fenced and whole, fenced and partial, bare and partial, and broken."""
    answer = S(r"""CASE event_id % 4 WHEN 0 THEN 'Sure:\n```json\n{"intent": "' || event_type || '", "target": ' || user_id || '}\n```' WHEN 1 THEN '```\n{"intent": "' || event_type || '"}\n```'
        WHEN 2 THEN '{"intent": "' || event_type || '", "target": null}' ELSE '{"intent": "' || event_type END""")
    got = prompts.guarded(answer, {"intent": "general", "target": "none"})
    return table(s, d, "events").select("event_id", got["intent"].alias("intent"), got["target"].alias("target"))


@query("f84_uuids", "WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(source || '_' || doc_id)) AS h FROM documents) SELECT doc_id, left(h, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + CAST((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 AS BIGINT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM documents JOIN h USING (doc_id)")
def f84(s, d):
    return table(s, d, "documents").select("doc_id", text.uuid5_url(F.concat_ws("_", "source", F.col("doc_id").cast("string"))).alias("id"))


@query("s18_paged_hits", "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents) SELECT source, n // 5 AS page, doc_id FROM r WHERE n < 30")
def s18_paged(s, d):
    """Landed pages of five hits; each source is read up to the first page that begins at thirty hits or more."""
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    rows = table(s, d, "documents").select("source", "doc_id", place.alias("n"))
    pages = rows.groupBy("source", F.expr("n div 5").alias("page")).agg(F.collect_list("doc_id").alias("hits"))
    path = f"{shared_dir(s)}/table-{uuid.uuid4().hex}"
    pages.write.json(path)
    return readers.hits(s.read.schema("source string, page long, hits array<long>").json(path), "source", 5, 30)


@query("r13_routes", f"WITH f AS ({FUSED}) SELECT query_id, id, rank, 'dense' AS arm FROM {best(20)} WHERE query_id % 100 = 0 UNION ALL SELECT query_id, id, rank, 'hybrid' FROM f WHERE query_id % 100 <> 0")
def r13_routes(s, d):
    """Multilingual questions (here every second of the query set) by vectors alone, others by both arms."""
    p, q = points(s, d), landed(asked(s, d))
    many_ = retrieve.dense_many(p, q.where("query_id % 100 = 0"), 20).select("query_id", "id", "rank", F.lit("dense").alias("arm"))
    own = q.where("query_id % 100 <> 0")
    both = retrieve.hybrid_many(p, vectors(s, d), own, asked_tokens(s, d).where("query_id % 100 <> 0"), 20)
    return many_.unionByName(both.select("query_id", "id", "rank", F.lit("hybrid").alias("arm")))
