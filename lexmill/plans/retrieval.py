"""Retrieval over embeddings and documents (R*, J12-J14, W1-W4, F60-F67)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text, vector
from lexmill.operators import chunk, many, retrieve
from lexmill.plans.registry import documents, query, table
from lexmill.sources.shared import landed

NOW = 2026


def points(s, d):
    """Embeddings as points, with payload from the document of the same number."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"), "label").join(docs, "id")
    return rows.select(
        "id", "dense", "text", "lang", "source", F.concat(F.lit("SR "), F.col("label").cast("string")).alias("sr_number"), F.concat(F.lit("D"), (F.col("id") % 97).cast("string")).alias("doc_key"),
        F.concat(F.lit("C"), (F.col("id") % 5).cast("string")).alias("court"), (F.lit(1990) + F.col("id") % 37).cast("int").alias("year"),
        F.when(F.col("id") % 4 == 0, "TI").otherwise("ZH").alias("canton"), F.when(F.col("id") % 3 == 0, "Verordnung").otherwise("Gesetz").alias("sr_name"),
    )


def asked(s, d):
    """The query set: every point whose id is divisible by 50."""
    return points(s, d).where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("dense").alias("query_dense"), F.col("text").alias("query_text"))


P = "(SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS dense, label, text, lang, source, 'D' || (vec_id % 97) AS doc_key, CASE WHEN vec_id % 4 = 0 THEN 'TI' ELSE 'ZH' END AS canton, 1990 + vec_id % 37 AS year FROM embeddings JOIN documents ON vec_id = doc_id)"
COS = f"SELECT p.*, q.id AS query_id, q.text AS query_text, round(list_cosine_similarity(p.dense, q.dense), 9) AS score FROM {P} p, {P} q WHERE q.id % 50 = 0"
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)"


def best(n, more="", rows=COS):
    """SQL of the n best rows of each query with their rank."""
    return f"(SELECT * FROM (SELECT *, {RANK} AS rank FROM ({rows} {more})) WHERE rank <= {n})"


def shown(rows, *more):
    return rows.select("query_id", "id", "rank", F.round("score", 6).alias("score"), *more)


@query("r1_dense_topk", f"SELECT query_id, id, rank, round(score, 6) AS score FROM {best(10)}")
def r1(s, d):
    return shown(many.dense(points(s, d), asked(s, d), 10))


@query("r1_p1_dense_filtered", f"SELECT query_id, id, rank, round(score, 6) AS score FROM {best(10, "AND p.lang = 'de' AND p.year >= 2000")}")
def r1f(s, d):
    return shown(many.dense(points(s, d), asked(s, d), 10, {"lang": "de", "year_range": {"min": 2000}}))


@query("r3_p3_threshold", f"SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT *, {RANK} AS rank FROM ({COS}) WHERE score >= 0.2) WHERE rank <= 50")
def r3(s, d):
    return shown(many.dense(points(s, d), asked(s, d), 50, threshold=0.2))


POSTS = r"(SELECT id, token, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM documents) GROUP BY 1, 2)"
SUMS = f"SELECT q.id AS query_id, p.id, sum(p.weight * q.weight) AS score FROM {POSTS} p JOIN {POSTS} q USING (token) WHERE q.id % 50 = 0 GROUP BY 1, 2"


def posts(s, d):
    return retrieve.postings(documents(s, d).select(F.col("doc_id").alias("id"), "text"))


def vectors(s, d):
    return retrieve.word_vectors(documents(s, d).select(F.col("doc_id").alias("id"), "text"))


def asked_tokens(s, d):
    """The tokens of the query set's texts."""
    return retrieve.postings(table(s, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text"), "query_id")


@query("j12_w1_sparse_topk", f"SELECT query_id, id, rank, round(score, 6) AS score FROM {best(20, rows=SUMS)}")
def j12(s, d):
    return shown(many.sparse(vectors(s, d), asked_tokens(s, d), 20))


FUSED = f"""
WITH a AS {best(40)}, b AS {best(40, rows=SUMS)},
f AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 12) AS score FROM (SELECT query_id, id, rank FROM a UNION ALL SELECT query_id, id, rank FROM b) GROUP BY 1, 2),
r AS (SELECT *, {RANK} AS rank FROM f)
SELECT query_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= 20 AND id IN (SELECT id FROM {P}) AND query_id IN (SELECT id FROM {P})
"""


@query("r2_j14_hybrid_rrf", FUSED)
def r2(s, d):
    return shown(retrieve.hybrid_many(points(s, d), vectors(s, d), asked(s, d), asked_tokens(s, d), 20))


@query("w2_dedupe", f"WITH b AS (SELECT * FROM {best(200)} QUALIFY row_number() OVER (PARTITION BY query_id, doc_key ORDER BY rank) = 1) SELECT query_id, id, doc_key, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 30")
def w2(s, d):
    rows = retrieve.dense_many(points(s, d), asked(s, d), 200)
    return retrieve.dedupe(rows, "doc_key", 30, "query_id").select("query_id", "id", "doc_key", "rank")


@query("w3_w4_first_of_group", f"SELECT query_id, label, min(rank) AS first_rank, dense_rank() OVER (PARTITION BY query_id ORDER BY min(rank)) AS group_no FROM {best(200)} GROUP BY query_id, label")
def w4(s, d):
    rows = retrieve.dense_many(points(s, d), asked(s, d), 200)
    groups = rows.groupBy("query_id", F.substring("sr_number", 4, 9).cast("int").alias("label")).agg(F.min("rank").alias("first_rank"))
    return groups.withColumn("group_no", F.dense_rank().over(Window.partitionBy("query_id").orderBy("first_rank")))


@query("w15_presentation_rank")
def w15(s, d):
    """Each query's candidates with valid ids, by their documents and the first 150 characters of their texts."""
    rows = retrieve.dense_many(points(s, d), asked(s, d), 200).withColumn("decision", F.concat(F.lit("ch_bger "), "doc_key", F.lit("_chunk_"), F.col("id").cast("string")))
    rows = rows.where(text.display_id_ok("decision")).select("query_id", "id", "rank", text.presentation_id("decision").alias("key"), text.presentation_text("text").alias("words"))
    return retrieve.shown(rows, "key", "words", 15, "query_id").select("query_id", "id", "rank")


@query("f65_t2_context_boost", f"WITH b AS (SELECT query_id, id, CASE WHEN canton = 'TI' THEN score * 3.5 ELSE score END AS score, rank FROM {best(100)}) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank, round(score, 6) AS score FROM b")
def f65(s, d):
    return shown(retrieve.boost(retrieve.dense_many(points(s, d), asked(s, d), 100), "TI", "query_id"))


@query("r4_mmr_metadata")
def r4(s, d):
    rows = retrieve.dense_many(points(s, d), asked(s, d), 100).drop("dense", "query_dense", "text", "query_text")
    return retrieve.mmr(rows, 20, 0.7, by="query_id").select("query_id", "id", "rank")


@query("r4_mmr_embedding")
def r4e(s, d):
    rows = retrieve.dense_many(points(s, d), asked(s, d), 100).select("query_id", "id", "rank", "dense", "query_dense")
    return retrieve.mmr(rows, 20, 0.3, "query_dense", "query_id").select("query_id", "id", "rank")


RERANKED = f"""
WITH w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(query_text), '\\s+'), lambda x: x <> '')) AS asked FROM {best(100)}),
b AS (SELECT *, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')), asked)) / CAST(greatest(len(asked), 1) AS DOUBLE) + 0.1 * ((greatest(1900, least(2026, year)) - 1900) / 126.0) AS final_score FROM w),
t AS (SELECT query_id, id, final_score, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, rank) AS rank FROM b)
"""


@query("r5_t3_rerank", RERANKED + "SELECT query_id, id, round(final_score, 6) AS final_score, rank FROM t WHERE rank <= 15")
def r5(s, d):
    rows = retrieve.dense_many(points(s, d), asked(s, d), 100)
    return retrieve.rerank(rows, F.col("query_text"), 15, NOW, by="query_id").select("query_id", "id", F.round("final_score", 6).alias("final_score"), "rank")


@query("r6_f67_confidence", RERANKED + "SELECT query_id, count(*) AS n, round(max(final_score), 6) AS top_score, round(var_pop(final_score), 6) AS score_variance, CASE WHEN max(final_score) > 0.75 AND var_pop(final_score) < 0.1 THEN 'HIGH' WHEN max(final_score) > 0.55 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM t WHERE rank <= 15 GROUP BY query_id")
def r6(s, d):
    rows = retrieve.rerank(retrieve.dense_many(points(s, d), asked(s, d), 100), F.col("query_text"), 15, NOW, by="query_id")
    return retrieve.confidence(rows, "query_id").select("query_id", "n", F.round("top_score", 6).alias("top_score"), F.round("score_variance", 6).alias("score_variance"), "confidence")


@query("f60_cosine_pairs", "SELECT a.vec_id AS a_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def f60(s, d):
    a = table(s, d, "embeddings").select(F.col("vec_id").alias("a_id"), "embedding")
    b = a.select((F.col("a_id") - 1).alias("a_id"), F.col("embedding").alias("other"))
    return a.join(b, "a_id").select("a_id", F.round(vector.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


@query("f63_metadata_similarity", "SELECT a.p_partkey, CAST(CASE WHEN a.p_name = b.p_name THEN 1.0 WHEN a.p_brand = b.p_brand THEN 0.7 WHEN a.p_type = b.p_type THEN 0.5 WHEN a.p_size = b.p_size THEN 0.3 ELSE 0.0 END AS DOUBLE) AS score FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def f63(s, d):
    a = table(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", F.col("p_size").cast("string").alias("p_size"))
    b = a.select((F.col("p_partkey") - 1).alias("p_partkey"), *(F.col(c).alias(f"o_{c}") for c in a.columns[1:]))
    c = F.col
    both = [x for k in ("p_name", "p_brand", "p_type", "p_size") for x in (c(k), c(f"o_{k}"))]
    return a.join(b, "p_partkey").select("p_partkey", vector.metadata_similarity(*both).alias("score"))


@query("r7_library_lane")
def r7(s, d):
    rows = retrieve.lane_many(points(s, d), vectors(s, d), asked(s, d), asked_tokens(s, d), NOW, "library", 10, {"lang": ["de", "fr", "en"]})
    return rows.select("query_id", "id", "doc_key", "rank", F.round("final_score", 6).alias("final_score"))


COLLECTIONS = {"user": {"court": "C1"}, "firm": {"court": "C2"}}


@query("r11_search")
def r11(s, d):
    """All four lanes of each query; the questions tell canton and expansion themselves."""
    active = table(s, d, "labels").select(F.concat(F.lit("SR "), (F.col("doc_id") % 10).cast("string")).alias("sr_number"))
    found = retrieve.search_many(points(s, d), vectors(s, d), asked(s, d), COLLECTIONS, NOW, 10, active)
    return found.withColumn("final_score", F.round("final_score", 6))


@query("r10_dossier_lane")
def r10_lane(s, d):
    """Hybrid rows of the user's and the firm's collections, diverse, reranked, one a document."""
    queries = asked(s, d)
    found = retrieve.dossier_many(points(s, d), vectors(s, d), queries, asked_tokens(s, d), COLLECTIONS, NOW)
    return found.select("query_id", "id", "rank", "scope", F.round("final_score", 6).alias("final_score"), "needs_enrichment")


DOSSIERS = f"SELECT * FROM {best(250, "AND p.canton = 'TI'")} UNION ALL SELECT * FROM {best(250, "AND p.canton = 'ZH'")}"


@query("r10_dossier_search", f"SELECT query_id, id, CASE canton WHEN 'TI' THEN 'user' ELSE 'firm' END AS scope, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({DOSSIERS}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 500")
def r10(s, d):
    """The user's and the firm's results in one list."""
    p, q = points(s, d), asked(s, d)
    one = lambda canton, scope: many.dense(p, q, 250, {"canton": canton}).withColumn("scope", F.lit(scope))
    both = one("TI", "user").unionByName(one("ZH", "firm"))
    return retrieve.first_rows(both, 500, "query_id", F.desc("score"), "id").select("query_id", "id", "scope", "rank")


@query("r14_add_document")
def r14(s, d):
    """Chunks of documents with their hash ids and encoder input, as points to upsert."""
    rows = documents(s, d).select("doc_id", F.posexplode(chunk.chunk_dossier(F.col("text"))).alias("chunk_index", "text"))
    key = F.concat_ws("_", F.col("doc_id").cast("string"), F.lit("chunk"), F.col("chunk_index").cast("string"))
    return rows.select(text.uuid5_url(key).alias("id"), key.alias("_original_id"), "doc_id", "chunk_index", F.length("text").alias("n_chars"))


@query("r15_context")
def r15(s, d):
    rows = many.dense(points(s, d), asked(s, d), 100).withColumn("doc_key", F.concat(F.lit("D"), (F.col("id") % 97).cast("string")))
    docs = table(s, d, "documents").select(F.concat(F.lit("D"), (F.col("doc_id") % 97).cast("string")).alias("doc_key"), F.col("doc_id").alias("chunk_index"), F.lit("facts").alias("chunk_type"), "text")
    return retrieve.assemble(rows, docs, by="query_id")


@query("r16_sparse_encoder", f"SELECT id, token, weight FROM {POSTS}")
def r16(s, d):
    return posts(s, d)


@query("t4_t5_merge_collections", f"WITH u AS (SELECT * FROM {best(20, "AND p.lang = 'de'")} UNION ALL SELECT * FROM {best(20, "AND p.lang = 'fr'")}) SELECT query_id, id, {RANK} AS rank FROM u QUALIFY {RANK} <= 25")
def t5(s, d):
    p, q = points(s, d), asked(s, d)
    both = many.dense(p, q, 20, {"lang": "de"}).unionByName(many.dense(p, q, 20, {"lang": "fr"}))
    return retrieve.first_rows(both, 25, "query_id", F.desc("score"), "id").select("query_id", "id", "rank")
