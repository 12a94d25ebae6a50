"""Retrieval: dense, sparse and hybrid top-k, MMR, reranking, dedupe, lanes.

One query is a literal (`dense`, `sparse`, `hybrid`); a set of queries is a DataFrame (`dense_many` and so on),
whose results carry query_id. The steps after retrieval take `by`: the column that tells queries apart.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexmill.functions import text, vector, vocab
from lexmill.operators import many
from lexmill.operators.filters import active_only, compile_filter, is_ordinance
from lexmill.operators.postings import gathered
from lexmill.sources.shared import landed

#: Texts whose tokens are counted before they go on.
TEXTS = 500


def top(rows: DataFrame, k: int, score: str = "score", key: str = "id") -> DataFrame:
    """The k best by score, then key, with their rank from 1. The sort keeps k rows a task; ranking sees k rows."""
    best = rows.orderBy(F.desc(score), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def dense(points: DataFrame, query: list[float], k: int = 50, filters: dict | None = None, threshold: float | None = None) -> DataFrame:
    """Cosine of every row's `dense` to the query; the filter and the threshold come before the top-k. Rows without a score are no candidates."""
    q = F.array(*map(F.lit, map(float, query)))
    rows = points.where(compile_filter(filters)).withColumn("score", vector.cosine(F.col("dense"), q)).where("score is not null")
    return top(rows if threshold is None else rows.where(F.col("score") >= threshold), k)


def postings(docs: DataFrame, key: str = "id", body: str = "text") -> DataFrame:
    """R16's default sparse encoder: (id, token, weight), weight being the term frequency of lower-cased words."""
    words = F.regexp_extract_all(F.lower("_body"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    # texts are exchanged, not their tokens; rows of one id come after each other
    rows = docs.select(key, F.col(body).alias("_body")).repartition(key).sortWithinPartitions(key).select(key, words.alias("words"))
    kind = to_arrow_type(docs.schema[key].dataType)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(bags: list[tuple[object, Counter]]) -> pa.RecordBatch:
            keys = pa.array([i for i, bag in bags for _ in range(len(bag))], kind)
            tokens = pa.array([t for _, bag in bags for t in bag], pa.string())
            return pa.RecordBatch.from_arrays([keys, tokens, pa.array([float(n) for _, bag in bags for n in bag.values()], pa.float64())], [key, "token", "weight"])

        bags: list[tuple[object, Counter]] = []
        for batch in batches:
            words = batch.column(1)
            for at, i in enumerate(batch.column(0).to_pylist()):
                if not bags or bags[-1][0] != i:
                    if len(bags) >= TEXTS:
                        yield made(bags)
                        bags = []
                    bags.append((i, Counter()))
                bags[-1][1].update(words[at].as_py() or ())  # strings of one text, not of a whole batch, are held
        if bags:
            yield made(bags)

    return rows.mapInArrow(counted, f"{key} {docs.schema[key].dataType.simpleString()}, token string, weight double")


def sparse(posts: DataFrame, query: dict[str, float], k: int) -> DataFrame:
    """The sum of products over shared tokens. The query is a literal, so it filters the postings' scan."""
    if not query:
        return top(posts.select("id").limit(0).withColumn("score", F.lit(0.0)), k)
    weight = F.create_map(*(F.lit(x) for kv in query.items() for x in kv))
    hit = posts.where(F.col("token").isin(*query))
    return top(hit.groupBy("id").agg(F.sum(F.col("weight") * weight[F.col("token")]).alias("score")), k)


def fuse(lists: list[DataFrame], k: int, rrf_k: int = vocab.FINAL["rrf_k"]) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (id, rank)."""
    rows = lists[0].select("id", "rank")
    for x in lists[1:]:
        rows = rows.unionByName(x.select("id", "rank"))
    return top(rows.groupBy("id").agg(F.round(F.sum(vector.rrf(F.col("rank"), rrf_k)), 12).alias("score")), k)


def hybrid(points: DataFrame, posts: DataFrame, query: list[float], tokens: dict[str, float], k: int, filters: dict | None = None) -> DataFrame:
    """Twice k from either arm, fused, then k; with the points' payload."""
    kept = points.where(compile_filter(filters))
    arm = posts if not filters else posts.join(kept.select("id"), "id", "left_semi")
    fused = fuse([dense(kept, query, 2 * k), sparse(arm, tokens, 2 * k)], k)
    return kept.join(F.broadcast(fused), "id")  # fused has k rows


def payload(points: DataFrame, ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """The points' and the queries' other columns beside ranked rows; vectors were not carried through the top-k."""
    return points.join(ranked, "id").join(queries, "query_id")


def dense_many(points: DataFrame, queries: DataFrame, k: int = 50, filters: dict | None = None, threshold: float | None = None) -> DataFrame:
    """R1/R3 for each of queries (query_id, query_dense, ...), with payload."""
    return payload(points, many.dense(points, queries, k, filters, threshold), queries)


def word_vectors(docs: DataFrame, body: str = "text") -> DataFrame:
    """postings() as vectors for `many.sparse`, without an exchange."""
    return many.word_vectors(docs, F.regexp_extract_all(F.lower(body), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def hybrid_many(points: DataFrame, vectors: DataFrame, queries: DataFrame, asked: DataFrame, k: int, filters: dict | None = None) -> DataFrame:
    """R2/T1 for each of queries; vectors: the points' (id, t, w), asked: the queries' (query_id, token, weight)."""
    kept = points.where(compile_filter(filters))
    arm = vectors if not filters else vectors.join(kept.select("id"), "id", "left_semi")
    # tokens of other queries would only be searched for nothing
    asked = asked.join(queries.select("query_id"), "query_id", "left_semi")
    fused = many.fuse([many.dense(kept, queries, 2 * k), many.sparse(arm, asked, 2 * k)], k, vector.rrf)
    return payload(kept, fused, queries)


def within(by: str | None, *more: str):
    """A window over a query's rows."""
    return Window.partitionBy(*([by] if by else []), *more)


def first_rows(rows: DataFrame, k: int, by: str | None, *order) -> DataFrame:
    """The first k rows of each query, with their rank from 1; of one query by a sort that keeps k rows a task."""
    if by is None:
        return rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return rows.withColumn("_n", F.row_number().over(within(by).orderBy(*order))).where(F.col("_n") <= k).withColumn("rank", F.col("_n")).drop("_n")


def dedupe(rows: DataFrame, key: str, k: int, by: str | None = None) -> DataFrame:
    """The best row of each document, then the first k documents, ranked anew."""
    best = rows.withColumn("_first", F.row_number().over(within(by, key).orderBy("rank"))).where("_first = 1").drop("_first")
    return first_rows(best, k, by, "rank")


def shown(rows: DataFrame, key: str, words: str, most: int = 15, by: str | None = None) -> DataFrame:
    """Rows in order unless their key or their text key (if not empty) was shown before, at most `most`, ranked anew.

    The rule depends on what was accepted, so it runs over one query's candidates, which the top-k bounds.
    """
    group = by or "_one"
    rows = rows if by else rows.withColumn("_one", F.lit(0))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("rank", kind="stable")
        keys, texts, kept = set(), set(), []
        for place, (k, t) in enumerate(zip(own[key], own[words], strict=True)):
            if len(kept) == most:
                break
            if k not in keys and t not in texts:
                keys.add(k)
                if t:
                    texts.add(t)
                kept.append(place)
        own = own.iloc[kept].copy()
        own["rank"] = np.arange(1, len(own) + 1)
        return own

    out = rows.groupBy(group).applyInPandas(run, rows.schema)
    return out if by else out.drop("_one")


def boost(rows: DataFrame, canton: str | Column | None, by: str | None = None) -> DataFrame:
    """Boosted score, and a stable rank by it."""
    if canton is None:
        return rows
    rows = rows.withColumn("score", vector.boosted(F.col("score"), F.col("canton"), F.col("source"), canton))
    return rows.withColumn("rank", F.row_number().over(within(by).orderBy(F.desc("score"), "rank")))


def similarity_matrix(rows: pd.DataFrame, embedded: bool) -> np.ndarray:
    if embedded:
        x = np.array(rows["dense"].tolist(), dtype=float)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        return x @ x.T
    out = np.zeros((len(rows), len(rows)))
    for name, weight in (("source", 0.3), ("court", 0.5), ("sr_number", 0.7), ("doc_key", 1.0)):  # later ones override
        v = rows[name].fillna("").astype(str)
        code = np.where(v == "", -1, pd.factorize(v)[0])  # numbers compare faster than strings
        out[(code[:, None] == code[None, :]) & (code[:, None] >= 0)] = weight
    return out


def mmr_score(relevance, most_alike, lam: float = vocab.FINAL["mmr_lambda"]):
    """F64, for columns and arrays."""
    return lam * relevance - (1 - lam) * most_alike


def pick(relevance: np.ndarray, alike: np.ndarray, k: int, lam: float) -> list[int]:
    """Greedy: the first, then each time the greatest relevance less likeness to those taken; ties go to the earlier."""
    n = len(relevance)
    if n <= k:
        return list(range(n))
    taken, most = [0], alike[0].copy()
    free = np.ones(n, dtype=bool)
    free[0] = False
    while len(taken) < k:
        score = np.where(free, mmr_score(relevance, most, lam), -np.inf)
        best = int(score.argmax())
        taken.append(best)
        free[best] = False
        most = np.maximum(most, alike[best])
    return taken


def mmr(rows: DataFrame, k: int = 20, lam: float = 0.7, query: list[float] | str | None = None, by: str | None = None) -> DataFrame:
    """Maximal marginal relevance within each query's candidates (at most some hundreds), ranked anew.

    With a query (a vector, or the column that holds it) and a `dense` column relevance and likeness are cosines,
    else score and metadata likeness.
    """
    embedded = query is not None and "dense" in rows.columns
    key = by or "_one"
    rows = rows if by else rows.withColumn("_one", F.lit(0))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("rank", kind="stable").reset_index(drop=True)
        if embedded:
            x, q = np.array(own["dense"].tolist(), dtype=float), np.array(own[query].iloc[0] if isinstance(query, str) else query, dtype=float)
            size = np.linalg.norm(x, axis=1) * np.linalg.norm(q)
            relevance = np.divide(x @ q, size, out=np.zeros(len(x)), where=size > 0)
        else:
            relevance = own["score"].fillna(0.5).to_numpy(dtype=float)
        out = own.iloc[pick(relevance, similarity_matrix(own, embedded), k, lam)].copy()
        out["rank"] = np.arange(1, len(out) + 1)
        return out

    out = rows.groupBy(key).applyInPandas(run, rows.schema)
    return out if by else out.drop("_one")


def overlap_score(query: str | Column, body: Column) -> Column:
    """R5's default scorer in place of a cross-encoder: the share of the query's words that the text has."""
    asked = F.lit(query) if isinstance(query, str) else query
    words = F.array_distinct(F.filter(F.split(F.lower(asked), r"\s+"), lambda w: w != ""))
    have = F.array_distinct(F.regexp_extract_all(F.lower(body), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    return F.size(F.array_intersect(have, words)) / F.greatest(F.size(words), F.lit(1)).cast("double")


def rerank(rows: DataFrame, query: str | Column, k: int, now_year: int, scorer: Callable[[str | Column, Column], Column] = overlap_score, threshold: float | None = None, body: str = "text", by: str | None = None) -> DataFrame:
    """Pair scores plus a tenth of recency, best k; adds base_score, recency_score, final_score."""
    rows = rows.withColumn("base_score", scorer(query, F.col(body))).withColumn("recency_score", vector.recency(F.coalesce("year", F.lit(vocab.FINAL["default_year"])), now_year))
    rows = rows.withColumn("final_score", F.col("base_score") + vocab.FINAL["recency_weight"] * F.col("recency_score"))
    if threshold is not None:
        rows = rows.where(F.col("final_score") >= threshold)
    # sums that only differ in their last bits are ties, which the rank before decides
    return first_rows(rows, k, by, F.desc(F.round("final_score", 9)), "rank")


def confidence(rows: DataFrame, by: str | None = None) -> DataFrame:
    """One row (n, top_score, score_variance, confidence), or one for each query that has rows."""
    stats = rows.groupBy(*([by] if by else [])).agg(F.count("*").alias("n"), F.max("final_score").alias("top_score"), F.var_pop("final_score").alias("score_variance"))
    return stats.withColumn("confidence", vector.tier(F.col("top_score"), F.col("score_variance")))


def split_laws(rows: DataFrame, laws: int = 15, ordinances: int = 10, name: str = "sr_name", by: str | None = None) -> DataFrame:
    """The first laws, then the first ordinances."""
    flag = is_ordinance(F.col(name))
    w = within(by, "is_ordinance").orderBy("rank")
    kept = rows.withColumn("is_ordinance", flag).withColumn("_n", F.row_number().over(w))
    kept = kept.where(F.col("_n") <= F.when(F.col("is_ordinance"), ordinances).otherwise(laws)).drop("_n")
    return kept.withColumn("rank", F.row_number().over(within(by).orderBy("is_ordinance", "rank")))


def correct_names(rows: DataFrame, dim: DataFrame, language: str = "de") -> DataFrame:
    """Abbreviation and name from the registry (sr_number, lang, abbr, title) where both old and new are filled."""
    lang = "de" if language == "en" else language
    own = dim.where(F.col("lang") == lang).select("sr_number", F.col("abbr").alias("_abbr"), F.col("title").alias("_title"))
    new = lambda old, c: F.when((F.coalesce(F.col(old), F.lit("")) != "") & (F.coalesce(F.col(c), F.lit("")) != ""), F.col(c)).otherwise(F.col(old))
    return rows.join(own, "sr_number", "left").withColumns({"abbreviation": new("abbreviation", "_abbr"), "sr_name": new("sr_name", "_title")}).drop("_abbr", "_title")


def lane(points: DataFrame, posts: DataFrame, query: list[float], tokens: dict[str, float], question: str, now_year: int, kind: str = "library", top_k: int = 10, filters: dict | None = None, canton: str | None = None, active: DataFrame | None = None) -> DataFrame:
    """R7, R8 (laws), R9 (ordinances): hybrid candidates, boost (statutes), MMR by metadata, reranking, best row of each document, active laws."""
    rows = hybrid(points, posts, query, tokens, vocab.LANES[kind]["hybrid"], filters if kind == "library" else None)
    return refined(rows, question, now_year, kind, top_k, canton, active)


def lane_many(points: DataFrame, vectors: DataFrame, queries: DataFrame, asked: DataFrame, now_year: int, kind: str = "library", top_k: int = 10, filters: dict | None = None, canton: str | None = None, active: DataFrame | None = None) -> DataFrame:
    """R7-R9 for each of queries (query_id, query_dense, query_text); asked: their (query_id, token, weight)."""
    light = hybrid_many(points.drop("text"), vectors, queries.select("query_id", "query_dense"), asked, vocab.LANES[kind]["hybrid"], filters if kind == "library" else None)
    # texts are fetched for the rows that MMR leaves
    texts = lambda rows: rows.join(points.select("id", "text"), "id").join(queries.select("query_id", "query_text"), "query_id")
    return refined(light.drop("dense", "query_dense"), F.col("query_text"), now_year, kind, top_k, canton, active, "query_id", texts)


def shared_lanes(dense: DataFrame, sparse: DataFrame, kinds: list[str]) -> DataFrame:
    """(query_id, id, score, rank, lane) of R7-R9's hybrid candidates from one dense and one sparse list.

    A lane of k candidates fuses the first 2k rows of either list, so lanes differ in what they cut off, not in what is searched.
    """
    both = dense.select("query_id", "id", "rank").unionByName(sparse.select("query_id", "id", "rank"))
    share = lambda kind: F.sum(F.when(F.col("rank") <= 2 * vocab.LANES[kind]["hybrid"], vector.rrf(F.col("rank"))))
    fused = both.groupBy("query_id", "id").agg(*(F.round(share(kind), 12).alias(kind) for kind in kinds))
    each = fused.select("query_id", "id", F.explode(F.array(*(F.struct(F.lit(kind).alias("lane"), F.col(kind).alias("score"), F.lit(vocab.LANES[kind]["hybrid"]).alias("_k")) for kind in kinds))).alias("x"))
    each = each.select("query_id", "id", "x.*").where("score is not null")
    place = F.row_number().over(Window.partitionBy("query_id", "lane").orderBy(F.desc("score"), "id"))
    return each.withColumn("rank", place).where(F.col("rank") <= F.col("_k")).drop("_k")


def questions(queries: DataFrame) -> DataFrame:
    """R11's first steps: queries with language and canton (F4), and the expanded question that is encoded (F3); the question itself reranks."""
    return queries.withColumns({"query_language": text.query_language("query_text"), "query_canton": text.query_canton("query_text"), "expanded": text.expand_query("query_text")})


def dossier_many(points: DataFrame, vectors: DataFrame, queries: DataFrame, asked: DataFrame, collections: dict[str, dict], now_year: int, top_k: int = 10) -> DataFrame:
    """Up to 250 hybrid rows of each collection (scope: its filter), the best 500 of all, MMR, reranking, best row of each document.

    An empty collection adds nothing. needs_enrichment: whole documents are fetched where they can be decrypted.
    """
    found, asked = None, asked.join(queries.select("query_id"), "query_id", "left_semi")
    for scope, only in collections.items():
        kept = points.where(compile_filter(only))
        lists = [many.dense(kept, queries, 500), many.sparse(vectors.join(kept.select("id"), "id", "left_semi"), asked, 500)]
        rows = many.fuse(lists, 250, vector.rrf).withColumn("scope", F.lit(scope))
        found = rows if found is None else found.unionByName(rows)
    first = first_rows(found.drop("rank"), vocab.FINAL["dossier_top"], "query_id", F.desc("score"), "id")
    rows = payload(points.drop("text", "dense"), first, queries.select("query_id"))
    rows = mmr(rows, 100, vocab.FINAL["mmr_lambda"], by="query_id")
    rows = rows.join(points.select("id", "text"), "id").join(queries.select("query_id", "query_text"), "query_id")
    rows = rerank(rows, F.col("query_text"), 100, now_year, by="query_id")
    return dedupe(rows, "doc_key", top_k, "query_id").withColumn("needs_enrichment", F.lit(True))


def search_many(points: DataFrame, vectors: DataFrame, queries: DataFrame, collections: dict[str, dict], now_year: int, top_k: int = 10, active: DataFrame | None = None) -> DataFrame:
    """R11 for each of queries (query_id, query_dense, query_text): the library, statutes, ordinances and dossier lanes with confidences.

    points and vectors are searched once for three lanes; the dossiers' collections are parts of them.
    """
    points, vectors, queries = landed(points), landed(gathered(vectors)), landed(questions(queries))  # each is read several times
    asked = landed(postings(queries.select("query_id", F.col("expanded").alias("text")), "query_id"))
    kinds = ["library", "laws", "ordinances"]
    most = 2 * max(vocab.LANES[kind]["hybrid"] for kind in kinds)
    lists = landed(shared_lanes(many.dense(points, queries, most), many.sparse(vectors, asked, most), kinds))
    light = points.drop("text", "dense")
    texts = lambda rows: rows.join(points.select("id", "text"), "id").join(queries.select("query_id", "query_text"), "query_id")
    lanes = {}
    for kind in kinds:
        rows = payload(light, lists.where(F.col("lane") == kind).drop("lane"), queries.select("query_id", "query_canton"))
        lanes[kind] = refined(rows, F.col("query_text"), now_year, kind, top_k, F.col("query_canton"), active, "query_id", texts)
    lanes["dossier"] = dossier_many(points, vectors, queries, asked, collections, now_year, top_k)
    return search(lanes, "query_id")


def refined(rows: DataFrame, question: str | Column, now_year: int, kind: str, top_k: int, canton: str | Column | None, active: DataFrame | None, by: str | None = None, texts: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """What lanes do with their candidates; texts adds what only reranking needs."""
    size = vocab.LANES[kind]
    statutes = kind != "library"
    if statutes:
        ordinance = is_ordinance(F.col("sr_name"))
        rows = boost(rows.where(ordinance if kind == "ordinances" else ~ordinance), canton, by)
    rows = mmr(rows, size["mmr"], vocab.FINAL["mmr_lambda"], by=by)
    rows = rerank(texts(rows), question, size["rerank"], now_year, by=by)
    rows = dedupe(rows, "doc_key", size.get("top", top_k), by)
    return active_only(rows, active) if statutes else rows


def search(lanes: dict[str, DataFrame], by: str | None = None) -> DataFrame:
    """All lanes' rows with their lane, its confidence and the overall one (the least; an empty lane has none)."""
    out = None
    for name, rows in lanes.items():
        rows = rows.select(*([by] if by else []), "id", "rank", "final_score", F.lit(name).alias("lane"))
        out = rows if out is None else out.unionByName(rows)
    # windows over the lanes' few rows, so no lane is computed twice
    own, whole = within(by, "lane"), within(by)
    out = out.withColumn("confidence", vector.tier(F.max("final_score").over(own), F.var_pop("final_score").over(own)))
    least = F.min_by("confidence", vector.tier_rank(F.col("confidence"))).over(whole)
    return out.withColumn("overall", F.when(F.size(F.collect_set("lane").over(whole)) < len(lanes), "NONE").otherwise(least))


def assemble(rows: DataFrame, chunks: DataFrame, documents: int = 10, most: int = 50, by: str | None = None) -> DataFrame:
    """The text of the first documents' chunks in order, (doc_key, doc_rank, n_chunks, context)."""
    keys = [by] if by else []
    first = first_rows(rows.groupBy(*keys, "doc_key").agg(F.min("rank").alias("rank")), documents, by, "rank", "doc_key")
    # the first chunks of a document are the same for every query, so only those are multiplied
    own = chunks.withColumn("_n", F.row_number().over(Window.partitionBy("doc_key").orderBy("chunk_index"))).where(F.col("_n") <= most)
    own = own.join(first.withColumnRenamed("rank", "doc_rank"), "doc_key")
    line = F.concat(F.lit("["), F.upper("chunk_type"), F.lit("]\n"), F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", line.alias("line"))))
    return own.groupBy(*keys, "doc_key", "doc_rank").agg(F.count("*").alias("n_chunks"), F.array_join(F.transform(parts, lambda x: x["line"]), "\n\n").alias("context"))

