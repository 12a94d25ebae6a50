"""Many queries at once against brute force, and against one query at a time."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.operators import ivf, many, postings, retrieve

SCHEMA = "id long, dense array<float>, text string, lang string, source string, sr_number string, doc_key string, court string, year int, canton string, sr_name string"


def corpus(n=160):
    rng, rows = random.Random(3), []
    words = [f"w{k}" for k in range(40)]
    for i in range(n):
        v = [rng.gauss(0, 1) for _ in range(8)] if i % 40 else rows[0][1] if rows else [1.0] * 8
        text = " ".join(rng.choices(words, [1 / (k + 1) for k in range(40)], k=rng.randint(1, 30)))
        rows.append((i, v, text, rng.choice(["de", "fr"]), "s", f"SR {i % 10}", f"D{i % 31}", f"C{i % 5}", 1990 + i % 30, rng.choice(["TI", "ZH"]), "Verordnung" if i % 3 else "Gesetz"))
    rows[7] = (7, None, *rows[7][2:])
    rows[8] = (8, [0.0] * 8, *rows[8][2:])
    rows[9] = (9, [1.0], *rows[9][2:])
    return rows


@pytest.fixture(scope="module")
def data(spark):
    rows = corpus()
    p = spark.createDataFrame(rows, SCHEMA).repartition(5).cache()
    q = p.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("dense").alias("query_dense"), F.col("text").alias("query_text"))
    posts = retrieve.postings(p).cache()
    return rows, p, q, posts, posts.where("id % 50 = 0").withColumnRenamed("id", "query_id")


@pytest.mark.parametrize("lists,block,group,tile", [(ivf.LIST_ROWS, ivf.BLOCK_ROWS, ivf.QUERY_ROWS, ivf.TILE), (6, 5, 2, 7)])
def test_dense(data, monkeypatch, lists, block, group, tile):
    """One list of one block, or many of several: the rows of all pairs."""
    rows, p, q, _, _ = data
    for name, value in (("LIST_ROWS", lists), ("BLOCK_ROWS", block), ("QUERY_ROWS", group), ("TILE", tile)):
        monkeypatch.setattr(ivf, name, value)
    for filters, least in ((None, None), ({"lang": "de"}, 0.1)):
        got = {(r.query_id, r["rank"]): (r.id, r.score) for r in many.dense(p, q, 6, filters, least).collect()}
        want = {}
        for query in rows[::50]:
            a, scored = np.array(query[1], dtype=np.float32).astype(float), []
            for r in rows:
                if r[1] is None or len(r[1]) != 8 or (filters and r[3] != "de"):
                    continue
                b = np.array(r[1], dtype=np.float32).astype(float)
                size = np.linalg.norm(a) * np.linalg.norm(b)
                scored.append((-round(float(a @ b / size), 9) + 0.0 if size else 0.0, r[0]))
            kept = [x for x in sorted(scored) if least is None or -x[0] >= least][:6]
            want |= {(query[0], k): (i, pytest.approx(-s, abs=1e-8)) for k, (s, i) in enumerate(kept, 1)}
        assert got == want


@pytest.mark.parametrize("block,group,tile", [(postings.BLOCK_ROWS, postings.QUERY_ROWS, postings.TILE), (3, 2, 7)])
@pytest.mark.parametrize("gathered", [True, False])
def test_sparse(data, monkeypatch, block, group, tile, gathered):
    """Few blocks or many of them, whole or by small tiles: the rows of all pairs."""
    rows, p, _, posts, asked = data
    rows_ = many.vectors(posts) if gathered else retrieve.word_vectors(p)
    for name, value in (("BLOCK_ROWS", block), ("QUERY_ROWS", group), ("TILE", tile)):
        monkeypatch.setattr(postings, name, value)
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in many.sparse(rows_, asked, 9).collect()}
    bags, want = {r[0]: Counter(r[2].split()) for r in rows}, {}
    for query in range(0, len(rows), 50):
        scored = sorted((-sum(n * bags[query][t] for t, n in bag.items()), i) for i, bag in bags.items() if bag.keys() & bags[query].keys())
        want |= {(query, k): (i, -s) for k, (s, i) in enumerate(scored[:9], 1)}
    assert got == want


def test_nothing(data):
    _, p, q, posts, asked = data
    assert many.dense(p.limit(0), q, 3).count() == 0 and many.dense(p, q.limit(0), 3).count() == 0
    assert many.sparse(many.vectors(posts.limit(0)), asked, 3).count() == 0 and many.sparse(retrieve.word_vectors(p), asked.limit(0), 3).count() == 0


def test_lanes_are_those_of_single_queries(data):
    rows, p, q, posts, asked = data
    active = p.select("sr_number").where("sr_number != 'SR 3'")
    for kind in ("library", "laws"):
        got = {}
        for r in retrieve.lane_many(p, retrieve.word_vectors(p), q, asked, 2026, kind, 7, {"lang": "de"}, "TI", active).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.id, round(r.final_score, 9)))
        for query in rows[::50][:2]:
            v = [float(np.float32(x)) for x in query[1]]
            one = retrieve.lane(p, posts, v, dict(Counter(query[2].split())), query[2], 2026, kind, 7, {"lang": "de"}, "TI", active).collect()
            assert sorted(got[query[0]]) == sorted((r["rank"], r.id, round(r.final_score, 9)) for r in one)


def test_shown_and_assembled(data):
    rows, p, q, _, _ = data
    ranked = retrieve.dense_many(p, q, 60).withColumn("words", F.substring("text", 1, 2))
    got, order = {}, {}
    for r in retrieve.shown(ranked, "doc_key", "words", 5, "query_id").collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    for r in ranked.collect():
        order.setdefault(r.query_id, {})[r["rank"]] = (r.id, r.doc_key, r.words)
    for query, found in order.items():
        keys, texts, kept = set(), set(), []
        for _, (i, k, t) in sorted(found.items()):
            if k not in keys and t not in texts and len(kept) < 5:
                keys.add(k)
                texts.add(t)
                kept.append(i)
        assert got[query] == dict(enumerate(kept, 1))
    chunks = p.select("doc_key", F.col("id").alias("chunk_index"), F.lit("facts").alias("chunk_type"), "text")
    out = {(r.query_id, r.doc_rank): r for r in retrieve.assemble(ranked, chunks, 2, 3, "query_id").collect()}
    for query, found in order.items():
        first = list(dict.fromkeys(k for _, (_, k, _) in sorted(found.items())))[:2]
        for n, key in enumerate(first, 1):
            own = [r for r in rows if r[6] == key][:3]
            assert out[query, n].context == "\n\n".join(f"[FACTS]\n{r[2]}" for r in own) and out[query, n].doc_key == key


@pytest.mark.parametrize("block", [1 << 22, 4])
def test_containing(spark, monkeypatch, block):
    monkeypatch.setattr(many, "BLOCK", block)
    texts = [(1, "abcabc"), (2, "bc\nx"), (3, ""), (4, None), (None, "cab")]
    items = [("a", "abc"), ("b", "bc"), ("b2", "bc"), ("e", ""), ("n", None), ("z", "zz")]
    docs = spark.createDataFrame(texts, "id long, text string")
    got = {(r.item_id, r.id) for r in many.containing(docs, spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert got == {(i, d) for i, w in items for d, t in texts if w is not None and t is not None and w in t}
    assert many.containing(docs, docs.limit(0).withColumnRenamed("id", "item_id")).count() == 0


def test_recall_of_the_nearest_lists(spark, monkeypatch):
    """Without the second pass at least nine of ten true neighbours are found in clustered points; with it, all."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 3000)] + 0.35 * rng.normal(size=(3000, 16))
    p = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, dense array<float>").repartition(4)
    q = p.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("dense").alias("query_dense"))
    monkeypatch.setattr(ivf, "LIST_ROWS", 100)
    y = np.array([[float(np.float32(c)) for c in v] for v in x])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    want = {i: set(np.lexsort((np.arange(3000), -(y @ y[i]).round(9)))[:10].tolist()) for i in range(0, 3000, 50)}
    index = ivf.Index(p)
    assert index.lists.n == 30
    for exact, least in ((False, 0.9), (True, 1.0)):
        got = {}
        for r in index.search(q, 10, exact=exact).collect():
            got.setdefault(r.query_id, set()).add(r.id)
        recall = np.mean([len(got[i] & want[i]) / 10 for i in want])
        assert recall >= least


def test_search_is_that_of_single_queries(spark, data):
    """All four lanes, row by row: expanded questions are searched, the questions themselves rerank, each has its own canton."""
    rows, p, q, posts, _ = data
    told = {0: "w1 w3 un permesso edilizia in ticino", 50: "w2 Kündigung der Wohnung in Zürich w5", 100: "w1 w2 w4"}
    asked = spark.createDataFrame([(i, [float(x) for x in rows[i][1]], t) for i, t in told.items()], "query_id long, query_dense array<float>, query_text string")
    active = p.select("sr_number").where("sr_number != 'SR 3'")
    collections = {"user": {"court": "C1"}, "firm": {"court": "C2"}, "none": {"court": "nowhere"}}
    got = {}
    for r in retrieve.search_many(p, retrieve.word_vectors(p), asked, collections, 2026, 7, active).collect():
        got.setdefault((r.query_id, r.lane), []).append((r["rank"], r.id, round(r.final_score, 9)))
    seen = {r.query_id: r for r in retrieve.questions(asked).collect()}
    assert seen[0].query_canton == "TI" and any(r.expanded != r.query_text for r in seen.values())
    for i, question in told.items():
        v, tokens = [float(np.float32(x)) for x in rows[i][1]], dict(Counter(words(seen[i].expanded)))
        for kind in ("library", "laws", "ordinances"):
            one = retrieve.lane(p, posts, v, tokens, question, 2026, kind, 7, None, seen[i].query_canton, active).collect()
            assert sorted(got[i, kind]) == sorted((r["rank"], r.id, round(r.final_score, 9)) for r in one)
        both = None
        for only in ("C1", "C2"):
            arm = retrieve.hybrid(p, posts, v, tokens, 250, {"court": only}).drop("rank")
            both = arm if both is None else both.unionByName(arm)
        best = retrieve.mmr(retrieve.first_rows(both, 500, None, F.desc("score"), "id").drop("dense"), 100, 0.98)
        one = retrieve.dedupe(retrieve.rerank(best, question, 100, 2026), "doc_key", 7).collect()
        assert sorted(got[i, "dossier"]) == sorted((r["rank"], r.id, round(r.final_score, 9)) for r in one)


def words(t):
    return re.findall(r"\w+", t.lower())


def test_sparse_search_sends_what_it_needs(data, monkeypatch):
    """Bounds are kept by octave, rows below a query's kth score stay where they are, and only the given queries' tokens are searched."""
    _, p, q, posts, asked = data
    index = postings.Postings(many.vectors(posts))
    assert index.bounds.columns == ["step", "t", "most"]
    tokens = asked.select(F.col("query_id").alias("_query"), F.xxhash64("token").alias("t"), F.col("weight").cast("double").alias("w"))
    whole = tokens.groupBy("_query").agg(F.collect_list("t").alias("ts"), F.collect_list("w").alias("ws"))
    pairs = whole.select(F.col("_query").alias("query_id"), F.lit(0).alias("block"), F.lit(3.0).alias("least"))
    some = index.scored(pairs, whole, 1000).collect()
    assert all(r.score >= 3 for r in some)
    assert len(some) == sum(r.score >= 3 for r in index.scored(pairs.withColumn("least", F.lit(None).cast("double")), whole, 1000).collect())
    seen, sparse = [], many.sparse
    monkeypatch.setattr(many, "sparse", lambda rows, told, k: seen.append(told) or sparse(rows, told, k))
    one = q.orderBy("query_id").limit(1)
    retrieve.hybrid_many(p, retrieve.word_vectors(p), one, asked, 3)
    assert [r.query_id for r in seen[0].select("query_id").distinct().collect()] == [one.first().query_id]


def test_tokens_are_not_exchanged(spark):
    """Texts are exchanged by id, then counted where they are; rows that share an id, or have none, count together."""
    rows = [(1, "a B a"), (None, "x"), (2, ""), (1, "b c"), (None, "x y"), (3, None)]
    posts = retrieve.postings(spark.createDataFrame(rows, "id long, text string").repartition(3))
    assert sorted((str(r.id), r.token, r.weight) for r in posts.collect()) == [("1", "a", 2.0), ("1", "b", 2.0), ("1", "c", 1.0), ("None", "x", 2.0), ("None", "y", 1.0)]
    plan = posts._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate explode" not in plan


def test_sparse_holds_little(spark, data, monkeypatch):
    """Lists lie in bounded rows, and are met by queries in a stream, not group by group; small pieces give the rows of all pairs."""
    rows, p, _, posts, asked = data
    for name, value in (("LISTED", 3), ("TOKENS", 5), ("HELD", 2), ("BLOCK_ROWS", 40), ("TILE", 7)):
        monkeypatch.setattr(postings, name, value)
    signed = F.when(F.xxhash64("token") % 2 == 0, -F.col("weight")).otherwise(F.col("weight"))
    for weight in (F.col("weight"), signed):
        index = postings.Postings(many.vectors(posts.withColumn("weight", weight)))
        assert index.lists.where("ts is not null").agg(F.max(F.size("places"))).first()[0] == 3
        whole = asked.groupBy(F.col("query_id").alias("_query")).agg(F.collect_list(F.xxhash64("token")).alias("ts"), F.collect_list("weight").alias("ws"))
        pairs = whole.select(F.col("_query").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(index.blocks - 1))).alias("block"), F.lit(None).cast("double").alias("least"))
        scored = index.scored(pairs, whole, 1000)
        assert "InPandas" not in scored._jdf.queryExecution().optimizedPlan().toString()
        theirs = posts.withColumn("weight", weight).join(asked.withColumnRenamed("weight", "own"), "token")
        want = {(r.query_id, r.id): r.score for r in theirs.groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("own")).alias("score")).collect()}
        assert {(r.query_id, r.id): r.score for r in scored.collect()} == want


def test_one_query_is_scored_by_tiles():
    """A query whose products are many times a tile is scored whole, and holds about a tile of them at a time."""
    width, n, tile = 100, 4000, 1 << 12
    block = postings.Block((0, 0), pa.array(range(width)), width * n)
    weight = np.where(np.arange(width * n) % 3 == 0, -1.0, 2.0)
    block.add(np.arange(n), np.full(n, width), np.tile(np.arange(width), n), weight)
    block.close()
    told, given = np.arange(n), np.arange(n) % 7 - 3.0
    tracemalloc.start()
    (query, near, score), *more = block.best(told, given, np.array([n]), np.array([np.nan]), 5, tile)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = given @ weight.reshape(n, width)
    assert not more and query == 0 and near.tolist() == sorted(range(width), key=lambda i: (-want[i], i))[:5] and score.tolist() == want[near].tolist()
    assert peak < width * n * 8 / 2  # not even half of its products
