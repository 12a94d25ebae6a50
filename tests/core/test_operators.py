import json

from pyspark.sql import functions as F

from lexmill.operators import filters, retrieve, tables
from lexmill.sources import readers
from lexmill.streaming import ingest


def points(spark, rows):
    return spark.createDataFrame(rows, "id string, dense array<float>, score double, rank int, doc_key string, sr_number string, court string, source string")


def test_mmr(spark):
    half, other = [1.0] * 4 + [0.0] * 4, [0.0] * 4 + [1.0] * 4
    rows = points(spark, [(f"doc{k}", other if k == 4 else half, 1.0 - k / 100, k, f"k{k}", None, None, None) for k in (1, 2, 3, 4)])
    got = [r.id for r in retrieve.mmr(rows, 3, 0.3, half).orderBy("rank").collect()]
    assert len(got) == 3 and got[0] == "doc1" and "doc4" in got
    assert [r.id for r in retrieve.mmr(rows.limit(2), 2, 0.3, half).orderBy("rank").collect()] == ["doc1", "doc2"]


def brute_mmr(rel, sim, k, lam):
    got = [0]
    while len(got) < min(k, len(rel)):
        best = None
        for i in range(len(rel)):
            if i not in got:
                v = lam * rel[i] - (1 - lam) * max(sim[i][j] for j in got)
                if best is None or v > best[0]:
                    best = (v, i)
        got.append(best[1])
    return got


def test_pick_is_greedy():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(20):
        x = rng.random((12, 12)).round(1)
        rel = rng.random(12).round(1)
        assert retrieve.pick(rel, (x + x.T) / 2, 5, 0.6) == brute_mmr(rel, (x + x.T) / 2, 5, 0.6)


def test_filter_and_active(spark):
    df = spark.createDataFrame([(1, "a", 2000), (2, "b", 2010), (3, None, None)], "id int, source string, year int")
    ids = lambda f: [r.id for r in df.where(filters.compile_filter(f)).orderBy("id").collect()]
    assert ids(None) == [1, 2, 3] and ids({"sources": []}) == [1, 2, 3] and ids({"sources": ["a"]}) == [1]
    assert ids({"year_range": {"min": 2005, "max": None}}) == [2] and ids({"id": 3}) == [3] and ids({"id": []}) == []
    assert filters.active_only(df, df.limit(0), "id").count() == 3


def test_tables(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, t int")
    assert sorted(tuple(r)[:2] for r in tables.upsert(old, new, "k", "t").collect()) == [(1, "a"), (2, "y"), (3, "z")]
    assert tables.delete(old, F.col("k") == 1).count() == 1 and tables.missing(old, new, "k").count() == 1
    assert sorted(r.v for r in tables.set_where(old, F.col("k") == 1, {"v": F.lit("q")}).collect()) == ["b", "q"]


def test_readers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.json").write_text(json.dumps({"id": "x", "year": 2001, "metadata": {"judges": ["J"]}}))
    (tmp_path / "d/b.json").write_text("{broken")
    (tmp_path / "d/c.json").write_text("")
    got = readers.decisions(spark, str(tmp_path / "d")).collect()
    assert [r.id for r in got] == ["x"] and got[0].metadata.judges == ["J"] and got[0]._source_file == "a.json"
    (tmp_path / "l.json").write_text(json.dumps([{"id": "1", "sr_number": "220"}, {"id": "2"}]))
    assert readers.articles(spark, str(tmp_path / "l.json")).count() == 2
    (tmp_path / "u").mkdir()
    (tmp_path / "u/n.txt").write_text("hallo")
    up = readers.uploads(spark, str(tmp_path / "u")).first()
    assert up.file_type == "txt" and up.full_text == "hallo" and len(up.file_hash) == 16
    assert [r.stem for r in readers.stems(spark, str(tmp_path / "u")).collect()] == ["n"]


def test_limits(spark):
    rows = [(k, "a", f"2024-01-01 00:00:{k:02d}") for k in range(8)] + [(9, "b", "2024-01-01 00:00:01")]
    df = spark.createDataFrame(rows, "event_id int, u string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.event_id: r.allowed for r in ingest.rate_limited(df, "u", "ts", {5: 3}).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False, 9: True}
    fails = df.withColumn("failed", F.col("event_id") != 3)
    assert {r.event_id: r.failures for r in ingest.lockouts(fails, "u", "ts", "failed").collect()} == {0: 1, 1: 2, 2: 3, 3: 0, 4: 1, 5: 2, 6: 3, 7: 4, 9: 1}


def test_stream_windows(spark, tmp_path):
    rows = spark.createDataFrame([(k, "a", f"2024-01-01 0{k}:10:00") for k in range(4)], "event_id int, u string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ingest.window_counts(stream, "ts", "u").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert spark.table("w").count() == 4
    ingest.ingest(spark, str(tmp_path / "in"), "event_id int, u string, ts timestamp_ntz", str(tmp_path / "out"), str(tmp_path / "c2"), 1)
    ingest.ingest(spark, str(tmp_path / "in"), "event_id int, u string, ts timestamp_ntz", str(tmp_path / "out"), str(tmp_path / "c2"), 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_rerank_takes_sums_that_differ_in_last_bits_as_ties(spark):
    """3/10 + 0.1 * 0 and 0.1 + 0.2 are one score, so the rank before decides."""
    rows = spark.createDataFrame([(1, 1, 1900, "x", 0.3), (2, 2, 1900, "x", 0.1 + 0.2)], "id long, rank int, year int, text string, base double")
    got = retrieve.rerank(rows, "x", 2, 2026, scorer=lambda q, b: F.col("base"))
    assert [(r.id, r["rank"]) for r in got.orderBy("rank").collect()] == [(1, 1), (2, 2)]
