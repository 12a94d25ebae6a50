import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def words(rng, pool, n):
    return " ".join(rng.choices(pool, k=n))


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    en = ["the", "and", "of"] + [f"thing{i}ing" for i in range(2000)]
    clean = [words(rng, en, rng.randint(60, 200)) for _ in range(60)]
    bench = words(rng, en, 40)
    rows = [(i, t, "en") for i, t in enumerate(clean)]
    rows += [(100, clean[3], "en"), (101, clean[4].upper(), "en")]  # exact copies but for case
    near = clean[5].split()
    near[10] = "changed"
    rows += [(102, " ".join(near), "en"), (103, None, "en"), (104, "12 34", None), (105, "so it is: " + bench, "en")]
    rows += [(106, clean[0][:0] + words(rng, en, 100) + " password=hunter2222 end", "en"), (107, words(rng, en, 20000), None), (108, "", "en")]
    df = spark.createDataFrame([(i, t, l, "s", len(t or ""), 1) for i, t, l in rows], "doc_id long, text string, lang string, source string, n_chars long, fp0 int")
    sf = str(tmp_path)
    df.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/{k}")
        docs = spark.read.parquet(f"{sf}/{k}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if k < 4:
            assert docs.columns == df.columns
    ids = {r[0] for r in rows}
    assert ids - kept[0] == {103, 104, 108}
    assert kept[0] - kept[1] == {100, 101, 102}
    assert kept[1] - kept[2] == {105}
    assert kept[3] == kept[2] and kept[4] == kept[3]
    text = {r.doc_id: r for r in spark.read.parquet(f"{sf}/3").collect()}
    assert text[106].text.endswith(" [assign] end") and text[106].n_chars == len(text[106].text)
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_repeated_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "same text here", "en", "s", 5), (1, "same text here", "en", "s", 5), (None, "other", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [0, 1]


def test_repeated_ids_lose_no_text(spark):
    rows = [(None, "first text without an id", "en"), (None, "second one, also without", "en"), (None, "first text without an id", "en"), (3, "three is a text of its own", "en")]
    rows += [(5, "five has two texts, and this is a copy", "en"), (5, "this one is its own", "en"), (2, "five has two texts, and this is a copy", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert got == sorted([(0, rows[0][1]), (0, rows[1][1]), (3, rows[3][1]), (5, rows[5][1]), (2, rows[6][1])])
