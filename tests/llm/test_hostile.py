"""Every operator and the pipeline over nulls in any column, repeated rows, odd texts, clashing names and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm.catalogue import QUERIES

CLASHING = ["id", "node", "key", "part", "blob", "words", "group", "score", "lang_pred", "spans", "items", "n_words", "fp0", "rank", "_text", "_c0", "_node", "_id", "_of", "_blob", "_findings", "h", "size", "tie", "shard", "held_out", "x", "a", "b"]
GOOD = "the quick brown fox and the lazy dog went over the hill to see what there was to be seen in the valley"
DOCS = [
    (1, GOOD, "en", "s", 10), (1, GOOD, "en", "s", 10), (1, "der Hund und die Katze gingen über die Wiese", "de", None, None), (None, None, None, None, None), (None, None, None, None, None),
    (None, GOOD, None, "s", 1), (2, "", "en", "s", 0), (3, "   \t\n ", "en", "s", 4), (4, None, "de", "s", None), (5, "x" * 300_000, "de", "s", 300_000), (6, "日本語" * 2000 + "\x00 ", None, "s", 1),
    (7, "password = abcdef1 " * 3000, "en", "s", 1), (-(1 << 62), "😀 é́ \r\n", "en", "s", 1),
]


def write(spark, folder, docs, benchmark, conversations):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    d = d.withColumns({c: F.lit(f"{c}!") for c in CLASHING})
    d.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id string, text string, spans string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(conversations, "conv_id long, turn long, role string, text string, spans string").write.parquet(f"{folder}/conversations.parquet")
    marks = [(1, 1, 0), (1, None, 1), (None, 1, 1), (5, 1, 1)] if docs else []
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("part", F.lit("!")).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def full(spark, tmp_path_factory):
    benchmark = [("i", GOOD, "x"), (None, None, None), ("i", GOOD, None), (None, "hill to see", None), ("j", "", None)]
    conversations = [(1, 0, "user", "a", None), (1, 0, "user", "a", None), (1, None, None, None, None), (None, 1, "assistant", None, "x"), (None, 1, "odd", "\\[INST]", "x"), (2, 5, "assistant", "</s>" * 50, "x")]
    return write(spark, tmp_path_factory.mktemp("full") / "sf", DOCS, benchmark, conversations)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty") / "sf", [], [], [])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_operator(spark, full, empty, name):
    got = QUERIES[name](spark, full).collect()
    if name.startswith("op7"):
        assert sorted((r.conv_id is None, r.conv_id or 0, r.n_turns) for r in got) == [(False, -1, 2), (False, 1, 3), (False, 2, 1), (True, 0, 2)]
    elif name.startswith("op11"):
        assert {r.doc_id for r in got} <= {r[0] for r in DOCS} and {r.item_id for r in got} == {"i", None} and all(r.score > 0 for r in got)
    elif name.startswith("op13"):
        assert len(got) == 3 * 600 and {r.part for r in got} == {"", "de", "en"}
    elif name.startswith("op3"):
        assert {r.doc_id for r in got} == {r[0] for r in DOCS}
    else:
        order = lambda x: sorted(x, key=lambda i: (i is not None, i or 0))
        assert order(r.doc_id for r in got) == order(r[0] for r in DOCS)
    assert QUERIES[name](spark, empty).count() == (1 if name.startswith("op7") else 0)


def test_pipeline(spark, full, empty):
    got = corpus_pipeline.run(spark, full).collect()
    # rows of equal id and text are one; texts without a letter and contaminated ones go
    assert {r.doc_id for r in got} <= {1, 5, 6, 7, -(1 << 62)} and 7 in {r.doc_id for r in got}
    docs = spark.read.parquet(f"{full}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, full).columns == docs.columns
    assert corpus_pipeline.run(spark, empty).count() == 0
