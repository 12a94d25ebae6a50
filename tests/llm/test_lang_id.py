import random

import numpy as np
import pytest

from lexmill.llm import lang_id as li


def test_code_lengths_are_those_of_the_trees():
    rng = random.Random(1)
    samples = {"x": [bytes(rng.choices(b"abc ", k=300))], "y": [bytes(rng.choices(b"bcd ", k=300))]}
    trees = li.ContextTrees({k: li.frequent(v, 3, 10**6) for k, v in samples.items()}, order=3)

    def bits(lang, context, byte):
        text = samples[lang][0]
        after = [text[i + len(context)] for i in range(len(text) - len(context)) if text[i : i + len(context)] == context]
        if after:
            total = len(after) + len(set(after))
            if byte in after:
                return -np.log2(after.count(byte) / total)
            escape = -np.log2(len(set(after)) / total)
        else:
            escape = 0
        return escape + (bits(lang, context[1:], byte) if context else 8)

    for text in (b"abca dcb", bytes(rng.choices(b"abcd z", k=1300))):
        got = trees.code_lengths([text, b"", text])
        for k, lang in enumerate(trees.langs):
            want = sum(bits(lang, text[max(0, i - 3) : i], text[i]) for i in range(len(text)))
            assert got[0, k] == pytest.approx(want, rel=1e-4) and got[2, k] == pytest.approx(want, rel=1e-4)
        assert not got[1].any()


def test_rows(spark):
    rows = [(i, t, lang, 0.5) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 20)]
    rows += [(200 + k, "xyz"[:k], "fr", 0.0) for k in range(4)]
    rows += [(100, None, "en", 0.0), (101, " 12 !", None, 0.0), (None, "the dog", None, 0.0), (102, "the and " * 40000, None, 0.0), (103, "", "en", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = li.train(df)
    got = {r.doc_id: r for r in li.predict(df, model).collect()}
    assert got[100].lang_pred == got[101].lang_pred == got[103].lang_pred == "und" and got[102].lang_pred == got[None].lang_pred == "en"
    assert all(got[i].lang_pred == rows[i][2] and 0.5 < got[i].score <= 1 for i in range(40))
    assert li.train(df.limit(0)) == []
    assert {r.lang_pred for r in li.predict(df, []).collect()} == {"und"}
    assert li.predict(df.limit(0), model).count() == 0


def test_many_languages(spark):
    """More languages than a block holds, one far more frequent than the others, each with letters of its own."""
    word = lambda k: chr(0x4E00 + 16 * k) + chr(0x4E01 + 16 * k)
    rows = [(None, f"{word(k)} {word(k) * (j % 7)} a" + " b" * (j % 11), f"l{k:02d}") for k in range(19) for j in range(3 if k else 3000)]
    df = spark.createDataFrame(rows + [(None, word(0), "l00")] * 2000, "doc_id long, text string, lang string")
    model = li.train(df)
    assert [len(b) for b in model] == [4, 4, 4, 4, 3] and li.sampled(df).where("lang = 'l00'").count() <= li.SAMPLE_DOCS
    ask = spark.createDataFrame([(k, word(k) * 5) for k in range(19)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in li.predict(ask, model).collect()} == {k: f"l{k:02d}" for k in range(19)}


def test_sample_is_from_whole_texts(spark):
    df = spark.createDataFrame([(i, "x" * 5 * li.SAMPLE_BYTES + "y" * 5 * li.SAMPLE_BYTES, "l") for i in range(50)], "doc_id long, text string, lang string")
    assert {r.piece[0] for r in li.sampled(df).collect()} == {"x", "y"}


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    got = [r for r in li.op2(spark, path).collect() if r.held_out]
    assert len(got) > 200 and sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.97 * len(got)
