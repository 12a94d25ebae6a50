import pytest
from pyspark.sql import functions as F

from lexmill.functions import pii, text
from lexmill.operators import review, tables
from lexmill.sources import parsers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_texts(spark):
    lit, none = F.lit, F.lit(None).cast("string")
    assert one(spark, text.shown_text(lit("Tribunale federale x"), none, lit("Diritto 1\nrest"), lit("p"))) == "rest"
    assert one(spark, text.shown_text(none, none, none, lit("y" * 300))) == "y" * 250 + "..."
    assert one(spark, text.shown_text(lit("Bundesgericht"), lit(""), none, lit("p"))) == "Bundesgericht"
    assert one(spark, text.prompt_budget(lit("a" * 50000), lit(13000), 12000)) == ""
    assert one(spark, text.decrypted(text.encrypted(lit("é" * 9), lit("k" * 32)), lit("k" * 32))) == "é" * 9
    assert one(spark, text.decrypted(text.encrypted(lit("a"), lit("k" * 16)), lit("l" * 16))) is None
    assert one(spark, text.decision_line(lit("BGE-140-III-348_chunk_1"), lit(2014), none, lit("de"), lit("T"))) == "### BGE 140 III 348 (2014) [DE]\n\nT"
    assert one(spark, text.law_card(lit(1), lit("OR"), lit("1"), lit("220"), lit("de"), lit(0.987), lit("t" * 301))).endswith("Score: 0.99\n\n> " + "t" * 300 + "...\n")
    assert one(spark, pii.kinds(pii.found(lit("a@b.ch 756.1234.5678.90")), ["EMAIL_ADDRESS"])) == ["SWISS_AHV"]


def test_parsers(spark):
    rows = spark.createDataFrame([("a", "CH_BGE_1", "Sachverhalt:\nam 3. März 2020\nErwägung:\nArt. 1 OR\nDemnach erkennt das Gericht:\nabgewiesen"), ("b", "x", None), ("c", "x", "  ")], "id string, file_name string, text string")
    got = {r.id: r for r in parsers.parse(rows, "decision").collect()}
    assert (got["a"].year, got["a"].court, got["a"].outcome, got["a"].metadata.citations.laws) == (2020, "CH_BGE", "dismissed", ["Art. 1 OR"])
    assert got["b"].date is None and got["b"].language == "de"
    assert {r.id: r.status for r in parsers.attempted(rows).collect()} == {"a": "success", "b": "error", "c": "error"}
    with pytest.raises(KeyError):
        parsers.parse(rows, "none")


def test_upkeep(spark, tmp_path):
    rows = spark.createDataFrame([("x_chunk_a_chunk_1", 1), ("y", 2), (None, 3)], "id string, n int")
    assert sorted(str(r.id) for r in tables.base_ids(rows).collect()) == ["None", "x_chunk_a", "y"]
    assert tables.next_number(rows.limit(0), "id").first().next_number == 0
    assert tables.written(rows, str(tmp_path / "t"), null_ids=F.count_if(F.col("id").isNull())) == {"rows": 3, "null_ids": 1}
    cells = spark.createDataFrame([("d", "b", "true"), ("d", "a", None), ("d", "c", "z"), ("d", "unknown", "1")], "doc string, field string, value string")
    fields = spark.createDataFrame([("a", "A", 1, "string"), ("b", "B", 2, "boolean"), ("c", "C", 0, "string")], "name string, display_name string, position int, kind string")
    assert review.context(cells, fields).first().context == "- **C**: z\n- **B**: Yes"


CANTONAL = [
    ("Testa\nFatti:\nuno\nDiritto:\ndue\nPer questi motivi\ntre", ("Fatti:\nuno", "Diritto:\ndue", "Per questi motivi\ntre")),
    ("Testa\nIn fatto e in diritto\ndue\nDispositivo\ntre", ("", "In fatto e in diritto\ndue", "Dispositivo\ntre")),
    ("uno\nConsiderato\ndue", ("uno", "Considerato\ndue", "")),
    ("solo testo\ndecide:\ntre", ("", "solo testo", "decide:\ntre")),
    ("", ("", "", "")),
]


def test_cantonal_sections(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CANTONAL)], "k int, t string")
    got = {r.k: tuple(r.s) for r in rows.select("k", text.cantonal_sections("t").alias("s")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(CANTONAL)}
    one_ = spark.createDataFrame([("a", "TI_TRAC_1", CANTONAL[0][0] + "\nricorso contro la decisione di Lugano, ecc."), ("b", "TI_X", None)], "id string, file_name string, text string")
    out = {r.id: r for r in parsers.parse(one_, "cantonal decision").collect()}
    assert (out["a"].court, out["a"].language, out["a"].content.facts, out["a"].metadata.lower_court) == ("CH_TI_TRAC", "it", "Fatti: uno", "Lugano")
    assert out["b"].court == "CH_TI" and out["b"].content.reasoning is None


def test_presentation(spark):
    ids = {"BGE 140 iii 348_chunk_2": "BGE-140-III-348", "bge-102-Ia-35": "BGE-102-IA-35", " ch_ti  a--1 Chunk 7": "CH-TI-A-1", "5A-190-2013": "5A-190-2013"}
    rows = spark.createDataFrame([(k,) for k in ids], "i string")
    assert {r.i: r.x for r in rows.select("i", text.presentation_id("i").alias("x")).collect()} == ids
    assert one(spark, text.presentation_text(F.lit(" a \n b" + "c" * 200))) == "a b" + "c" * 144
    assert one(spark, text.presentation_text(F.lit(None).cast("string"))) == ""
