import uuid

import pytest
from pyspark.sql import functions as F

from lexmill.functions import pii, text, vector
from lexmill.operators import articles, chunk
from lexmill.plans.catalogue import QUERIES


def one(spark, make, *values):
    """The function's results over literal strings."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", make("v").alias("x")).orderBy("i").collect()]


def test_ids(spark):
    assert one(spark, text.normalize_decision_id, "BGE-102-IA-35_chunk_2", "BGer 001 1C-346-2008 2009-02-20 chunk 2", "", None) == ["BGE-102-IA-35", "BGER-001-1C-346-2008-2009-02-20", "", ""]
    raw = ["0_chunk_0", "é", ""]
    assert one(spark, text.uuid5_url, *raw) == [str(uuid.uuid5(uuid.NAMESPACE_URL, x)) for x in raw]
    assert one(spark, text.sr_of_file, "SR_220_de.pdf", "SR_311_0_de.pdf", "SR_172_021_de.pdf", "x.pdf") == ["220", "311.0", "172.021", None]
    assert one(spark, text.case_id_of_file, "TI_CATI_001_80-2016-4_2016-09-16") == ["TI_CATI_001_80-2016-4"]
    assert one(spark, text.law_type, "0.101", "101", "220", "311.0", "x", "1000") == ["international", "constitutional", "civil", "criminal", "other", "other"]


def test_citations(spark):
    laws = lambda c: text.legal_citations(c, ["OR", "StGB", "LAA"])
    assert one(spark, laws, "Art. 337 OR", "Art. 10, 11 und 12 StGB", "Art. 5 Abs. 1 Bst. c OR", "Art. 7 xyz") == [["Art. 337 OR"], ["Art. 10 STGB", "Art. 11 STGB", "Art. 12 STGB"], one(spark, laws, "Art. 5 Abs. 1 Bst. c OR")[0], []]
    assert one(spark, text.case_citations, "BGE 140 III 348 und ATF 132 I 12; 6b_123/2020") == [["6B_123/2020", "BGE 132 I 12", "BGE 140 III 348"]]
    assert one(spark, text.clean_law, "Art. 123a756\n\n\n\n12  \nSR 220 ") == ["Art. 123a\n\n\nSR 220"]
    assert one(spark, text.date_of, "am 3. März 2020", "le 5 mai 2019", "15.03.2024", "2. Kammer 2020", "1. 2. 1999") == ["2020-03-03", "2019-05-05", None, None, "1999-02-01"]


def test_sections(spark):
    t = "Kopf\n  Sachverhalt:\nfakt\nErwägung:\ngrund\nDemnach erkennt es:\nspruch"
    got = one(spark, lambda c: text.sections(c, F.lit("de")), t, "nichts", "I. a\nII. b\nIII. c")
    assert (got[0].regeste, got[0].facts, got[0].reasoning, got[0].decision) == ("Kopf", "Sachverhalt:\nfakt", "Erwägung:\ngrund", "Demnach erkennt es:\nspruch")
    assert got[1].reasoning == "nichts" and got[1].facts == ""
    assert (got[2].facts, got[2].reasoning, got[2].decision) == ("I. a", "II. b", "III. c")


def test_previews(spark):
    long = "wort " * 150
    assert one(spark, lambda c: text.preview_batch(c, 20), "a  b", long) == ["a b", "wort wort wort wort..."]
    assert one(spark, lambda c: text.preview_decision(c, 9), "wort wort", "kurz") == ["wort...", "kurz"]
    assert one(spark, lambda c: text.preview_law(c, 4), "a  b c", "abc") == ["a b ...", "abc"]


def test_queries(spark):
    assert one(spark, text.query_language, "quale licenza", "le permis de construction est quand", "der Bau", "zzz") == ["it", "fr", "de", None]
    assert one(spark, text.query_canton, "in Zurich", "x") == ["ZH", None]
    assert one(spark, text.expand_query, "divorzio", "zz") == ["divorzio separazione mantenimento affidamento CC CPC", "zz"]
    assert one(spark, text.document_language, "le la et", "il la e che", "", "der die") == ["fr", "it", "de", "de"]
    assert one(spark, text.html_to_text, "<p>a&nbsp;b</p><p>c</p><script>x</script>") == ["a b\nc"]


@pytest.mark.parametrize(
    ("body", "types"),
    [
        ("756.1234.5678.90", ["SWISS_AHV"]), ("756 1234 5678 90", ["SWISS_AHV"]), ("7561234567890", ["SWISS_AHV"]), ("123.4567.8901.23", []),
        ("a@b.com, b@c.com", ["EMAIL_ADDRESS"] * 2), ("CH93 0076 2011 6238 5295 7", ["SWISS_IBAN"]), ("CH9300762011623852957", ["SWISS_IBAN"]),
    ],
)
def test_pii(spark, body, types):
    df = spark.createDataFrame([(1, body)], "id int, t string")
    own = ["SWISS_AHV", "SWISS_IBAN", "EMAIL_ADDRESS"]
    assert [r.entity_type for r in pii.detect(df, "id", "t", own).collect()] == types
    for r in pii.detect(df, "id", "t", own).collect():
        assert body[r.start : r.end] == r.text


def test_scores(spark):
    r = spark.range(1).select(
        vector.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("a"), vector.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("b"),
        *(vector.recency(F.lit(y), 2026).alias(f"y{y}") for y in (1850, 1900, 2000, 2026, 2030)),
        *(vector.tier(F.lit(t).cast("double"), F.lit(v)).alias(f"t{k}") for k, (t, v) in enumerate([(0.8, 0.05), (0.8, 0.2), (0.6, 0.0), (0.55, 0.0), (None, 0.0)])),
    ).first()
    assert (r.a, r.b, r.y1850, r.y1900, r.y2026, r.y2030) == (0, 0, 0, 0, 1, 1) and r.y2000 == pytest.approx(0.79365, abs=1e-4)
    assert [r.t0, r.t1, r.t2, r.t3, r.t4] == ["HIGH", "MEDIUM", "MEDIUM", "LOW", "NONE"]


def brute_pack(paras, most, least):
    out, cur, n = [], [], 0
    for p in paras:
        k = len(p.split())
        if n + k > most and cur:
            out.append("\n\n".join(cur))
            cur, n = [], 0
        cur.append(p)
        n += k
    if out and n < least:
        out[-1] = "\n\n".join([out[-1], *cur])
    else:
        out.append("\n\n".join(cur))
    return out


def test_packing(spark):
    import random

    rng = random.Random(1)
    texts = ["\n\n".join("w " * rng.randint(1, 12) + "x" for _ in range(rng.randint(1, 20))) for _ in range(30)] + ["one long " * 40]
    got = one(spark, lambda c: chunk.chunk_long_text(F.col(c), 20, 6), *texts)
    for t, g in zip(texts, got, strict=True):
        assert g == ([t] if len(t.split()) <= 20 else brute_pack(t.split("\n\n"), 20, 6))


def test_windows_cover(spark):
    texts = ["Satz eins. Satz zwei ist länger. " * 30, "x" * 500, "kurz", ""]
    got = one(spark, lambda c: chunk.windows(F.col(c), 100, 20, [". ", " "], 0.5), *texts)
    for t, g in zip(texts, got, strict=True):
        if not t:
            assert g == []
            continue
        assert g[0].start == 0 and g[-1].end == len(t)
        assert all(b.start == a.end - 20 and b.start < b.end <= len(t) for a, b in zip(g, g[1:]))
        assert all(x.end - x.start <= 100 for x in g)


def test_windows_of_long_and_null_texts(spark):
    """Every window was cut out some dozens of times by a fold, counting from the text's beginning; a null text had a window."""
    text = "wort " * 60_000 + "ende. " * 20_000
    df = spark.createDataFrame([(text,), (None,)], "c string").coalesce(1)
    got = df.select(chunk.chunk_chars(F.col("c")))
    assert "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString()
    long, none = (r[0] for r in got.collect())
    assert not none and long[0] == (0, 1500) and long[-1].end == len(text)
    assert all(b.start == a.end - 200 and text[: a.end].endswith((" ", ". ")) for a, b in zip(long, long[1:]))


def test_articles(spark):
    law = "1. Titel: Anfang\nArt. 1 Zweck\nDieses Gesetz\nArt. 2\nGeltung\n1 Text\n2. Titel: Mitte\n1. Kapitel: Eins\nArt. 3a\n2 Nummer\nAbschnitt: Rest\nArt. 4bis Ende\nSchluss"
    got = {r.article_number: r for r in articles.articles(spark.createDataFrame([(1, law)], "id int, t string"), "id", "t").collect()}
    assert {k: (r.article_title, r.title, r.chapter, r.section) for k, r in got.items()} == {
        "1": ("Zweck", "1. Titel: Anfang", None, None), "2": ("Geltung", "1. Titel: Anfang", None, None), "3a": (None, "2. Titel: Mitte", "1. Kapitel: Eins", None), "4bis": ("Ende", "2. Titel: Mitte", "1. Kapitel: Eins", "Abschnitt: Rest"),
    }
    assert got["2"].article_text.startswith("1 Text") and got["1"].article_text == "Dieses Gesetz"


def test_lower_court_ends_at_words(spark):
    """names may begin with vom, du or del; articles of a date still end a court's name."""
    told = {
        "Gegen das Urteil des Obergerichts Delascoasra vom 1. Mai 2019": "Obergerichts Delascoasra",
        "gegen den Entscheid des Gerichts Vomwald, Kammer": "Gerichts Vomwald",
        "contre l'arrêt de la Cour Dupont du 5 mai 2019": "Cour Dupont",
        "contro la sentenza della Camera civile dell'8 maggio 2019": "Camera civile",
        "contro la sentenza della Camera civile del 3 maggio 2019": "Camera civile",
    }
    rows = spark.createDataFrame([(k,) for k in told], "t string").select("t", text.lower_court("t").alias("c")).collect()
    assert {r.t: r.c for r in rows} == told


def test_headers_are_looked_for_once(spark):
    """Each header was looked for by two lazy patterns a word, anew for every part that its place bounds; places count characters, not UTF-16 units."""
    t = "😀 Kopf\nTatbestand: es war 😀\n  Sachverhalt\nmehr\n\n Erwägung: weil\nUrteil: gut"
    df = spark.createDataFrame([(t,), ("Urteil: nur",), ("nichts",), (None,)], "c string").coalesce(1)
    got = df.select(text.sections("c", F.lit("de")).alias("x"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Sachverhalt") == 1 and r"\A" not in plan
    assert [tuple(r.x) for r in got.collect()] == [
        ("😀 Kopf", "Tatbestand: es war 😀\n  Sachverhalt\nmehr", "Erwägung: weil", "Urteil: gut"), (None, "", "", "Urteil: nur"), (None, "", "nichts", ""), (None, "", None, ""),
    ]


def test_decisions_without_unread_metadata(spark):
    plan = QUERIES["v2_parse_decisions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "ATF" in plan and "Besetzung" not in plan and "Vorinstanz" not in plan
