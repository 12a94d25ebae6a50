import json
import random

from pyspark.sql import Row

from lexmill.operators import encode, review, tables
from lexmill.sources import readers


def test_cells_and_citations(spark, tmp_path):
    answers = spark.createDataFrame(
        [("a", '```json\n{"party": {"value": "ACME", "quote": "ACME  Corp signs", "page": 9}, "year": 2020}\n```'), ("b", "no json"), ("c", '{"party": {"value": "X", "quote": "not there", "page": 3}}')],
        "doc string, answer string",
    )
    (tmp_path / "p.json").write_text("\n".join(json.dumps({"preset": "t", "position": k, "name": n, "kind": kind, "description": "d", "options": o}) for k, (n, kind, o) in enumerate([("party", "string", []), ("year", "integer", []), ("risk", "enum", ["Low", "High"])])))
    fields = review.load_presets(spark, str(tmp_path / "p.json"))
    pages = spark.createDataFrame([("a", 1, "nothing"), ("a", 2, "here acme corp\nsigns it"), ("c", 1, "else")], "doc string, page int, text string")
    got = {(r.doc, r.field): r for r in review.cells(answers, review.preset(fields, "t"), pages).collect()}
    assert len(got) == 9
    assert (got["a", "party"].value, got["a", "party"].page, got["a", "year"].value, got["a", "risk"].value) == ("ACME", 2, "2020", None)
    assert got["c", "party"].page == 3 and got["b", "party"].error == "no object" and got["a", "party"].error is None
    assert review.prompt_schema(fields).first().schema == "- party (string): d\n- year (integer): d\n- risk (one of: Low, High): d"
    marks = spark.createDataFrame([("a", 0), ("a", 7), ("a", 99)], "doc string, pos int")
    spans = spark.createDataFrame([("a", 1, 0, 7), ("a", 2, 7, 20)], "doc string, page int, char_start int, char_end int")
    assert sorted((r.pos, r.page) for r in review.page_at(marks, spans).collect()) == [(0, 1), (7, 2)]


def test_kinds_and_sheets(spark):
    fields = [Row(name=n, kind=k, options=o) for n, k, o in (("risk", "enum", ["Low", "High"]), ("n", "integer", None), ("free", "string", None))]
    told = ['{"risk": "Low", "n": 7, "free": null}', '{"risk": {"value": "Huge", "quote": "' + "q" * 300 + '", "section": "s"}, "n": "7.5", "free": {"value": {"a": 1}}}', "[1]", None, ""]
    answers = spark.createDataFrame(list(enumerate(told)), "doc int, answer string")
    pages = spark.createDataFrame([(1, 4, "x" + "q" * 60)], "doc int, page int, text string")
    rows = review.cells(answers, fields, pages).collect()
    got = {(r.doc, r.field): (r.value, r.page, r.section, None if r.quote is None else len(r.quote), r.error) for r in rows}
    assert got[0, "risk"] == ("Low", None, None, None, None) and got[0, "n"] == ("7", None, None, None, None) and got[0, "free"][0] is None
    assert got[1, "risk"] == ("Huge", 4, "s", 200, "no option") and got[1, "n"][4] == "no integer" and got[1, "free"][0] == '{"a":1}'
    assert {got[d, "n"][4] for d in (2, 3, 4)} == {"no object"}
    cells = spark.createDataFrame(rows)
    sheets = review.sheets(cells, [Row(name=n) for n in ("risk", "n", "free")])
    assert {r.doc: (r.risk, r.n) for r in sheets["data"].collect()}[0] == ("Low", "7") and sheets["citations"].count() == 1
    assert {r.field: (r.filled, r.cited, r.errors) for r in sheets["summary"].collect()} == {"risk": (2, 1, 4), "n": (2, 0, 4), "free": (1, 0, 3)}


def test_page_bins(spark):
    rng, spans, at = random.Random(1), [], {d: 0 for d in range(4)}
    for n in range(200):
        d, width = rng.randrange(4), rng.choice([0, 1, 50, 5000, 20000])
        spans.append((d, n, at[d], at[d] + width))
        at[d] += width
    marks = [(d, rng.randrange(-10, at[d] + 100)) for d in range(4) for _ in range(300)] + [(9, 0), (0, None)]
    got = sorted((r.doc, r.pos, r.page) for r in review.page_at(spark.createDataFrame(marks, "doc int, pos int"), spark.createDataFrame(spans, "doc int, page int, char_start int, char_end int")).collect())
    assert got == sorted((d, p, n) for d, p in marks if p is not None for e, n, a, b in spans if e == d and a <= p < b)


def test_encoder(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b")], "id int, text string")
    got = {r.id: r for r in encode.encode(df, encode.hashed(8)).collect()}
    assert got[1].dense == got[3].dense and abs(sum(x * x for x in got[1].dense) - 1) < 1e-6 and not any(got[2].dense)
    assert got[1].sparse == {"a": 1.0, "b": 1.0} and got[2].sparse == {} and got[2].error is None


def failing():
    own = encode.hashed(4)()

    def run(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return own(texts)

    return run


def test_failures_are_isolated_and_runs_go_on(spark, tmp_path):
    rows = [(i, "bad one" if i % 10 == 3 else f"text {i} " * 1000 if i % 2 else "") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    path = "file://" + str(tmp_path / "points")
    assert encode.processed(df.where("id < 20"), failing, path) == {"embedded": 18, "errors": 2, "skipped": 0}
    assert encode.processed(df, failing, path) == {"embedded": 36, "errors": 4, "skipped": 20}
    assert encode.processed(df, failing, path) == {"embedded": 0, "errors": 0, "skipped": 60}
    got = {r.id: r for r in spark.read.parquet(path).collect()}
    assert len(got) == 60 and {i for i, r in got.items() if r.error} == {i for i in range(60) if i % 10 == 3}
    assert got[3].error == "ValueError: bad text" and got[5].sparse["text"] == 1000.0  # whole texts are encoded
    assert encode.processed(df.limit(0), failing, path) == {"embedded": 0, "errors": 0, "skipped": 0}


def test_checked_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "x", "language": "de"}\n{"id": "y", "lang\n\n{"id": "z"}\n')
    got = sorted((r.id or "", r._broken is not None, r._source_file) for r in readers.checked(spark, str(tmp_path), readers.ARTICLE).collect())
    assert got == [("", True, "a.json"), ("x", False, "a.json"), ("z", False, "a.json")]


def test_upsert_at_rest(spark, tmp_path):
    path = "file://" + str(tmp_path / "t")
    files = lambda: {str(p.relative_to(tmp_path)) for p in (tmp_path / "t").rglob("*.parquet")}
    tables.create(spark.createDataFrame([(i, "old", 0) for i in range(500)] + [(None, "none", 0)], "id int, v string, t int"), path, "id", 16)
    before = files()
    new = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (900, "c", 1), (None, "d", 1)], "id int, v string, t int")
    for _ in range(2):
        hit = tables.upsert_at_rest(new, path, "id", "t", 16)
    assert 1 < len(hit) <= 3
    kept = {f for f in before if not any(f"_bucket={h}/" in f for h in hit)}
    assert kept <= files() and len(kept) > 10  # untouched buckets keep their files
    got = tables.at_rest(spark, path).collect()
    want = {i: "old" for i in range(500)} | {1: "b", 900: "c"}
    assert {r.id: r.v for r in got if r.id is not None} == want and [r.v for r in got if r.id is None] == ["d"]
    tables.replace_group_at_rest(spark.createDataFrame([(5, "x", 1), (5, "y", 2)], "id int, v string, t int"), path, "id", 16)
    assert sorted(r.v for r in tables.at_rest(spark, path).where("id = 5").collect()) == ["x", "y"]
    assert tables.upsert_at_rest(new.limit(0), path, "id", "t", 16) == []


def test_encoder_holds_the_results_of_some_texts_at_a_time(spark, monkeypatch):
    """an Arrow batch's results are given in pieces of HELD characters, not at once."""
    monkeypatch.setattr(encode, "HELD", 10)
    assert list(encode.slices([4, 4, 4, 30, 0, 10, 1])) == [(0, 2), (2, 3), (3, 4), (4, 6), (6, 7)]
    assert list(encode.slices([])) == []
    df = spark.range(50).selectExpr("id", "repeat('ab ', cast(id as int)) text").coalesce(1)
    got = encode.encode(df, encode.hashed(4), size=3).collect()
    assert {r.id: (r.sparse or {}).get("ab") for r in got} == {i: float(i) or None for i in range(50)}


def test_answers_are_parsed_once(spark):
    """An answer was parsed for each use of each of its fields; a text was counted from its beginning for each page."""
    from lexmill.plans import rest

    rows, fields = rest.review_cells(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # told of all fields, and of the quotes
    assert len(fields) == 4 and plan.count("parseJson") + plan.count("parse_json") <= 2 and "sequence(" not in plan
