"""Registered queries without SQL, row by row against plain Python versions over the same table."""

import re
import unicodedata
import uuid
from html import unescape

import pytest

from lexmill.operators import articles
from lexmill.plans.catalogue import QUERIES

DATA = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\f\r"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def packed(parts, most, glue="\n\n"):
    """Whole parts while their words fit; a part of more stays alone."""
    out, own, n = [], [], 0
    for p in parts:
        k = len(p.split())
        if own and n + k > most:
            out.append(glue.join(own))
            own, n = [], 0
        own, n = [*own, p], n + k
    return out + ([glue.join(own)] if own else [])


def dossier(t, most):
    parts = [p.strip(BLANKS) for p in t.split("\n\n")]
    return packed([p for p in parts if p], most)


def windows(t, most, overlap, seps, share):
    out, begin = [], 0
    while t:
        hard = min(begin + most, len(t))
        piece = t[begin:hard]
        good = next((e for s in seps if s in piece for e in [piece.rfind(s) + len(s)] if e > most * share), hard - begin)
        stop = len(t) if hard >= len(t) else begin + good
        out.append((begin, stop))
        if stop >= len(t):
            return out
        begin = max(stop - overlap, begin + 1)
    return out


def test_dossier_chunks(spark, docs):
    got = {(r.doc_id, r.chunk_index): r.text for r in QUERIES["c4_chunk_dossier"](spark, DATA).collect()}
    assert {k: v.split() for k, v in got.items()} == {(i, k): c.split() for i, t in docs.items() if t for k, c in enumerate(dossier(t, 200))}


def test_char_windows(spark, docs):
    rules = {"embed": (1500, 200, [". ", ".\n", "\n\n", "\n", " "], 0.5), "extract": (4000, 200, ["\n\n"], 1 - 500 / 4000)}
    got = {(r.doc_id, r.kind, r.chunk_index): (r.start, r.end) for r in QUERIES["c5_c7_char_windows"](spark, DATA).collect()}
    assert got == {(i, kind, k): w for i, t in docs.items() if t for kind, rule in rules.items() for k, w in enumerate(windows(t, *rule))}


def test_added_points(spark, docs):
    got = {(r.doc_id, r.chunk_index): (r.id, r._original_id, r.n_chars) for r in QUERIES["r14_add_document"](spark, DATA).collect()}
    assert len(got) >= len([t for t in docs.values() if t])
    for (i, k), (own, key, n) in got.items():
        assert key == f"{i}_chunk_{k}" and own == str(uuid.uuid5(uuid.NAMESPACE_URL, key)) and n > 0


def test_html_texts(spark):
    got = {r.page_id: r.text for r in QUERIES["s4_s5_html_to_text"](spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        t = re.sub(r"(?is)<(script|style)\b.*?</\1>", "", r.html)
        t = re.sub(r"(?i)(</(?:p|div|h1|h2|h3|tr)>|<br\s*/?>)", r"\1\n", t)
        t = unescape(re.sub(r"(?s)<!--.*?-->|<[^>]*>", "", t)).replace(" ", " ")
        assert got[r.page_id] == "\n".join(x for x in (y.strip(BLANKS) for y in re.split(r"\r?\n", t)) if x)


def test_long_articles(spark, docs):
    got = {}
    for r in sorted(QUERIES["c6_paragraphs"](spark, DATA).collect(), key=lambda r: (r.doc_id, r.article_number, r.paragraph)):
        got.setdefault((r.doc_id, r.article_number), []).append(r.text)
    seen = 0
    for i, t in docs.items():
        lines = []
        for k, x in enumerate(re.split(r"[.\n]+", t or "")):
            lines += [f"{1 + k // 18}. Teil: Teil {k}"] if k % 18 == 0 else [f"{k // 9}. Titel: Titel {k}"] if k % 9 == 0 else []
            lines += [f"Art. {k}", f"Von {k}", f"{k} / 90"] if k % 6 == 0 else [f"Art. {k}a Zu {k}"] if k % 3 == 0 else []
            lines.append("1 " + x.strip(" "))
        for number, *_, text in articles.folded("\n".join(lines)):
            parts = [p.strip(BLANKS) for p in re.split(r"\n(?=\d+\s)", text)]
            parts = [p for p in parts if p]
            want = [text] if len(text.split()) <= 60 else parts
            if len(want) > 1 or len(text.split()) <= 60:
                seen += len(want) > 1
                assert got[i, number] == want
    assert seen > 20


def test_diverse_candidates(spark):
    """MMR by metadata, the presentation rule and lanes keep their sizes, order and one row a document."""
    for name, most, one_each in (("r4_mmr_metadata", 20, False), ("r4_mmr_embedding", 20, False), ("w15_presentation_rank", 15, False), ("r7_library_lane", 10, True), ("r10_dossier_lane", 10, True)):
        groups = {}
        for r in QUERIES[name](spark, DATA).collect():
            groups.setdefault(r.query_id, []).append(r)
        assert groups, name
        for rows in groups.values():
            assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1)) and len(rows) <= most
            assert len({r.id for r in rows}) == len(rows)
            if one_each and name == "r7_library_lane":
                assert len({r.doc_key for r in rows}) == len(rows)
            if "final_score" in rows[0]:
                assert [r.final_score for r in sorted(rows, key=lambda r: r["rank"])] == sorted((r.final_score for r in rows), reverse=True)
