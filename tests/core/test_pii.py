"""Spans of personal data against a plain search over all matches."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexmill.functions import pii, vocab

CASES = [  # text, (type, its text, score)
    ("AHV 756.1234.5678.90", [("SWISS_AHV", "756.1234.5678.90", 1.0)]),
    ("x y z a b c 756 1234 5678 90", [("SWISS_AHV", "756 1234 5678 90", 0.95)]),
    ("+41 79 123 45 67", [("SWISS_PHONE", "+41 79 123 45 67", 0.85)]),
    ("Meine Natel ist 079 123 45 67.", [("SWISS_PHONE", "079 123 45 67", 1.0)]),
    ("044 123 45 67", [("SWISS_PHONE", "044 123 45 67", 0.8)]),
    ("CH93 0076 2011 6238 5295 7", [("SWISS_IBAN", "CH93 0076 2011 6238 5295 7", 0.95)]),
    ("Konto CH9300762011623852957", [("SWISS_IBAN", "CH9300762011623852957", 1.0)]),
    ("in 8001 Zürich und code postal 1201 Genève", [("SWISS_POSTCODE", "8001 Zürich", 0.75), ("SWISS_POSTCODE", "1201 Genève", 1.0)]),
    ("é😀 a.b@c.ch, 4111 1111 1111 1111", [("EMAIL_ADDRESS", "a.b@c.ch", 1.0), ("CREDIT_CARD", "4111 1111 1111 1111", 0.9)]),
    ("123.4567.8901.23", []), ("Guten Tag", []), ("", []), ("   ", []), (None, []),
]


def plain_spans(text, least=0.7):
    every = []
    for kind, p, score in vocab.PII:
        for m in re.finditer(p, text or "", re.ASCII):
            before = re.findall(r"\w+", text[max(0, m.start() - 200) : m.start()].lower())[-5:]
            near = any(f" {w} " in f" {' '.join(before)} " for w in vocab.PII_CONTEXT.get(kind, []))
            every.append((min(1.0, round(score + 0.35, 9)) if near else score, m.start(), m.end(), kind))
    kept = []
    for x in sorted((x for x in every if x[0] >= least), key=lambda x: (-x[0], x[1] - x[2], x[1], x[3])):
        if all(x[2] <= y[1] or y[2] <= x[1] for y in kept):
            kept.append(x)
    return sorted((a, b, kind, score) for score, a, b, kind in kept)


def crowd(rng):
    bits = ["756.1234.5678.90", "079 123 45 67", "+41 44 123 45 67 8001 Bern", "CH93 0076 2011 6238 5295 7", "8001 Zürich", "x@y.ch", "4111-1111-1111-1111", "IBAN", "tel", "code postal", "é", "😀", "\n", "0", " und "]
    return rng.choice(["", " "]).join(rng.choices(bits, k=rng.randint(0, 30)))


def test_cases(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "k int, t string")
    got = {k: [] for k in range(len(CASES))}
    for r in sorted(pii.detect(df, "k", "t").collect(), key=lambda r: (r.k, r.start)):
        got[r.k].append((r.entity_type, r.text, r.score))
        assert CASES[r.k][0][r.start : r.end] == r.text
    assert got == {k: want for k, (_, want) in enumerate(CASES)}


@pytest.mark.parametrize("least", [0.7, 0.9])
def test_crowded_texts(spark, least):
    rng = random.Random(1)
    texts = [crowd(rng) for _ in range(300)] + [None, "a@b.ch " * 20000]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "k int, t string, _text string")
    got = Counter((r.k, r.start, r.end, r.entity_type, r.score) for r in pii.detect(df, "k", "t", least=least).collect())
    assert got == Counter((k, *x) for k, t in enumerate(texts) for x in plain_spans(t, least))


def test_masked(spark):
    rng = random.Random(2)
    texts = [crowd(rng) for _ in range(100)] + [None, "", "AHV: 756.1234.5678.90, Email: test@example.com"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    rows = {r.k: r for r in pii.scrubbed_for_logging(pii.scrubbed(df, "t", "m"), "t", "log").collect()}
    for k, t in enumerate(texts):
        out, at = [], 0
        for a, b, kind, _ in plain_spans(t):
            out += [t[at:a], f"<{kind}>"]
            at = b
        want = None if t is None else "".join([*out, t[at:]])
        assert rows[k].m == want and rows[k].log == (None if want is None else re.sub("<(SWISS_[A-Z]+|EMAIL_ADDRESS|CREDIT_CARD)>", r"[REDACTED:\1]", want))
    assert rows[102].m == "AHV: <SWISS_AHV>, Email: <EMAIL_ADDRESS>"


def test_own_recognisers_and_kinds(spark):
    df = spark.createDataFrame([(1, "Case AB-123 of 3. März, a@b.ch"), (2, "nothing"), (3, None)], "k int, t string")
    more = (("CASE_NUMBER", r"\b[A-Z]{2}-\d{3}\b", 0.9), ("DATE_TIME", r"\d\. März", 0.9))
    got = {r.k: list(r.x) for r in df.select("k", pii.kinds(pii.found(F.col("t"), more=more), ["EMAIL_ADDRESS"]).alias("x")).collect()}
    assert got == {1: ["CASE_NUMBER", "DATE_TIME"], 2: [], 3: []}
    masked = {r.k: r.m for r in pii.scrubbed(df, "t", "m", more=more).collect()}
    assert masked == {1: "Case <CASE_NUMBER> of 3. März, <EMAIL_ADDRESS>", 2: "nothing", 3: None}  # dates stay
    assert [r.k for r in df.where(pii.has_pii(F.col("t"))).collect()] == [1]
    assert {r.entity_type: r.n for r in pii.summary(df, "k", "t").collect()} == {"EMAIL_ADDRESS": 1}
    assert pii.summary(df.limit(0), "k", "t").count() == 0
