import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import filter_audit as fa


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def plain_counts(t):
    w = words(t or "")
    return [len(w), len(set(w)), len(re.findall("[A-Z]", t or "")), len(re.findall(r"[#$%&*|]", t or "")), len(t or "")]


def texts(rng):
    vocab = ["a", "b", "ab", "ba", "A", "Über", "😀", "日本", "abc", "cba", "bca", "longer-than-eight-bytes", "c#", "\x00", "x" * 40]
    out = ["".join(x + rng.choice([" ", "\t", "\n ", "\x0b", "\r\f"]) for x in rng.choices(vocab, k=rng.randint(0, 150))) for _ in range(80)]
    return [None, "", " ", "one", "é", *out, " ".join(rng.choices(vocab, k=3000)), "y" * 9000, None]


@pytest.mark.parametrize("base", [fa.BASE, 1])  # powers of 1: words of the same letters share a hash
@pytest.mark.parametrize("piece", [fa.PIECE, 1000, 7])
def test_counts(base, piece):
    all_ = texts(random.Random(1))
    want = np.array([plain_counts(t) for t in all_]).T
    for kind in (pa.string(), pa.large_string()):
        array = pa.array(["before", *all_], kind).slice(1)
        assert (fa.Scanner(base).counts(array, piece) == want).all()
    assert fa.Scanner().counts(pa.array([], pa.string())).shape == (5, 0)


def brute(docs, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    rows = []
    for i, t, lang in docs:
        n, distinct, capitals, symbols, codes = plain_counts(t)
        smaller = any(i is not None and j is not None and j < i and (u or "") == (t or "") for j, u, _ in docs)
        f = dict(zip("ABCDE", (n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * codes, symbols > 0, smaller), strict=True))
        rows.append((lang or "", f, i in good, i in toxic))
    out = set()
    for part in {r[0] for r in rows}:
        own, lines = [r for r in rows if r[0] == part], []
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                left = [r for r in own if not any(r[1][y] for y in order[: step - 1])]
                gone = [r for r in left if r[1][x]]
                alone = sum(r[1][x] and sum(r[1].values()) == 1 for r in own)
                lines.append([part, order, step, len(left) - len(gone), len(gone), sum(r[1][x] for r in own) - len(gone), alone, sum(r[2] for r in gone), sum(r[3] for r in gone)])
        out |= {(*r, sum(y[4] for y in lines if y[1][y[2] - 1] == r[1][r[2] - 1])) for r in lines}
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    pool = texts(rng)
    docs = [(i, rng.choice(pool), rng.choice(["de", "de", "fr", None, ""])) for i in range(200)]
    docs += [(None, "twice", "de"), (None, "twice", "de"), (7, "twice", "de"), (7, "twice", "de"), (900, "twice", "it"), (None, None, None)]
    docs += [(i, "hot " * 120, "hot") for i in range(1000, 1080)] + [(2000, " ".join(map(str, range(500))), "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(150)] + [(7, 1, 1), (7, 0, None), (None, 1, 1), (5, 1, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({c: F.lit("!") for c in ("id", "part", "mask", "digest", "first", "good")}).repartition(4)
    t = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("!"))
    assert {tuple(r) for r in fa.audit(d, t).collect()} == brute(docs, labels)
    assert fa.audit(d.limit(0), t).count() == 0
    assert {r.good_lost for r in fa.audit(d, t.limit(0)).collect()} == {0}
