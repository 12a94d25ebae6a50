import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexmill.llm import lexical

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(t):
    return re.findall(lexical.TERM, (t or "").translate(LOW))


def brute(docs, items, k):
    """Sorted (item, rank, doc, score); every document against every item."""
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, length = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, b in bags:
            m = 75 + (25 * b.total() * n_docs) // length
            w = lambda t: math.floor(1000 * math.log((2.0 * n_docs + 2) / (2 * df[t] + 1)))
            x = sum(w(t) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m)) for t in terms(text) if t in b)
            if x > 0:
                scores.append((-x, math.inf if i is None else i))
        out += [(str(item), r, i, -x) for r, (x, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"W{k}é" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    text = lambda n: rng.choice(" ,\n").join(rng.choices(words, weights, k=n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(150)] + [(1000 + i, "w1é w2é hot text") for i in range(60)]
    docs += [(None, "w1é w2é hot text"), (None, None), (5, None), (6, ""), (7, "-- ! \t"), (9, "w3é"), (9, "w3é"), (9, "w4é w4é"), (2000, text(6000))]
    items = [(k, text(rng.randint(1, 25))) for k in range(12)] + [("x", None), ("y", ""), (3, "hot HOT w1é"), ("none", "neverseen"), (None, "w3é 9 text")]
    return docs, [(None if k is None else str(k), t) for k, t in items]


def found(spark, docs, items, k):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("!") for c in ("row", "t", "n", "q", "term", "rank", "score")})
    i = spark.createDataFrame(items, "item_id string, text string").withColumns({c: F.lit("!") for c in ("q", "c", "term", "doc_id")})
    rows = lexical.search(d.repartition(5), i, k).collect()
    return sorted((str(r.item_id), r["rank"], math.inf if r.doc_id is None else r.doc_id, r.score) for r in rows)


@pytest.mark.parametrize("broadcast", [lexical.BROADCAST_ROWS, 0])
def test_against_all_pairs(spark, monkeypatch, broadcast):
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", broadcast)
    docs, items = corpus(1)
    for k in (1, 7):
        assert found(spark, docs, items, k) == brute(docs, items, k)


def test_pruned(spark):
    """The threshold leaves most of a frequent term's postings out, and no result."""
    docs = [(i, "the of " + ("rare words " * (i % 3) if i % 9 == 0 else "")) for i in range(300)]
    items = [("a", "the rare words of")]
    assert found(spark, docs, items, 20) == brute(docs, items, 20)


def test_nothing(spark):
    docs, items = corpus(2)
    assert found(spark, [], items, 3) == [] and found(spark, docs, [], 3) == []
    assert found(spark, [(1, None)], items, 3) == []
