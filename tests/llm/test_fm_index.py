import random

import numpy as np

from lexmill.llm import fm_index as fm


def test_index_against_scan():
    rng = random.Random(3)
    for n in (1, 5, 60, 300):
        seq = np.array([rng.randint(1, 4) for _ in range(n)])
        index = fm.FMIndex(seq, 5, every=4)
        phrases = [tuple(rng.randint(1, 4) for _ in range(k)) for k in (1, 2, 3, 4) for _ in range(9)]
        rows = np.zeros((len(phrases), 4), dtype=np.int64)
        for k, p in enumerate(phrases):
            rows[k, : len(p)] = p
        low, high = index.search(rows, np.array([len(p) for p in phrases]))
        for p, a, b in zip(phrases, low, high, strict=True):
            want = [i for i in range(n - len(p) + 1) if tuple(seq[i : i + len(p)]) == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def brute(text, items):
    w = fm.words(text)
    hit, got = set(), set()
    for item, t in items:
        b = fm.words(t)
        n = min(13, len(b))
        for k in range(max(1, len(b) - 12) if b else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == b[k : k + n]:
                    hit.update(range(i, i + n))
                    got.add(item or "")
    return len(w), len(hit), sorted(got)


def test_query_against_brute_force(spark):
    rng = random.Random(5)
    v = ["Ab", "é", "c3", "zz", "ſ", "İx"]
    items = [("9", " ".join(rng.choices(v, k=20))), ("10", "zz-zz"), ("7", None), (None, "c3"), ("8", "--"), ("10", "zz-zz"), ("11", "aa " * 40)]
    texts = [" ".join(rng.choices(v[:3] + ["q"], k=rng.randint(0, 40))) for _ in range(40)]
    texts += [None, "", "x " + items[0][1] + " y", "aa " * 300, "zz zz zz " * 500, items[0][1].upper()]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts + texts[-2:])], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block in (1 << 20, 20):
        for r in fm.find(docs, bench, block_chars=block).collect():
            t = (texts + texts[-2:])[r.doc_id]
            assert (r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) == brute(t, items)
    assert fm.judge(fm.find(docs.limit(0), bench)).count() == 0
    none = fm.judge(fm.find(docs, bench.limit(0))).collect()
    assert len(none) == len(texts) + 2 and not any(r.contaminated or r.n_hit for r in none)


def test_remove_spans():
    assert fm.remove_spans("Aé, b c! d", [(1, 3)]) == "Aé, ! d"
