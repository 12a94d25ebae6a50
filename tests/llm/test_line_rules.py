import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexmill.llm import line_rules as lr

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")


def words(t):
    return re.findall(lr.WORD, t)


def norm(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line.translate(LOW)).strip(" ")


def brute(docs, limit):
    """(doc_id, counts, base_failed, kept, removed lines, words left) and the cleaned text of each row."""
    held = defaultdict(set)
    for _, t, host in docs:
        for x in (t or "").split("\n"):
            if words(x):
                held[host, norm(x)].add(t)
    out = []
    for i, t, host in docs:
        t = t or ""
        w, lines = words(t), [x for x in t.split("\n") if words(x)]
        at = defaultdict(list)
        for k in range(len(w) - 4):
            at[tuple(w[k : k + 5])].append(k)
        covered = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(5)}
        gone = [x for x in lines if len(held[host, norm(x)]) > limit]
        left = len(w) - sum(len(words(x)) for x in gone)
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        kept = not failed and left >= 10 and 2 * left >= len(w)
        row = (i, len(w), sum(map(len, w)), sum(t.count(c) for c in lr.SYMBOLS), len(lines) - len(set(lines)), len(covered), failed, kept, len(gone), left)
        out.append((row, "\n".join(x for x in lines if len(held[host, norm(x)]) <= limit) if gone else t))
    return out


def corpus():
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(300)] + ["#x", "a|b", "😀", "É", "und er"]
    line = lambda n: " ".join(rng.choices(vocab, k=n))
    menu = ["Home | About us  2024", "All rights reserved <c>", "subscribe\tto our long letter and more of it here"]
    docs = []
    for i in range(120):
        own = [line(rng.randint(0, 25)) for _ in range(rng.randint(0, 4))] + rng.sample(menu, rng.randint(0, 3))
        rng.shuffle(own)
        docs.append((i, "\n".join(own), rng.choice(["hot", "hot", "h2", None])))
    docs += [(200 + i, f"Home | ABOUT us {i}\n" + line(30) + "\n \n", "hot") for i in range(20)]
    docs += [(300, "same text over and over again in a copy\n" + line(9), "hot")] * 30  # copies are one document
    docs += [(None, None, None), (401, "", "h2"), (402, " \n\t", "h2"), (403, "a b c d e", "h2"), (404, "a a a a a a a a a a a a", "h2"), (405, "ja ja\n" * 400, None), (406, "x" * 5000, "h2")]
    docs += [(407, "p q r s t u v w x y z 1 2 3 4 p q r s t u v w", "h2"), (407, None, "h2")]
    return docs


def frame(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit("!") for c in ("row", "host", "h", "n", "lines", "rest", "own_row", "_salt", "kept")}).repartition(4)


@pytest.mark.parametrize("broadcast", [lr.BROADCAST_ROWS, 0])
def test_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(lr, "BROADCAST_ROWS", broadcast)
    docs = corpus()
    want = brute(docs, 5)
    assert sum(r[8] > 0 for r, _ in want) > 40 and any(not r[6] and not r[7] for r, _ in want)
    found = lr.judged(lr.measure(frame(spark, docs)), 5)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = found.select(*names, F.coalesce(F.size("removed"), F.lit(0)).alias("gone"), "words_left").collect()
    assert Counter(map(tuple, got)) == Counter(r for r, _ in want)


def test_cleaned(spark):
    docs = corpus()
    df = frame(spark, docs)
    got = lr.clean(df, 5)
    assert got.columns == df.columns
    assert Counter((r.doc_id, r.text, r.row) for r in got.collect()) == Counter((r[0], text, "!") for r, text in brute(docs, 5) if r[7])


def test_nothing(spark):
    empty = frame(spark, [])
    assert lr.judged(lr.measure(empty)).count() == 0 and lr.clean(empty).count() == 0
