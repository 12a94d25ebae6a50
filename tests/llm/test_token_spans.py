import numpy as np
import pytest

from lexmill.llm import token_spans as ts
from lexmill.llm.bpe import Codec


def brute(text, bounds, rule):
    codec = Codec()
    raw = text.encode()
    owner = [max(k for k in range(len(bounds) - 1) if len(text[: bounds[k]].encode()) <= b) for b in range(len(raw))]
    out, at = [0.0] * (len(bounds) - 1), 0
    for i in codec.encoding.encode_ordinary(text):
        n = len(codec.raw[i])
        own = owner[at : at + n]
        at += n
        if rule == "split":
            for o in own:
                out[o] += 1 / n
        else:
            out[{"start": own[0], "end": own[-1], "majority": max(own, key=lambda o: (own.count(o), -o))}[rule]] += 1
    return out


@pytest.mark.parametrize("rule", ts.RULES)
def test_rules_against_brute_force(spark, rule):
    texts = ["one two\nthree\n\n  four", "é中文 naïve\n\n\nende", "internationalisation of counters", "x" * 300 + "\n" + "y z " * 9000]
    df = spark.createDataFrame([(i, t, [3, 5, 9], 0) for i, t in enumerate(texts)], "doc_id long, text string, cuts array<long>, section int")
    got = {}
    for r in ts.count(df, rule, "cuts").collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts[:3]):
        rows = sorted(got[i], key=lambda r: r.section)
        bounds = [0, 3, 5, 9, len(t)]
        assert [(r.start, r.end) for r in rows] == list(zip(bounds, bounds[1:]))
        assert [r.n_tokens for r in rows] == pytest.approx(brute(t, bounds, rule))


def test_lines_add_up(spark):
    codec = Codec()
    texts = ["a\nb c\n", None, "", "\n\n \n x", "word " * 30000, "a\nb c\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = ts.count(df).collect()
    for i, t in enumerate(texts):
        own = [r for r in rows if r.doc_id == i]
        assert sum(r.n_tokens for r in own) == len(codec.encode(t)) // 4
        assert max(r.end for r in own) == len(t or "")
        assert len(own) == max(1, len((t or "").splitlines()))
    assert ts.count(df.limit(0)).count() == 0
    assert np.array_equal(ts.lines(np.frombuffer(b"a\n\nb", np.uint8)), [0, 2, 3, 4])
