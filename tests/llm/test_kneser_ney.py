import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexmill.llm import kneser_ney as kn


def words(t):
    w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
    return [x.decode() for x in w] + ["\n"]


class Brute:
    """Counts of all orders, with dictionaries."""

    def __init__(self, train, order):
        self.order, self.uni, self.top = order, Counter(), Counter()
        for t in train:
            w = words(t)
            self.uni.update(w)
            padded = ["^"] * (order - 1) + w
            self.top.update(tuple(padded[k : k + order]) for k in range(len(w)))
        self.levels = {order: self.top}
        for k in range(order - 1, 0, -1):
            self.levels[k] = Counter(g[1:] for g in self.levels[k + 1])
        self.d = {k: kn.discounts([sum(c == j for c in x.values()) for j in (1, 2, 3, 4)]) for k, x in self.levels.items()}
        self.after = {k: defaultdict(list) for k in self.levels}
        for k, x in self.levels.items():
            for g, c in x.items():
                self.after[k][g[:-1]].append(c)

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / (len(self.uni) + 1)
        low, own, d = self.p(gram[1:]), self.after[k].get(gram[:-1]), self.d[k]
        if not own:
            return low
        c = self.levels[k][gram]
        return (c - d[min(c, 3)] + sum(d[min(x, 3)] for x in own) * low) / sum(own)

    def score(self, text):
        w = words(text)
        n, v = sum(self.uni.values()), len(self.uni)
        padded = ["^"] * (self.order - 1) + w
        base = sum(math.log10((self.uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        return len(w), sum(x in self.uni for x in w), n, base, sum(math.log10(self.p(tuple(padded[k : k + self.order]))) for k in range(len(w)))


@pytest.mark.parametrize("order,part_chars", [(3, 500), (3, 10**7), (2, 500)])
def test_against_brute_force(spark, monkeypatch, order, part_chars):
    rng = random.Random(1)
    vocab = ["the", "The", "é", "É", "a", "b", "c"] + [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocab, [60 / (i + 1) for i in range(len(vocab))], k=rng.randint(0, 60))) for _ in range(150)] + [None, "", "   ", "zzz qqq", "the a " * 30000, "a\tb\x0bc\nthe"]
    train = texts[:120] + ["the b " * 300 + "c", "the w1"] * 2
    of = lambda t: spark.createDataFrame([(i, x, 0.0) for i, x in enumerate(t)], "doc_id long, text string, score double")
    monkeypatch.setattr(kn, "FEW", 3)
    model = kn.train(of(train), order, part_chars)
    assert (part_chars > 500 or order == 2) or len(model["place"].words) > 3  # some words are spread
    brute = Brute(train, order)
    assert sum(brute.p((*["the"] * (order - 1), x)) for x in [*brute.uni, "never seen"]) == pytest.approx(1)
    for r in kn.score(of(texts), model).collect():
        want = brute.score(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert r.base_score == pytest.approx(want[3], rel=1e-9) and r.score == pytest.approx(want[4], rel=1e-9)
    none = kn.train(of([]), order)
    assert all(r.score == 0 and r.base_score == 0 for r in kn.score(of(texts[-5:]), none).collect())
    assert kn.score(of([]), model).count() == 0


def test_one_text(spark):
    model = kn.train(spark.createDataFrame([("a",)], "text string"))
    got = kn.score(spark.createDataFrame([(1, "a"), (2, "b a")], "doc_id long, text string"), model).collect()
    brute = Brute(["a"], 3)
    assert [r.score for r in sorted(got)] == [pytest.approx(brute.score(t)[4]) for t in ("a", "b a")]


def test_tokens(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choices("aAbBé \t\n\x0b\x0c\r\x1c\u2003", k=rng.randint(0, 90))) for _ in range(300)] + [None, "", " ", "x" * 500, "y " * 300]
    seen = {}
    for size in (1 << 20, 16):
        monkeypatch.setattr(kn, "PIECE_BYTES", size)
        h, ends = kn.Tokens()(texts)
        begin = np.concatenate([[0], ends[:-1]])
        for t, a, b in zip(texts, begin, ends, strict=True):
            w = words(t)
            assert b - a == len(w) and h[b - 1] == kn.END
            for x, y in zip(w, h[a:b].tolist(), strict=True):
                assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)


def test_blocks_and_files(tmp_path, monkeypatch):
    a = np.array([0, 1, 70000, 2**32 - 1]), np.array([], dtype=np.int64), np.array([5])
    assert [x.tolist() for x in kn.unpacked(kn.packed(*a))] == [x.tolist() for x in a]
    rows = np.array([(1, 2, 3)], kn.WORD)
    kn.store(str(tmp_path), "f", x=np.arange(3, dtype=np.uint8), y=rows, z=np.zeros((5, 0), "<u8"))
    got = kn.load(str(tmp_path / "f"))
    assert got["x"].tolist() == [0, 1, 2] and got["y"]["before"].tolist() == [3] and got["z"].shape == (5, 0)
    monkeypatch.setattr(kn, "FEW", 2)
    n = np.array([1, 2, 3, 300, 1, 1, 1])
    assert kn.large(n, np.array([0, 3, 3, 4, 7])).tolist() == [[0, 3], [6, 3], [1, 3], [1, 0], [1, 0]]
    f = kn.counts("n", n) | {"n_large": kn.large(n, np.array([0, 3, 3, 4, 7]))}
    run, begin, end = np.array([0, 1, 2, 3]), np.array([0, 3, 3, 4]), np.array([3, 3, 4, 7])
    assert kn.totals(f, "n", run, begin, end).tolist() == [[6, 0, 300, 3], [1, 0, 0, 3], [1, 0, 0, 0], [1, 0, 1, 0]]
    assert kn.bisect(np.array([1, 5, 9, 2, 5]), np.array([0, 3, 3, 2]), np.array([3, 5, 3, 2]), np.array([5, 5, 5, 9])).tolist() == [1, 4, -1, -1]
