import hashlib
import random
import re

import pytest

from lexmill.llm import winnow as wn



def spark_hash(tokens):
    """XXH64 of each token, the last hash being the seed of the next."""
    import xxhash

    h = 42
    for t in tokens:
        h = xxhash.xxh64_intdigest(t.encode(), seed=h)
    return h >> 33


def brute(text, k=wn.K, window=wn.WINDOW):
    t = re.findall(rf"[^ \t\n\x0b\f\r]{{1,{wn.TOKEN}}}", text)
    g = [spark_hash(t[i : i + k]) for i in range(max(1, len(t) - k + 1))] if t else []
    out = []
    for i in range(max(1, len(g) - window + 1) if g else 0):
        w = list(enumerate(g[i : i + window], i))
        p = max((x for x in w if x[1] == min(h for _, h in w)), key=lambda x: x[0])
        if p not in out:
            out.append(p)
    return out


def text_of(picked):
    return " ".join(f"{p}:{h:x}" for p, h in picked)


def near(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_against_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["aa", "b", "é", "longerthaneight", "c\n"], k=rng.randint(0, 60))) for _ in range(30)]
    texts += [None, "", "  ", "one", "x" * 100, "so so " * 40, "so so " * 40]
    rows = [(3 * i, t, 5, "q") for i, t in enumerate(texts)] + [(None, "last", 5, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, picked string")
    got = {r.doc_id: r for r in wn.edited_pairs(df).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == text_of(brute(t)) and r.edited_fingerprint == text_of(brute(edited))
        assert r.near_edited == pytest.approx(near(brute(t), brute(edited))) and r.near_next == pytest.approx(near(brute(t), brute(nxt)))


def test_repeats_long_and_empty(spark):
    schema = "doc_id long, text string"
    rows = [(1, "a b c d e f"), (1, "z y x w"), (1, "z y x w"), (2, "word " * 50000)]
    got = wn.edited_pairs(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 1, 2]
    two = next(r for r in got if r.doc_id == 2)
    cut = 250000 // 3
    assert two.edited_sha256 == hashlib.sha256((("word " * 50000)[: 250000 - cut] + "z y x w").encode()).hexdigest()
    assert wn.edited_pairs(spark.createDataFrame([], schema)).count() == 0
    assert wn.edited_pairs(spark.createDataFrame([(5, "only one")], schema)).first().near_next == 1.0


def test_match_guarantee(spark):
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(500)]
    shared = rng.choices(vocab, k=wn.K + wn.WINDOW - 1)
    rows = [(i, " ".join(rng.choices(vocab, k=40) + shared + rng.choices(vocab, k=40))) for i in range(30)]
    sets = [{x.hash for x in r.fingerprint} for r in wn.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert all(a & sets[0] for a in sets)


def test_insertion_in_unspaced_text(spark):
    rng = random.Random(6)
    text = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(3000))
    rows = [(1, text), (2, text[:5] + "x" + text[5:])]
    a, b = ({x.hash for x in r.fingerprint} for r in wn.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert len(a & b) >= 0.9 * len(a | b)


def test_edited_texts_of_every_length(spark):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choices("abcdefgh \n中😀", k=i * 3))) for i in range(120)]
    text = dict(rows)
    for r in wn.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        t, nxt = text[r.doc_id], text[(r.doc_id - 1) % 120]
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert r.edited_fingerprint == text_of(brute(edited)) and r.fingerprint == text_of(brute(t))


def test_minima_of_windows_in_few_passes(spark):
    """Windows are not cut out of the array one by one, which took over half of the time."""
    assert "array_min" not in spark.createDataFrame([("x",)], "text string").select(wn.chosen("text"))._jdf.queryExecution().optimizedPlan().toString()
    assert wn.steps(44) == [[1, 2, 3], [4, 8, 12], [16, 28]]
    rng = random.Random(8)
    values = [rng.randint(0, 50) for _ in range(130)]
    rows = spark.createDataFrame([(values,)], "g array<int>")
    for window in (1, 2, 3, 5, 16, 17, 43, 44, 45, 200):
        assert rows.select(wn.minima(wn.F.col("g"), window)).first()[0] == [min(values[i : i + window]) for i in range(130)]


def test_minima_by_blocks_of_a_quarter_window(spark):
    """The windows' distinct minima, for arrays shorter than a window, falling, rising and with ties; positions from a base on."""
    rng = random.Random(9)
    cases = [[rng.randint(0, 9 if n % 2 else 10**6) for _ in range(n)] for n in (1, 2, 7, 10, 11, 12, 43, 44, 45, 54, 55, 56, 90, 300)]
    cases += [list(range(200)), list(range(200, 0, -1)), [5] * 150]
    for window in (8, 12, 44):
        for base in (0, 17):
            values = [[h << 32 | wn.LOW - base - i for i, h in enumerate(x)] for x in cases]
            rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, g array<long>").repartition(4)
            got = dict(map(tuple, rows.select("k", wn.window_minima(wn.F.col("g"), wn.F.lit(base), window)).collect()))
            for k, v in enumerate(values):
                want = [min(v[i : i + window]) for i in range(max(0, len(v) - window) + 1)]
                assert got[k] == list(dict.fromkeys(want)), (window, base, k)


def test_picked_rows_are_those_of_brute_force(spark):
    """Hashes of whole texts stand in a row a block, not in a lambda, which took most of the time; texts of every length at a block's edges."""
    rng = random.Random(10)
    lengths = [*range(0, 70), *range(70, 140, 3), 400]
    rows = [(i % 50, i, "".join(rng.choices("abé \n中😀" if i % 2 else "a", k=n))) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "id long, nth int, text string").repartition(3, "id")
    assert "lambda" not in wn.gram_blocks(df, ["id", "nth"])._jdf.queryExecution().optimizedPlan().toString()
    picked = wn.picked_rows(df, ["id", "nth"])
    got = {(r.id, r.nth): r.f for r in picked.select("id", "nth", wn.written(wn.F.col("picked")).alias("f")).collect()}
    assert got == {(i, n): text_of(brute(t)) for i, n, t in rows if t.split()}
