import random

import numpy as np
import xxhash

from pyspark.sql import functions as F

from lexmill.llm import simhash as sh


def brute_fp(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(fps, radius):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_masks_cover():
    rng = random.Random(0)
    for radius in (1, 3, 5):
        ms = sh.masks(list(range(64)), radius)
        for _ in range(300):
            gap = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not m & gap for m in ms)


def test_query_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = rng.choices(vocab, k=rng.randint(40, 300))
        for _ in range(rng.randint(1, 4)):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    texts += [None, "", " \n", "One", "ONE", "a b", "a b", "é É", "x y z " * 20000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, fingerprint int")
    fps = {i: brute_fp(t) for i, t in enumerate(texts)}
    want = brute_roots(fps, 3)
    got = {r.doc_id: r for r in sh.near_duplicates(df).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{x:016x}" for i, x in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert sh.near_duplicates(df.limit(0)).count() == 0
    null = spark.createDataFrame([(None, "a"), (None, "a"), (5, "b"), (5, "b")], "doc_id long, text string")
    assert sorted((r.component_id or 0) for r in sh.near_duplicates(null).collect()) == [0, 0, 5, 5]


def test_hot_buckets_split_exactly(spark):
    rng = random.Random(4)
    fps = {}
    for i in range(400):
        x = 0x0123456789ABCDEF if i < 300 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        fps[i] = x
    rows = [(i, sh.signed(x), 0) for i, x in {x: i for i, x in reversed(fps.items())}.items() for x, i in [(i, x)]]
    nodes = spark.createDataFrame([(i, f, 0) for i, f, _ in rows], "id long, fp long, other long")
    want = brute_roots({i: f & (1 << 64) - 1 for i, f, _ in rows}, 3)
    for bucket in (4, 512):
        from lexmill.llm.common import components

        roots = {r.node: r.root for r in components(sh.links(nodes, 3, bucket=bucket)).collect()}
        assert {i: roots.get(i, i) for i in want} == want


def test_near_copies_group(spark):
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(3000)]
    rows, n = [], 0
    for g in range(60):
        base = rng.choices(vocab, k=200)
        for c in range(3):
            w = list(base)
            for p in rng.sample(range(200), 4 if c else 0):  # 0.82 alike in five-word shingles, or a little more
                w[p] = rng.choice(vocab)
            rows.append((n, " ".join(w), g))
            n += 1
    got = {r.doc_id: r.group for r in sh.robust_groups(spark.createDataFrame(rows, "doc_id long, text string, g int")).collect()}
    assert all(rows[got[i]][2] == rows[i][2] for i in got)
    assert sum(got[i] == 3 * (i // 3) for i in got) >= 0.95 * n


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_truncated_and_extended_copies(spark):
    rng = random.Random(7)
    vocab = [f"v{i}" for i in range(5000)]
    rows = []
    for g in range(40):
        w = rng.choices(vocab, k=rng.randint(100, 400))
        cut, more = int(len(w) * rng.uniform(0.1, 0.18)), int(len(w) * rng.uniform(0.1, 0.2))
        rows += [(3 * g, " ".join(w)), (3 * g + 1, " ".join(w[:-cut])), (3 * g + 2, " ".join(w + rng.choices(vocab, k=more)))]
    got = {r.doc_id: r.group for r in sh.robust_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 3 * (i // 3) for i in got} and len(got) == 120


def test_links_are_checked_by_shingles(spark):
    rng = random.Random(8)
    w = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(12):  # the same words in another order each
        rows.append((i, " ".join(rng.sample(w, 60))))
    edited = rows[0][1].split()
    edited[-3:] = ["a", "b", "c"]
    rows += [(20, " ".join(edited)), (21, None), (22, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: i for i in range(12)} | {20: 0, 21: 21, 22: 21}
    # neither large buckets nor groups of several blocks leave out a pair or add one
    for kinds in ({}, {"bucket": 1, "block_words": 40}):
        assert {r.doc_id: r.group for r in sh.robust_groups(df, **kinds).collect()} == want


def test_minhash_and_exact_check():
    w = [f"v{i}" for i in range(300)]
    a = " ".join(w)
    for n in (250, 248, 239, 240, 200):
        b = " ".join(w[:n])
        like = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        assert bool(sh.exact_links(np.array([1, 2]), [a, b])) == (like >= 0.8)
        x, y = (np.frombuffer(sh.minhash(sh.shingle_hashes(t)), np.uint8) for t in (a, b))
        assert abs((x == y).mean() - like) < 0.15


def test_chains_over_blocks(spark):
    """Groups of many blocks in which most texts are near the root only by way of others."""
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(4000)]
    texts = []
    for _ in range(3):
        w = rng.choices(vocab, k=120)
        for step in range(25):
            texts.append(" ".join(w))
            for p in rng.sample(range(120), 2 if step != 12 else 40):  # the chain is cut in the middle
                w[p] = rng.choice(vocab)
    rng.shuffle(texts)
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {i: find(i) for i in range(len(texts))}
    assert len(set(want.values())) >= 6
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = df.select(sh.text_hash().alias("node"), F.col("doc_id").alias("id"), "text")
    one = nodes.agg(F.min("node")).first()[0]
    group = nodes.select("node", F.lit(one).alias("root"), "id", F.lit(116).alias("words"))  # all in one candidate group
    for block_words in (10**6, 1200, 300):
        links = sh.verified(nodes, group, block_words)
        of = {r.node: r.root for r in sh.components(links).collect()}
        node = {r.id: r.node for r in nodes.collect()}
        same = {}
        for i in want:
            same.setdefault(of.get(node[i], node[i]), set()).add(i)
        assert sorted(map(min, same.values())) == sorted(set(want.values())) and all(want[i] == min(s) for s in same.values() for i in s)


def test_null_ids_link_and_bridge(spark):
    """Rows without a doc_id are leaves and bridges like any other."""
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(400)]

    def edited(w):
        w = list(w)
        w[rng.randrange(len(w))] = rng.choice(vocab)
        return w

    chains = []
    while len(chains) < 6:
        a = rng.choices(vocab, k=150)
        b = edited(a)
        c = edited(b)
        x, y, z = (brute_fp(" ".join(w)) for w in (a, b, c))
        gap = lambda p, q: (p ^ q).bit_count()
        if 0 < gap(x, y) <= 3 and 0 < gap(y, z) <= 3 < gap(x, z):
            chains.append([" ".join(w) for w in (a, b, c)])
    rows = []
    for k, (a, b, c) in enumerate(chains[:4]):
        rows += [(100 - 10 * k, a), (None, b), (None, b), (105 - 10 * k, c)]  # a bridge
    rows += [(7, chains[4][0]), (None, chains[4][1])]  # a leaf
    rows += [(None, t) for t in chains[5]]  # a component without any id
    got = {r.fingerprint: r.component_id for r in sh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = {t: 100 - 10 * k for k in range(4) for t in chains[k]} | dict.fromkeys(chains[4][:2], 7) | dict.fromkeys(chains[5])
    assert got == {f"{brute_fp(t):016x}": i for t, i in want.items()}
