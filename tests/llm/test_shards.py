import random
import zlib
from collections import defaultdict

from lexmill.llm import shards as sh


def check(rows, got, n):
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in got) == sorted((i if i is not None else -1, size(t), zlib.crc32((t or "").encode())) for i, t, _ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None
    total, most = sum(r.size for r in got), max(r.size for r in got)
    for k in by:
        assert 0 <= k < n and sorted(r.slot for r in by[k]) == list(range(len(by[k])))
        assert abs(sum(r.size for r in by[k]) - total / n) <= most


def test_hot_text_repeats_and_nulls(spark):
    rng = random.Random(1)
    texts = ["hot " * 30] * 900 + ["x" * rng.randint(0, 300) for _ in range(900)] + [None, "", "é" * 5000]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, None, 1)] * 3 + [(7, "same", 1)] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string, size int")
    check(rows, sh.shard(df, 24).collect(), 24)
    check(rows, sh.shard(df, 5, range_rows=40).collect(), 5)
    one = [(1, "a", 1)]
    check(one, sh.shard(spark.createDataFrame(one, df.schema), 24).collect(), 24)
    assert sh.shard(df.limit(0)).count() == 0
