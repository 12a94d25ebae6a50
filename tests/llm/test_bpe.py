import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import bpe

CODEC = bpe.Codec()
HARD = "ab' r e's'll \n\t1é中!  ７ '"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=HARD, max_size=200), st.integers(1, 40), st.integers(5, 20))
def test_chunks_stitch_to_the_whole(text, chunk, overlap):
    assert bpe.pretokenise(text, CODEC.pattern, chunk, overlap) == CODEC.pattern.findall(text)


def test_wide_pieces_and_long_texts():
    for text in ("x" * 5000 + " y" * 50 + " " * 4000 + "z", "".join(random.Random(1).choices(HARD, k=30000))):
        assert bpe.pretokenise(text, CODEC.pattern, 100, 20) == CODEC.pattern.findall(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_ids_and_round_trip(text):
    import numpy as np

    ids = CODEC.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == CODEC.encoding.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (3, "", "y"), (4, "z" * 200000 + " q" * 50000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(bpe.encode(df).collect(), key=lambda r: (r.doc_id or 0, r.n_tokens))
    assert [r.n_tokens for r in got[:4]] == [0, 2, 2, 0]
    back = {r.doc_id: r.bytes for r in bpe.decode(bpe.encode(df)).collect()}
    assert bytes(back[4]) == rows[-1][1].encode() and bytes(back[None]) == b""
    assert bpe.encode(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=HARD, max_size=200), st.integers(12, 40), st.integers(5, 11))
def test_chunk_rows_stitch_to_the_whole(text, chunk, overlap):
    import hashlib

    n = max(1, -(-(len(text) - overlap) // chunk))
    whole = CODEC.encode(text)
    own = bpe.Stitcher(CODEC, True)
    for k in range(n):
        own.add(*bpe.coded(CODEC, text[k * chunk : (k + 1) * chunk + overlap], k == 0, k == n - 1, chunk, overlap))
    got = own.done()
    assert got[0] is None or got == (len(whole) // 4, hashlib.sha256(whole).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), whole)


def test_chunks_of_all_sizes(spark):
    """Texts of one chunk, of some and of many, and such that can't be stitched; none is left out or doubled."""
    rng = random.Random(9)
    texts = ["".join(rng.choices(HARD + "abcdefgh" * 3 + "    ", k=rng.choice([0, 5, 90, 130, 300, 900, 4000]))) for _ in range(120)]
    texts += [None, "", "x" * 700 + " y z", " " * 2000, "1" * 500 + " and so on " * 40] * 2
    rows = [(None if i % 11 == 0 else i // 2, t, "?") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    got = bpe.encode(df, chunk=100, overlap=24, spread=3).collect()
    want = [(i, CODEC.encode(t)) for i, t, _ in rows]
    assert sorted(((r.doc_id or -1, bytes(r.ids)) for r in got)) == sorted((i or -1, x) for i, x in want)
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)
    digests = bpe.encode(df, digest_only=True, chunk=100, overlap=24, spread=3).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted((r.doc_id or -1, *r[1:]) for r in digests)
