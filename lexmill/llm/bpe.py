"""Operator 5: byte-level BPE by overlapping chunks.

A text is cut into chunks of CHUNK characters that reach OVERLAP into their neighbour. Each is a row that is
pre-tokenised and encoded on its own; neighbours are stitched at the first pre-token boundary both have in their
overlap, by the ids up to it on the left and from it on the right. The pattern has no look-behind, so from a common
boundary on both chunks match alike until the chunk's end comes near. Decoding concatenates the raw bytes of the ids.

The chunks of a text of more than SPREAD are dealt over tasks, those of others stay where the text was read; ids and the
boundaries of the overlaps go to one task a text, which reads them in order and holds one chunk at a time (with
digest_only; else the ids, which are its result). A text of one chunk needs no stitching. Neighbours without a common
boundary (a pre-token wider than the overlap) are rare: such a text is encoded again where it lies, by pretokenise(),
which carries the left chunk on until it meets a boundary.

Null text counts as empty (no ids). Repeated rows give repeated results; an empty table gives no rows; other columns are
dropped, so none can clash.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import materialize, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: A match that ends nearer than this to the end of a cut chunk may be another one in the whole text.
MARGIN = 4
CHUNK, OVERLAP = 4096, 256
SPREAD = 8
#: Distinct pre-tokens whose ids a worker remembers.
REMEMBERED = 300_000


def boundaries(pieces: list[str], start: int) -> list[int]:
    """Where each piece ends."""
    out = []
    for p in pieces:
        start += len(p)
        out.append(start)
    return out


def pretokenise(text: str, pattern, chunk: int = 1 << 16, overlap: int = 1 << 10) -> list[str]:
    """The matches of the pattern over the whole text, from chunks that are matched independently.

    The pattern must match every character and look ahead at most MARGIN characters past a run.
    Where neighbours share no boundary in their overlap (one piece is wider), the left one is
    carried on, twice as wide each time, until it meets a boundary of a later chunk.
    """
    n = len(text)
    if n <= chunk + overlap:
        return pattern.findall(text)
    cuts = [(a, min(n, a + chunk + overlap)) for a in range(0, n, chunk)]
    parts = [pattern.findall(text[a:b]) for a, b in cuts]
    out: list[str] = []
    start, end, pieces, nxt, width = 0, cuts[0][1], parts[0], 1, chunk  # start is a true boundary
    while end < n:
        ends = boundaries(pieces, start)
        sure = bisect_left(ends, end - MARGIN + 1)  # pieces before this index hold in the whole text
        reached = ends[sure - 1] if sure else start
        while cuts[nxt][0] < reached and cuts[nxt][1] < n and cuts[nxt][1] - MARGIN <= reached:
            nxt += 1
        a, b = cuts[nxt]
        theirs = {x: k + 1 for k, x in enumerate(boundaries(parts[nxt], a)) if b == n or x <= b - MARGIN} | {a: 0}
        at = next((k for k in range(bisect_left(ends, a), sure) if ends[k] in theirs), None)
        if at is not None:
            out += pieces[: at + 1]
            start, end, pieces, width = ends[at], b, parts[nxt][theirs[ends[at]] :], chunk
            nxt = min(nxt + 1, len(cuts) - 1)
        else:
            out += pieces[:sure]
            width = width if sure else 2 * width
            start, end = reached, min(n, reached + width + overlap)
            pieces = pattern.findall(text[start:end])
    return out + pieces


class Codec:
    """Encoder and decoder of one rank file. Not thread-safe; build one for each worker."""

    def __init__(self, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN):
        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding(vocabulary, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.raw = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.raw[rank] = piece
        self.lengths = np.array([len(x) for x in self.raw], dtype=np.int64)
        self.known: dict[str, bytes] = {}
        self.narrow = "<u2" if len(self.raw) <= 1 << 16 else "<u4"

    def piece_ids(self, piece: str) -> bytes:
        """The ids of one pre-token as little-endian unsigned 32-bit integers."""
        ids = self.known.get(piece)
        if ids is None:
            ids = np.array(self.encoding.encode_ordinary(piece), dtype="<u4").tobytes()
            if len(piece) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def packed(self, ids: bytes) -> bytes:
        """ids in as few bytes as the vocabulary allows, for an exchange."""
        return np.frombuffer(ids, dtype="<u4").astype(self.narrow).tobytes()

    def unpacked(self, ids: bytes) -> bytes:
        return np.frombuffer(ids, dtype=self.narrow).astype("<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text."""
        return b"".join(map(self.piece_ids, pretokenise(text or "", self.pattern)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def chunk_count(length, chunk: int = CHUNK, overlap: int = OVERLAP):
    """Into how many chunks a text of so many characters (a column) is cut; the last one always holds more than the overlap."""
    return F.greatest(F.lit(1), F.ceil((length - overlap) / chunk)).cast("int")


ROWS = ["row", "key", "h", "n", "k"]
#: Chunks that are handed on at a time.
HANDED = 256


def frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    while own := list(islice(rows, HANDED)):
        yield pd.DataFrame(own, columns=columns)


def cut(batches: Iterator[pd.DataFrame], chunk: int, overlap: int) -> Iterator[tuple]:
    """(row, key, h, n, k, piece) of each of the n chunks of rows (row, key, h, n, text)."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            for k in range(row.n):
                yield row.row, row.key, row.h, row.n, k, row.text[k * chunk : (k + 1) * chunk + overlap]


def coded(codec: Codec, piece: str, first: bool, last: bool, chunk: int, overlap: int) -> tuple[bytes, bytes, bytes]:
    """(ids, head, tail) of a chunk: pairs (place, ids before it) of the boundaries in its overlaps, told from the overlap's begin."""
    pieces = codec.pattern.findall(piece)
    ids = list(map(codec.piece_ids, pieces))
    at = np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
    n = np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))) // 4
    pair = lambda a, b, base: np.stack([at[a:b] - base, n[a:b]], axis=1).astype("<i4").tobytes()
    head = b"" if first else bytes(8) + pair(0, int(np.searchsorted(at, overlap, side="right")), 0)
    tail = b"" if last else pair(int(np.searchsorted(at, chunk)), int(np.searchsorted(at, len(piece) - MARGIN, side="right")), chunk)
    return b"".join(ids), head, tail


def coded_rows(rows: DataFrame, whole: bool, vocabulary: str, kind: str, chunk: int, overlap: int) -> DataFrame:
    """(row, key, h, n, k, ids, head, tail) of chunk rows, or of whole texts that are cut in the same pass; ids in 16 bits if they fit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(vocabulary)
        chunks = cut(batches, chunk, overlap) if whole else (r for batch in batches for r in batch.itertuples(index=False))

        def rows_() -> Iterator[tuple]:
            for *own, n, k, piece in chunks:
                ids, head, tail = coded(codec, piece, k == 0, k == n - 1, chunk, overlap)
                yield *own, n, k, codec.packed(ids), head, tail

        yield from frames(rows_(), [*ROWS, "ids", "head", "tail"])

    return rows.mapInPandas(run, f"row long, key {kind}, h long, n int, k int, ids binary, head binary, tail binary")


def chunk_rows(rows: DataFrame, kind: str, chunk: int, overlap: int) -> DataFrame:
    """(row, key, h, n, k, piece) of rows (row, key, h, n, text)."""
    return rows.mapInPandas(lambda batches: frames(cut(batches, chunk, overlap), [*ROWS, "piece"]), f"row long, key {kind}, h long, n int, k int, piece string")


class Stitcher:
    """Takes the chunks of one text in their order; holds one of them (and, if kept is asked for, the ids so far)."""

    def __init__(self, codec: Codec, keep: bool):
        self.codec, self.keep = codec, keep
        self.n, self.ids_sha, self.bytes_sha, self.kept = 0, hashlib.sha256(), hashlib.sha256(), []
        self.last, self.start, self.whole = None, 0, True

    def take(self, ids: bytes) -> None:
        self.n += len(ids) // 4
        self.ids_sha.update(ids)
        self.bytes_sha.update(self.codec.decode(ids))
        if self.keep:
            self.kept.append(ids)

    def add(self, ids: bytes, head: bytes, tail: bytes) -> None:
        if self.last is not None and self.whole:
            left = dict(np.frombuffer(self.last[1], dtype="<i4").reshape(-1, 2).tolist())
            met = next(((left[at], n) for at, n in np.frombuffer(head, dtype="<i4").reshape(-1, 2).tolist() if at in left), None)
            self.whole = met is not None
            if met:
                self.take(self.last[0][4 * self.start : 4 * met[0]])
                self.start = met[1]
        self.last = (ids, tail)

    def done(self) -> tuple:
        """(n_tokens, ids_sha256, decoded_sha256, ids), or nulls if two neighbours had no common boundary."""
        if not self.whole:
            return None, None, None, None
        self.take(self.last[0][4 * self.start :])
        return self.n, self.ids_sha.hexdigest(), self.bytes_sha.hexdigest(), b"".join(self.kept) if self.keep else None


def stitched(coded_: DataFrame, vocabulary: str, kind: str, keep: bool) -> DataFrame:
    """(key, h, n_tokens, ids_sha256, decoded_sha256, ids) of each text; n_tokens is null where its chunks could not be stitched."""
    columns = ["key", "h", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, text, own, out = Codec(vocabulary), None, None, []

        def frame() -> pd.DataFrame:
            made = pd.DataFrame(out, columns=columns)
            made["n_tokens"] = made["n_tokens"].astype("Int64")
            out.clear()
            return made

        for batch in batches:
            for r in batch.itertuples(index=False):
                if text is None or r.row != text[0]:
                    if text is not None:
                        out.append((*text[1:], *own.done()))
                    text, own = (r.row, r.key, r.h), Stitcher(codec, keep)
                own.add(codec.unpacked(r.ids), r.head, r.tail)
                if len(out) >= 500:
                    yield frame()
        if text is not None:
            out.append((*text[1:], *own.done()))
        yield frame()

    return coded_.repartition("row").sortWithinPartitions("row", "k").mapInPandas(run, f"key {kind}, h long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary")


def encode_whole(docs: DataFrame, vocabulary: str, kind: str, keep: bool) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, ids) of rows (key, text), each text in one go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(vocabulary)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                rows = []
                for text in part["text"]:
                    ids = codec.encode(text)
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest(), ids if keep else None))
                out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids"])
                out.insert(0, "key", part["key"].to_numpy())
                yield out

    return docs.select("key", "text").mapInPandas(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary")


def encode(
    docs: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", digest_only: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD
) -> DataFrame:
    """(key, n_tokens, ids binary, ids_sha256, decoded_sha256) of each row; digest_only leaves out ids."""
    kind = docs.schema[key].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.xxhash64(text).alias("h"), chunk_count(F.char_length(text), chunk, overlap).alias("n"), text.alias("text"))
    near = coded_rows(rows.where((F.col("n") > 1) & (F.col("n") <= spread)), True, vocabulary, kind, chunk, overlap)
    far = coded_rows(chunk_rows(rows.where(F.col("n") > spread), kind, chunk, overlap).repartition("row", "k"), False, vocabulary, kind, chunk, overlap)
    # rows of the two scans are told apart by their sign
    both = near.unionByName(far.withColumn("row", -1 - F.col("row")))
    joined = materialize(stitched(both, vocabulary, kind, not digest_only))
    found = encode_whole(rows.where("n = 1"), vocabulary, kind, not digest_only).unionByName(joined.where("n_tokens is not null").drop("h"))
    apart = joined.where("n_tokens is null").select(F.col("key").alias("_key"), F.col("h").alias("_h")).distinct()
    if not apart.isEmpty():
        same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("h") == F.col("_h"))
        found = found.unionByName(encode_whole(rows.where("n > 1").join(apart, same, "left_semi"), vocabulary, kind, not digest_only))
    ids = [] if digest_only else ["ids"]
    return found.select(F.col("key").alias(key), "n_tokens", "ids_sha256", "decoded_sha256", *ids)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id") -> DataFrame:
    """(key, bytes binary) from the ids column of encode(); null ids give empty bytes."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(vocabulary)
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "bytes": [codec.decode(x or b"") for x in batch["ids"]]})

    return encoded.select(key, "ids").mapInPandas(run, f"`{key}` {kind}, bytes binary")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), digest_only=True)
