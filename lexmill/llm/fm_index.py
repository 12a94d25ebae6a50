"""Operator 8: benchmark decontamination with an FM-index for each training shard.

Documents are cut into shards of bounded size where they lie, without a shuffle. The words of a shard
that occur in test phrases at all form runs; runs shorter than the shortest phrase can hold none and
are left out. Over the rest an FM-index is built: suffix order by prefix doubling, a wavelet matrix
for ranks in the Burrows-Wheeler transform, and positions sampled along the text. All phrases are
searched backward at once, occurrences are located by walking to the next sampled position, and the
located spans are merged for each document.

The phrases are read in blocks of BLOCK_CHARS characters of benchmark text (a fixed bound on what is
broadcast); documents pass every block in turn and carry the hits found so far.

Null texts have no words; a null item_id counts as the empty string; repeated rows are kept as they
come; an empty benchmark hits nothing. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import table

WINDOW = 13
#: Characters of benchmark text in one broadcast block, and of documents in one index.
BLOCK_CHARS = 4_000_000
SHARD_CHARS = 8_000_000
SAMPLE_EVERY = 16
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # on lower-cased UTF-8: bytes of other characters are all over 7F


def words(text: str | None) -> list[bytes]:
    """Lower-cased words; on bytes the pattern finds what it finds on characters."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class WaveletMatrix:
    """Rank of any symbol before any position of a sequence of ints under 2 ** bits."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(len(seq) - int(self.ones[-1][-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        low, at = np.zeros_like(at), at.copy()
        for k in range(self.bits):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            r, s = self.ones[k][at], self.ones[k][low]
            at = np.where(one, self.zeros[k] + r, at - r)
            low = np.where(one, self.zeros[k] + s, low - s)
        return at - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out, at = np.zeros_like(at), at.copy()
        for k in range(self.bits):
            one = self.ones[k][at + 1] > self.ones[k][at]
            r = self.ones[k][at]
            at = np.where(one, self.zeros[k] + r, at - r)
            out = out * 2 + one
        return out


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes; the sequence must end with its unique least symbol."""
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    n, step = len(seq), 1
    order = np.argsort(rank, kind="stable")
    while step < n:
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank[order] = new
        if new[-1] == n - 1:
            break
        step *= 2
    return order


class FMIndex:
    """Over a sequence of ints from 1; 0 ends it."""

    def __init__(self, seq: np.ndarray, sigma: int, every: int = SAMPLE_EVERY):
        seq = np.concatenate([seq, [0]]).astype(np.int64)
        self.n = len(seq)
        order = suffix_order(seq)
        bwt = seq[order - 1]
        self.wavelet = WaveletMatrix(bwt, max(1, int(sigma).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma + 1))])
        sampled = order % every == 0
        self.sampled = np.concatenate([[0], np.cumsum(sampled, dtype=np.int64)])
        self.positions = order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase (rows, filled with 0 at the right)."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            on = np.flatnonzero((lengths >= back) & (low < high))
            if not len(on):
                break
            c = phrases[on, lengths[on] - back]
            low[on] = self.first[c] + self.wavelet.rank(c, low[on])
            high[on] = self.first[c] + self.wavelet.rank(c, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of rows of the suffix order."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        on = np.arange(len(rows))
        while len(on):
            there = self.sampled[rows[on] + 1] > self.sampled[rows[on]]
            hit = on[there]
            out[hit] = self.positions[self.sampled[rows[hit]]] + steps[hit]
            on = on[~there]
            c = self.wavelet.symbol(rows[on])
            rows[on] = self.first[c] + self.wavelet.rank(c, rows[on])
            steps[on] += 1
        return out


class Phrases:
    """The windows of a block of test items as rows of word numbers, and the items of each window."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        of: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text))
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                of.setdefault(ids[k : k + window], set()).add(item or "")
        self.items = [sorted(x) for x in of.values()]
        self.lengths = np.array([len(x) for x in of], dtype=np.int64)
        self.rows = np.zeros((len(of), window), dtype=np.int64)
        for k, ids in enumerate(of):
            self.rows[k, : len(ids)] = ids
        self.shortest = int(self.lengths.min(initial=window))

    def hits(self, texts: list[str | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
        """Of each text: number of words, merged hit spans in words, and the items with a window in it."""
        counts, parts, starts, docs = [], [], [], []
        get = self.numbers.get
        for d, text in enumerate(texts):
            found = words(text)
            counts.append(len(found))
            if len(found) < self.shortest or not self.numbers:
                continue
            ids = np.array([get(w, 0) for w in found], dtype=np.int64)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], ids != 0, [0]])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if b - a >= self.shortest:
                    parts += [ids[a:b], [0]]
                    starts.append(a)
                    docs.append(d)
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        if parts:
            sigma = len(self.numbers) + 1
            seq = np.concatenate(parts)
            seq = np.where(seq == 0, sigma, seq)  # runs are parted by a symbol that no phrase has
            runs = np.concatenate([[0], np.flatnonzero(seq == sigma)[:-1] + 1])
            index = FMIndex(seq, sigma)
            low, high = index.search(self.rows, self.lengths)
            size = high - low
            phrase = np.repeat(np.arange(len(size)), size)
            rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
            at = index.locate(rows)
            run = np.searchsorted(runs, at, side="right") - 1
            doc = np.array(docs)[run]
            begin = at - runs[run] + np.array(starts)[run]
            order = np.lexsort((begin, doc))
            for d, a, p in zip(doc[order].tolist(), begin[order].tolist(), phrase[order].tolist(), strict=True):
                spans[d].append((a, a + int(self.lengths[p])))
                items[d].update(self.items[p])
            spans = [merge(x) for x in spans]
        return counts, spans, items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of sorted spans."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def shards(batches: Iterator[pd.DataFrame], text: str, limit: int = SHARD_CHARS) -> Iterator[pd.DataFrame]:
    """The rows in pieces of at most limit characters (or one row)."""
    for batch in batches:
        number = batch[text].str.len().fillna(0).cumsum() // limit
        for _, part in batch.groupby(number, sort=False):
            yield part


def find(docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = ("doc_id",), block_chars: int = BLOCK_CHARS, window: int = WINDOW) -> DataFrame:
    """carry columns (other names than those that follow) and (n_words, spans array<struct<start,end>> in words, items array<string>) of each document."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    number = F.pmod(F.xxhash64("text"), F.lit(blocks))
    spark = docs.sparkSession
    fields = [docs.schema[c] for c in carry]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    own = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"
    source = "text" if "text" in carry else "_text"
    apart = "text" not in carry
    docs = docs.select(*carry, *[docs["text"].alias("_text")] * apart, F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    for block in range(blocks):
        part = benchmark if blocks == 1 else benchmark.where(number == block)
        rows = part.select(F.col("item_id").cast("string"), "text").distinct().collect()  # at most about block_chars
        phrases = spark.sparkContext.broadcast(Phrases([tuple(r) for r in rows], window))
        last = block == blocks - 1

        def run(batches: Iterator[pd.DataFrame], phrases=phrases, last=last) -> Iterator[pd.DataFrame]:
            p = phrases.value
            for batch in shards(batches, source):
                counts, spans, items = p.hits(batch[source].tolist())
                out = batch[list(carry)].copy()
                if not last and apart:
                    out["_text"] = batch["_text"]
                out["n_words"] = counts
                out["spans"] = [
                    [{"start": a, "end": b} for a, b in merge(sorted([*new, *((x["start"], x["end"]) for x in old)]))]
                    for new, old in zip(spans, batch["spans"], strict=True)
                ]
                out["items"] = [sorted(new | set(old)) for new, old in zip(items, batch["items"], strict=True)]
                yield out

        docs = docs.mapInPandas(run, ", ".join([head, *["_text string"] * (not last and apart), own]))
    return docs


def judge(found: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The counts, the items' digest and the verdict: contaminated if hit words are a twentieth of the words or more."""
    hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]), F.lit(0).cast("long"))
    return found.select(*carry, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("_items")).select(
        *carry, "n_words", "n_hit", "n_items", F.sha2("_items", 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    where = [m.span() for m in WORD.finditer(text.encode("utf-8", "surrogatepass").lower())]
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    for a, b in spans:
        out.append(raw[at : where[a][0]])
        at = where[b - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT g.doc_id, g.i, g.n, wins.item_id FROM grams g JOIN wins ON g.s = wins.s AND g.n = wins.n),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
