"""Operator 10: an interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark, read by memory map.

Training: each task counts the n-grams of blocks of BLOCK_TOKENS and sends them, as numbers of the block's
words, to parts by the hash of their middle word; the block's words are a file in the shared folder. A part holds
all n-grams around its middle words, so it knows each context's followers and counts, and for each bigram
(middle, last) the number of distinct words before it, its continuation count. It writes them as sorted hash
arrays into the shared folder. A frequent middle word is spread over several parts by the first word; its
bigrams are put together in the part of their last word. There each word's occurrences and distinct
predecessors are added up, too. Only counts of counts and the totals of spread words come to the driver.
Scoring maps the files into memory; pages are shared by the workers of a machine.

Middle words are told apart by 64 bits; words around one, by 32 bits among those of the same middle word and
part, whose number does not grow with the corpus. The shared folder must be mounted on the workers (a file: URI).

Null texts are empty: one end token. A null doc_id counts as the empty string when the training rows
are chosen. With no training row every token has probability one. Repeated rows count each.
"""

from __future__ import annotations

import ctypes
import json
import os
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import materialize, shared_dir, table

ORDER = 3
BLOCK_TOKENS = 2_000_000
#: Training text, in characters, for each part of the model.
PART_CHARS = 10_000_000
#: A word with more than this share of the tokens may be spread over parts, so there are at most 100,000 such words.
SPREAD_SHARE = 1e-5
#: Characters that the shares of words are estimated from, and for each part; they only decide where n-grams go.
SAMPLE_CHARS, SAMPLE_A_PART = 20_000_000, 4_000
#: Contexts of more followers have their sums stored.
FEW = 32

TABLE = np.array([xxhash.xxh64_intdigest(bytes([c + 32 if 65 <= c <= 90 else c]), 7) for c in range(256)], dtype=np.uint64)
SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
TABLE[SPACE] = 0
BASE = 0x9E3779B97F4A7C15
BLANKS = [bytes([c]) for c in range(256) if SPACE[c]]
PIECE_BYTES = 1 << 20
#: Files of the model that a worker keeps open.
OPEN = 400
BEGIN, END = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b"\n<s>", b"\n</s>"))  # no word has a line feed


def trim() -> None:
    """Freed memory goes back to the system; else workers that wait for their next task keep it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)


def mix(a: np.ndarray, b) -> np.ndarray:
    """A 64-bit hash of pairs of hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def part_of(h: np.ndarray, parts) -> np.ndarray:
    """The range of hashes that h lies in."""
    return ((h >> np.uint64(32)) * np.asarray(parts).astype(np.uint64) >> np.uint64(32)).astype(np.int64)


class Tokens:
    """Texts to hashes of lower-cased (A-Z) words parted by ASCII white space, each text with an end.

    A word's hash is that of the polynomial of its bytes (each a 64-bit number) at BASE, taken from running sums.
    """

    def __init__(self):
        self.powers, self.inverse = (np.ones(1, dtype=np.uint64) for _ in range(2))

    def grow(self, n: int) -> None:
        n = 1 << (n - 1).bit_length()
        for name, base in (("powers", BASE), ("inverse", pow(BASE, -1, 1 << 64))):
            x = np.full(n, base, dtype=np.uint64)
            x[0] = 1
            setattr(self, name, np.multiply.accumulate(x))

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' hashes, and how many each text has."""
        size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        if len(raw) > len(self.powers):
            self.grow(len(raw))
        edge = np.flatnonzero(np.diff(SPACE[raw], prepend=True))
        start, stop = edge[::2], edge[1::2]
        run = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(TABLE[raw] * self.powers[: len(raw)], out=run[1:])
        hashes = mix((run[stop] - run[start]) * self.inverse[start], np.uint64(0))
        return hashes, np.diff(np.searchsorted(start, np.cumsum(size)), prepend=0)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, where each text ends)."""
        owner, held, size, hashes, n = [], [], 0, [], []
        for k, t in enumerate(texts):
            for piece in cut(t.encode("utf-8", "surrogatepass") if t else b""):
                owner.append(k)
                held.append(piece)
                size += len(piece) + 1
                if size >= PIECE_BYTES:
                    for x, y in zip((hashes, n), self.words(held), strict=True):
                        x.append(y)
                    held, size = [], 0
        if held:
            for x, y in zip((hashes, n), self.words(held), strict=True):
                x.append(y)
        if not owner:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        ends = np.cumsum(np.bincount(owner, np.concatenate(n)).astype(np.int64) + 1)
        out = np.full(int(ends[-1]), END, dtype=np.uint64)
        keep = np.ones(len(out), dtype=bool)
        keep[ends - 1] = False
        out[keep] = np.concatenate(hashes)
        return out, ends


def cut(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of about PIECE_BYTES that end between words; a longer word stays whole."""
    at = 0
    while len(raw) - at > PIECE_BYTES:
        end = max(raw.rfind(c, at + 1, at + PIECE_BYTES) for c in BLANKS)
        if end < 0:
            end = min((x for x in (raw.find(c, at + PIECE_BYTES) for c in BLANKS) if x >= 0), default=len(raw))
        yield raw[at:end]
        at = end
    yield raw[at:]


def before(h: np.ndarray, ends: np.ndarray, k: int = 1) -> np.ndarray:
    """The token k before each token, BEGIN where the text has none."""
    out = np.full_like(h, BEGIN)
    out[k:] = h[:-k] if k else h
    start = np.concatenate([[0], ends[:-1]])
    for j in range(k):
        at = start + j
        out[at[at < ends]] = BEGIN
    return out


def grams(h: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and the middle word of each token's n-gram; order 2 has no first word."""
    return (before(h, ends, 2) if order == 3 else np.zeros_like(h)), before(h, ends)


def pieces(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    """Rows gathered or cut to about limit tokens (six characters each)."""
    held, chars = [], 0
    for batch in batches:
        size = batch["text"].str.len().fillna(0).to_numpy()
        at = 0
        for k, n in enumerate(size):
            chars += n + 6
            if chars >= 6 * limit:
                held.append(batch.iloc[at : k + 1])
                yield pd.concat(held, ignore_index=True)
                held, chars, at = [], 0, k + 1
        held.append(batch.iloc[at:])
    if held:
        yield pd.concat(held, ignore_index=True)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers under 2**32 by planes of their bytes, compressed."""
    raw = b"".join(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for x in arrays)
    return np.array([len(arrays), *map(len, arrays)], "<u4").tobytes() + zstandard.ZstdCompressor(level=1).compress(raw)


def unpacked(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    sizes = np.frombuffer(blob, "<u4", n, 4).tolist()
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob[4 * n + 4 :], max_output_size=4 * sum(sizes) + 1), 0, []
    for size in sizes:
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, size).T).view("<u4").reshape(-1))
        at += 4 * size
    return out


def runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(sorted_keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(sorted_keys[0]), dtype=bool)
    new[0] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def sizes(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(first, n))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def starts(of: np.ndarray, n: int) -> np.ndarray:
    """Of sorted owners of n kinds, where each kind's rows begin, and the end."""
    return np.searchsorted(of, np.arange(n + 1)).astype("<u4")


def count_of_counts(n: np.ndarray) -> np.ndarray:
    return np.array([(n == k).sum() for k in (1, 2, 3, 4)], dtype=np.int64)


def few(n: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(sum, ones, twos, more) of each run of counts, by rows."""
    return np.stack([sums(x, first) for x in (n, n == 1, n == 2, n > 2)])


def store(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Arrays in one file, whole or not at all, whatever attempt of the task it is."""
    head, at = {}, 0
    for k, x in arrays.items():
        head[k] = (np.lib.format.dtype_to_descr(x.dtype), list(x.shape), at)
        at += -(-x.nbytes // 8) * 8
    told = json.dumps(head).encode()
    told += b" " * (-len(told) % 8)
    own = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(len(told).to_bytes(8, "little") + told)
        for x in arrays.values():
            f.write(np.ascontiguousarray(x).tobytes() + b"\0" * (-x.nbytes % 8))
    os.replace(own, f"{folder}/{name}")


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory."""
    raw = np.asarray(np.memmap(path, dtype=np.uint8, mode="r"))
    n = int(raw[:8].view("<u8")[0])
    out = {}
    for k, (descr, shape, at) in json.loads(raw[8 : 8 + n].tobytes()).items():
        dtype = np.lib.format.descr_to_dtype([tuple(x) for x in descr] if isinstance(descr, list) else descr)
        begin, size = 8 + n + at, int(np.prod(shape)) * dtype.itemsize
        out[k] = raw[begin : begin + size].view(dtype).reshape(shape)
    return out


def counts(name: str, n: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes; those over 254 stand with their places in an array of their own."""
    big = np.flatnonzero(n > 254)
    return {name: np.minimum(n, 255).astype(np.uint8), f"{name}_more": np.stack([big, n[big]]).astype("<u8")}


def large(n: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The sums of runs with more than FEW counts: place, sum, ones, twos, more, by rows."""
    begin = begin.astype(np.int64)
    many = np.flatnonzero(np.diff(begin) > FEW)
    if not len(many):
        return np.zeros((5, 0), "<u8")
    bounds = np.stack([begin[many], begin[many + 1]], axis=1).reshape(-1)
    return np.concatenate([many[None], few(n, bounds[:-1] if bounds[-1] == len(n) else bounds)[:, ::2]]).astype("<u8")


def ordered(key: np.ndarray, exact: np.ndarray) -> np.ndarray:
    """The order by key, and by exact where keys are equal (they rarely are with different exact ones)."""
    by = np.argsort(key)
    k, e = key[by], exact[by]
    return np.lexsort((exact, key)) if ((k[1:] == k[:-1]) & (e[1:] != e[:-1])).any() else by


def under(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A key of the owner's number and 32 bits of a hash."""
    return (owner.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32))


def discounts(n: list[int]) -> np.ndarray:
    """D0 = 0, D1, D2, D3+ of modified Kneser-Ney from the counts of counts; halves where they are too few."""
    n1, n2, n3, n4 = n
    if not min(n):
        return np.array([0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0, *(min(max(x, 0.01), k + 0.99) for k, x in enumerate(d))])


class Places:
    """The part of an n-gram: by its middle word, and for spread middle words by the first word, too."""

    def __init__(self, parts: int, spread: dict[int, int]):
        self.parts = parts
        self.words = np.array(sorted(spread), dtype=np.uint64)
        self.over = np.array([spread[w] for w in sorted(spread)], dtype=np.int64)

    def spread(self, middle: np.ndarray) -> np.ndarray:
        """The place of each spread word in the list, else -1."""
        if not len(self.words):
            return np.full(len(middle), -1)
        at = np.minimum(np.searchsorted(self.words, middle), len(self.words) - 1)
        return np.where(self.words[at] == middle, at, -1)

    def __call__(self, first: np.ndarray, middle: np.ndarray) -> np.ndarray:
        salt, hot = np.zeros(len(middle), dtype=np.uint64), self.spread(middle)
        there = np.flatnonzero(hot >= 0)
        salt[there] = part_of(mix(first[there], np.uint64(1)), self.over[hot[there]])
        return part_of(mix(middle, salt), self.parts)


def frequent(docs: DataFrame, chars: int, parts: int) -> dict[int, int]:
    """Words that fill more than half a part by their share of a sample of texts, with how many parts they go over."""
    share = max(SPREAD_SHARE, 0.5 / parts)
    rate = max(SAMPLE_CHARS, SAMPLE_A_PART * parts) / max(1, chars)
    sample = docs.select("text") if rate >= 1 else docs.select("text").where(F.rand(42) < rate)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens()
        for batch in pieces(batches, BLOCK_TOKENS):
            h, ends = tokens(batch["text"].tolist())
            words, n = np.unique(h[h != END], return_counts=True)
            kept = n > 0.1 * share * len(h)  # words below that in every block are below the share
            yield pd.DataFrame({"w": np.append(words[kept].view(np.int64), 0), "n": np.append(n[kept], len(h)), "all": np.append(np.zeros(kept.sum(), bool), True)})

    got = sample.mapInPandas(count, "w long, n long, all boolean").groupBy("w", "all").agg(F.sum("n").alias("n"))
    rows = got.orderBy(F.desc("all"), F.desc("n"), "w").limit(2 + int(1 / share)).collect()  # no more words can have the share
    total = rows[0].n if rows else 0
    return {int(np.int64(r.w).view(np.uint64)): min(parts, int(np.ceil(2 * parts * r.n / total))) for r in rows[1:] if r.n > share * total}


WORD = np.dtype([("key", "<u8"), ("n", "<u8"), ("before", "<u4")])
PAIR = np.dtype([("middle", "<u8"), ("last", "<u8"), ("n", "<u4")])
SPREAD = np.dtype([("key", "<u8"), ("n", "<u4")])


def train(docs: DataFrame, order: int = ORDER, part_chars: int = PART_CHARS) -> dict:
    """The model of the text column: folder, numbers of parts, totals and discounts. Runs at once."""
    if order not in (2, 3):
        raise ValueError(f"order {order}: 2 and 3 are built")
    spark = docs.sparkSession
    shared = shared_dir(spark)
    if not shared.startswith(("file:", "/")):
        raise ValueError(f"{shared} is not a mounted folder; the model's files need one")
    folder = "/" + shared.removeprefix("file:").strip("/") + f"/kneser-ney-{uuid.uuid4().hex}"
    os.makedirs(folder)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(12, -(-chars // part_chars))
    word_parts = max(6, parts // 4)
    place = Places(parts, frequent(docs, chars, parts) if order == 3 else {})

    def block(h1: np.ndarray, h2: np.ndarray, h3: np.ndarray) -> list[tuple[int, str, bytes]]:
        """(part, file of words, numbers of middle words, first words and last words with counts) of the distinct n-grams."""
        words, last = np.unique(np.concatenate([h3, h2[:1], h1[:2], [BEGIN]]), return_inverse=True)
        last = last[: len(h3)]
        rank = np.empty(len(words), dtype=np.int64)
        rank[np.argsort(-np.bincount(last, minlength=len(words)), kind="stable")] = np.arange(len(words))  # frequent words have small numbers
        number = lambda h: rank[np.searchsorted(words, h)]
        last, none = rank[last], number(BEGIN)
        middle = np.concatenate([number(h2[:1]), last[:-1]])
        first = np.concatenate([number(h1[:2]), last[:-2]])[: len(h3)] if order == 3 else np.zeros(len(h3), dtype=np.int64)
        middle[h2 == BEGIN] = none
        first[h1 == BEGIN] = none
        bits = max(1, int(len(words)).bit_length())
        key = np.sort((middle << (2 * bits)) | (first << bits) | last)
        at = runs(key)
        n, key = sizes(at, len(key)), key[at]
        mask = (1 << bits) - 1
        middle, first, last = key >> (2 * bits), (key >> bits) & mask, key & mask
        by_rank = np.empty(len(words), dtype=np.uint64)
        by_rank[rank] = words
        part = place(by_rank[first] if order == 3 else np.zeros(len(first), np.uint64), by_rank[middle])
        by = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
        cut = np.searchsorted(part[by], np.arange(parts + 1))
        name = f"words-{uuid.uuid4().hex}"
        store(folder, name, words=by_rank)
        rows = []
        for p in np.flatnonzero(np.diff(cut)).tolist():
            own = by[cut[p] : cut[p + 1]]
            m, f = middle[own], first[own]
            c = runs(m, f)  # contexts
            w = runs(m[c])  # middle words
            rows.append((p, name, packed(m[c][w], sizes(w, len(c)), f[c], sizes(c, len(own)), last[own], n[own])))
        return rows

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens()
        for batch in pieces(batches, BLOCK_TOKENS):
            if len(batch):
                h3, ends = tokens(batch["text"].tolist())
                h1, h2 = grams(h3, ends, order)
                for at in range(0, len(h3), BLOCK_TOKENS):  # more than one only for very long texts
                    part = slice(at, at + BLOCK_TOKENS)
                    yield pd.DataFrame(block(h1[part], h2[part], h3[part]), columns=["part", "words", "blob"])
                del h1, h2, h3
        trim()

    def join(part: pd.DataFrame) -> pd.DataFrame:
        p, got = int(part["part"].iloc[0]), []
        for name, blob in zip(part["words"], part["blob"], strict=True):
            words = load(f"{folder}/{name}")["words"]
            m, contexts, f, followers, last, n = unpacked(blob)
            got.append((words[m], contexts, words[f] if order == 3 else np.zeros(len(f), np.uint64), followers, words[last], n))
        middle, contexts, first, followers, last, n = (np.concatenate(x) for x in zip(*got, strict=True))
        del got, words, m, f
        words, of = np.unique(middle, return_inverse=True)
        key = under(np.repeat(of, contexts), first)
        by = ordered(key, first)
        at = runs(key[by], first[by])
        context, of = key[by][at], np.empty(len(key), dtype=np.int64)
        of[by] = np.repeat(np.arange(len(at)), sizes(at, len(by)))
        del middle, first
        key = under(np.repeat(of, followers), last)
        by = ordered(key, last)
        at = runs(key[by], last[by])
        key, last, n = key[by][at], last[by][at], sums(n[by], at)
        del of, by
        of_context = (key >> np.uint64(32)).astype(np.int64)
        of_word = (context >> np.uint64(32)).astype(np.int64)
        begin = starts(of_context, len(context))
        arrays = {"middle": words, "middle_first": starts(of_word, len(words)), "context": context.astype("<u4"), "context_first": begin, "last": key.astype("<u4")}
        arrays |= counts("n", n) | {"n_large": large(n, begin)}
        coc = count_of_counts(n).tolist()
        # bigrams of the middle and the last word: how many first words they have
        pair = under(of_word[of_context], last)
        by = ordered(pair, last)
        at = runs(pair[by], last[by])
        pair, ahead, times, last = pair[by][at], sizes(at, len(by)), sums(n[by], at), last[by][at]
        of_word = (pair >> np.uint64(32)).astype(np.int64)
        spread = place.spread(words)[of_word] >= 0
        own = np.flatnonzero(~spread)
        if order == 3:
            begin = starts(of_word[own], len(words))
            arrays |= {"pair": pair[own].astype("<u4"), "pair_first": begin} | counts("ahead", ahead[own]) | {"ahead_large": large(ahead[own], begin)}
        store(folder, f"grams-{p}", **arrays)
        by = np.argsort(last)
        at = runs(last[by])
        out = np.empty(len(at), WORD)
        out["key"], out["n"], out["before"] = last[by][at], sums(times[by], at), sums(~spread[by], at)
        rows = sent(out, out["key"], "word")
        if spread.any():
            hot = np.empty(int(spread.sum()), PAIR)
            hot["middle"], hot["last"], hot["n"] = words[of_word[spread]], last[spread], ahead[spread]
            rows += sent(hot, hot["last"], "pair")
        del arrays, pair, key, context, last, times
        trim()
        return pd.DataFrame([*rows, (-1, "", b"", coc, count_of_counts(ahead[own]).tolist())], columns=["part", "kind", "blob", "grams", "pairs"])

    def sent(rows: np.ndarray, key: np.ndarray, kind: str) -> list[tuple]:
        to = part_of(key, word_parts)
        by = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[by], np.arange(word_parts + 1))
        return [(q, kind, rows[by[a:b]].tobytes(), [0] * 4, [0] * 4) for q, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]

    def words(part: pd.DataFrame) -> pd.DataFrame:
        q = int(part["part"].iloc[0])
        if q < 0:
            return pd.DataFrame([(0, 0, 0, *(np.sum(part[c].tolist(), axis=0).tolist() for c in ("grams", "pairs")), [0] * 4, [])], columns=COLUMNS)
        got = {kind: np.concatenate([np.zeros(0, dtype), *(np.frombuffer(b, dtype) for b in part["blob"][part["kind"] == kind])]) for kind, dtype in (("word", WORD), ("pair", PAIR))}
        hot = got["pair"][np.lexsort((got["pair"]["last"], got["pair"]["middle"]))]
        at = runs(hot["middle"], hot["last"])
        ahead, hot = sums(hot["n"], at), hot[at]
        spread = np.empty(len(hot), SPREAD)
        spread["key"], spread["n"] = mix(hot["middle"], hot["last"]), np.minimum(ahead, 0xFFFFFFFF)
        at = runs(hot["middle"])
        totals = [dict(zip(("word", "n", "n1", "n2", "n3"), (w, *s), strict=True)) for w, s in zip(hot["middle"][at].view(np.int64).tolist(), few(ahead, at).T.tolist(), strict=True)]
        more = np.zeros(len(hot), WORD)
        more["key"], more["before"] = hot["last"], 1
        rows = np.concatenate([got["word"], more])
        rows = rows[np.argsort(rows["key"])]
        at = runs(rows["key"])
        out = np.empty(len(at), WORD)
        out["key"] = rows["key"][at]
        for name in ("n", "before"):
            out[name] = sums(rows[name], at)
        store(folder, f"words-of-{q}", word=out, spread=spread[np.argsort(spread["key"])])
        row = (int(out["n"].sum()), len(out), int(out["before"].sum()), [0] * 4, count_of_counts(ahead).tolist(), count_of_counts(out["before"]).tolist(), totals)
        return pd.DataFrame([row], columns=COLUMNS)

    counted = docs.select("text").mapInPandas(count, "part int, words string, blob binary")
    joined = counted.groupBy("part").applyInPandas(join, "part int, kind string, blob binary, grams array<long>, pairs array<long>")
    kind = "array<struct<word:long,n:long,n1:long,n2:long,n3:long>>"
    stats = materialize(joined.groupBy("part").applyInPandas(words, f"n long, v long, pairs long, grams array<long>, bigrams array<long>, words array<long>, spread {kind}"))
    each = [F.sum(F.get(c, k)).alias(f"{c}{k}") for c in ("grams", "bigrams", "words") for k in range(4)]
    total = stats.agg(*(F.sum(c).alias(c) for c in ("n", "v", "pairs")), *each).first()
    spread = stats.select(F.explode("spread").alias("x")).groupBy("x.word").agg(*(F.sum(f"x.{c}").alias(c) for c in ("n", "n1", "n2", "n3"))).collect()  # spread words are few
    for name in os.listdir(folder):  # the blocks' words have done their work
        if name.startswith("words-") and not name.startswith("words-of-"):
            os.remove(f"{folder}/{name}")
    of = lambda c: [total[f"{c}{k}"] or 0 for k in range(4)]
    return {
        "folder": folder, "order": order, "parts": parts, "word_parts": word_parts, "place": place, "n": total.n or 0, "v": total.v or 0, "pairs": total.pairs or 0,
        "discounts": [discounts(of(c)) for c in ("words", "bigrams", "grams")], "words": of("words"),
        "spread": {int(np.int64(r.word).view(np.uint64)): (r.n, r.n1, r.n2, r.n3) for r in spread},
    }


COLUMNS = ["n", "v", "pairs", "grams", "bigrams", "words", "spread"]


def bisect(a: np.ndarray, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each x, its place in its own sorted range a[low:high], -1 where it is not there."""
    out, size = np.full(len(x), -1), high - low
    least = 0
    for most in (1, 8, 64, 1024, 1 << 62):  # ranges of about one size take equally many steps
        own = np.flatnonzero((size > least) & (size <= most))
        least = most
        if not len(own):
            continue
        at, left, want = low[own], size[own], x[own]
        for _ in range(int(left.max() - 1).bit_length()):
            half = left >> 1  # none if one is left
            at += half * (a[at + half - 1] < want)
            left -= half
        at += a[at] < want
        there = np.flatnonzero(at < high[own])
        there = there[a[at[there]] == want[there]]
        out[own[there]] = at[there]
    return out


def taken(f: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    """Stored counts at places; 0 at -1."""
    n = np.where(at >= 0, f[name][np.maximum(at, 0)], 0).astype(np.int64) if len(f[name]) else np.zeros(len(at), np.int64)
    full = np.flatnonzero(n == 255)
    if len(full):
        places, values = f[f"{name}_more"]
        n[full] = values[np.searchsorted(places, at[full].astype(np.uint64))]
    return n


def totals(f: dict[str, np.ndarray], name: str, run: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(sum, ones, twos, more), by rows, of the stored counts in [begin, end) of each run."""
    out = np.zeros((4, len(run)), dtype=np.int64)
    size = end - begin
    small = np.flatnonzero((size > 0) & (size <= FEW))
    if len(small):
        n = size[small]
        first = np.cumsum(n) - n
        out[:, small] = few(taken(f, name, np.repeat(begin[small] - first, n) + np.arange(int(n.sum()))), first)
    many = np.flatnonzero(size > FEW)
    if len(many):
        rows = f[f"{name}_large"]
        out[:, many] = rows[1:, np.searchsorted(rows[0], run[many].astype(np.uint64))]
    return out


class Model:
    """Log probabilities by memory-mapped files."""

    def __init__(self, model: dict):
        self.m, self.place = model, model["place"]
        self.files: dict[str, dict[str, np.ndarray] | None] = {}
        self.d1, self.d2, self.d3 = model["discounts"]
        self.spread = 0.0  # the mass that discounts leave to the uniform distribution
        if model["pairs"]:
            n1, n2 = model["words"][:2]
            self.spread = (self.d1[1] * n1 + self.d1[2] * n2 + self.d1[3] * (model["v"] - n1 - n2)) / model["pairs"]
        self.totals = np.array([model["spread"].get(int(w), (0, 0, 0, 0)) for w in self.place.words], dtype=np.int64).reshape(-1, 4)

    def file(self, name: str) -> dict[str, np.ndarray] | None:
        if name not in self.files:
            while len(self.files) >= OPEN:
                del self.files[next(iter(self.files))]
            path = f"{self.m['folder']}/{name}"
            self.files[name] = load(path) if os.path.exists(path) else None
        return self.files[name]

    def find(self, kind: str, part: np.ndarray, key: np.ndarray, fields: tuple[str, ...]) -> list[np.ndarray]:
        """The fields of each key, 0 where it is not stored."""
        out = [np.zeros(len(key), dtype=np.int64) for _ in fields]
        for own in groups(part):
            rows = (self.file(f"words-of-{part[own[0]]}") or {}).get(kind, ())
            if not len(rows):
                continue
            wanted, back = np.unique(key[own], return_inverse=True)
            at = np.minimum(np.searchsorted(rows["key"], wanted), len(rows) - 1)
            got = rows[at]
            there = got["key"] == wanted
            for o, f in zip(out, fields, strict=True):
                o[own] = np.where(there, got[f], 0).astype(np.int64)[back]
        return out

    def score(self, h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count in training, log10 probability) of each token."""
        m = self.m
        if not m["pairs"]:
            return np.zeros(len(h), dtype=np.int64), np.zeros(len(h))
        h1, h2 = grams(h, ends, m["order"])
        n, ahead = self.find("word", part_of(h, m["word_parts"]), h, ("n", "before"))
        p = (ahead - self.d1[np.minimum(ahead, 3)]) / m["pairs"] + self.spread / (m["v"] + 1)
        hot = self.place.spread(h2) if m["order"] == 3 else np.full(len(h), -1)
        there = np.flatnonzero(hot >= 0)
        if len(there):
            (c,) = self.find("spread", part_of(h[there], m["word_parts"]), mix(h2[there], h[there]), ("n",))
            p[there] = backed(c, self.totals[hot[there]].T, self.d2, p[there])
        part = self.place(h1, h2)
        for own in groups(part):
            f = self.file(f"grams-{part[own[0]]}")
            if f is None:
                continue
            own = own[np.argsort(h2[own], kind="stable")]
            word = np.minimum(np.searchsorted(f["middle"], h2[own]), len(f["middle"]) - 1)
            known = f["middle"][word] == h2[own]
            own, word = own[known], word[known]
            if not len(own):
                continue
            high = lambda x: (x[own] >> np.uint64(32)).astype(np.uint32)
            span = lambda name, run: (f[name][run].astype(np.int64), f[name][run + 1].astype(np.int64))
            if m["order"] == 3:
                begin, end = span("pair_first", word)
                c = taken(f, "ahead", bisect(f["pair"], begin, end, high(h)))
                whole = totals(f, "ahead", word, begin, end)
                p[own] = np.where(hot[own] >= 0, p[own], backed(c, whole, self.d2, p[own]))
            context = bisect(f["context"], *span("middle_first", word), high(h1))
            begin, end = span("context_first", np.maximum(context, 0))
            end = np.where(context >= 0, end, begin)
            c = taken(f, "n", bisect(f["last"], begin, end, high(h)))
            p[own] = backed(c, totals(f, "n", context, begin, end), self.d3, p[own])
        return n, np.log10(p)


def groups(part: np.ndarray) -> Iterator[np.ndarray]:
    """The places of each part."""
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")
    cut = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
        yield order[a:b]


def backed(c: np.ndarray, sums_: np.ndarray, d: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Discounted counts, and what the discounts leave times the lower order; that alone where a context is new."""
    total, n1, n2, n3 = sums_
    left = d[1] * n1 + d[2] * n2 + d[3] * n3
    return np.where(total > 0, (c - d[np.minimum(c, 3)] + left * lower) / np.maximum(total, 1), lower)


def score(docs: DataFrame, model: dict, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry and (n_tokens, n_known, train_tokens, base_score, score, perplexity) of each row."""
    head = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, lm = Tokens(), Model(model)
        for batch in pieces(batches, BLOCK_TOKENS // 2):
            if not len(batch):
                continue
            h, ends = tokens(batch["text"].tolist())
            n, logs = lm.score(h, ends)
            begin = np.concatenate([[0], ends[:-1]])
            out = batch[list(carry)].copy()
            out["n_tokens"] = ends - begin
            out["n_known"] = np.add.reduceat((n > 0).astype(np.int64), begin)
            out["train_tokens"] = model["n"]
            out["base_score"] = np.add.reduceat(np.log10((n + 0.5) / (model["n"] + 0.5 * (model["v"] + 1))), begin)
            out["score"] = np.add.reduceat(logs, begin)
            out["perplexity"] = 10 ** np.minimum(-out["score"] / out["n_tokens"], 300)
            yield out
        trim()

    return docs.select(*carry, "text").mapInPandas(run, f"{head}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def held_out(folds: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 1


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(5).alias("held_out"))
    model = train(docs.where("not held_out"))
    return score(docs, model, ("doc_id", "held_out"))
