"""Operator 2: language identification by prediction by partial matching.

For each language, bytes are counted after contexts of 0 to ORDER bytes. A byte's code length comes
from the longest context known in that language; a byte new there pays the escape (method C: as many
as there are distinct followers) and is coded one byte shorter. Counts are frozen after training, so
the longest kept suffix of what was read is a state of an automaton, with a code length for each next
byte and language; texts are read in lock step, cut into pieces that begin ORDER bytes early to settle.

Training reads about SAMPLE_DOCS labelled rows of each language, chosen by hash, and of each a piece of
SAMPLE_BYTES from anywhere in its text; each language keeps its CONTEXTS most frequent contexts. Every
label that occurs is a language. Languages are scored in blocks of BLOCK, whose tables a worker holds
one block at a time, so memory does not grow with their number. Predictions read whole texts. The
language with the shortest code wins (ties: the alphabetically first); the score is its posterior
under equal priors.

Null text, text without a letter and a corpus without labels give `und` and score 0. Rows are
predicted each on its own; rows of equal doc_id and text are one training row; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import table

ORDER = 4
SAMPLE_DOCS = 400
SAMPLE_BYTES = 4096
#: Contexts of each language; a worker's tables take BLOCK * CONTEXTS * 256 * (BLOCK + 1) * 4 bytes at most.
CONTEXTS = 4096
BLOCK = 4
PIECE = 512
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def low(k: int) -> int:
    """A mask of k bytes."""
    return (1 << 8 * k) - 1


def followers(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context of k bytes, next byte, how often), sorted."""
    grams = [np.zeros(0, dtype=np.int64)]
    for text in texts:
        raw = np.frombuffer(text, dtype=np.uint8).astype(np.int64)
        if len(raw) <= k:
            continue
        gram = np.zeros(len(raw) - k, dtype=np.int64)
        for j in range(k + 1):
            gram = (gram << 8) | raw[j : len(raw) - k + j]
        grams.append(gram)
    keys, n = np.unique(np.concatenate(grams), return_counts=True)
    return keys >> 8, keys & 255, n


Counts = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def frequent(texts: list[bytes], order: int = ORDER, contexts: int = CONTEXTS) -> Counts:
    """For each length k, (context of k bytes, next byte, how often) of one language's most frequent contexts."""
    counts = [followers(texts, k) for k in range(order + 1)]
    size, depth, key = [], [], []
    for k, (context, _, n) in enumerate(counts):
        keys, back = np.unique(context, return_inverse=True)
        size.append(np.bincount(back, n, len(keys)))
        depth.append(np.full(len(keys), k))
        key.append(keys)
    size, depth, key = (np.concatenate(x) for x in (size, depth, key))
    kept = np.lexsort((key, depth, -size))[: max(1, contexts)]
    return [tuple(x[np.isin(c[0], key[kept[depth[kept] == k]])] for x in c) for k, c in enumerate(counts)]


class ContextTrees:
    """Code lengths, in bits, of every byte after every context that any of the languages keeps."""

    def __init__(self, models: dict[str, Counts], order: int = ORDER):
        self.langs, self.order = sorted(models), order
        # a context of k bytes is an int of k bytes
        counts = [models[lang] for lang in self.langs]
        nodes = [np.unique(np.concatenate([np.zeros(int(k == 0), np.int64), *(c[k][0] for c in counts)])) for k in range(order + 1)]
        for k in range(order, 0, -1):  # a kept context's suffixes are states, too
            nodes[k - 1] = np.unique(np.concatenate([nodes[k - 1], nodes[k] & low(k - 1)]))
        first = np.cumsum([0, *(len(x) for x in nodes)])
        self.bits = np.full((first[-1], 256, len(self.langs)), 8.0, dtype=np.float32)
        self.next = np.zeros((first[-1], 256), dtype=np.int32)
        for k, own in enumerate(nodes):
            rows = slice(first[k], first[k + 1])
            if k:
                self.bits[rows] = self.bits[first[k - 1] + np.searchsorted(nodes[k - 1], own & low(k - 1))]
            for lang in range(len(self.langs)):
                context, byte, n = counts[lang][k]
                at = np.searchsorted(own, context)
                there = np.flatnonzero((at < len(own)) & (own[np.minimum(at, len(own) - 1)] == context) if len(own) else np.zeros(len(at), bool))
                at, byte, n = at[there], byte[there], n[there]
                total, distinct = np.bincount(at, n, len(own)), np.bincount(at, minlength=len(own))
                seen = distinct > 0
                escape = np.zeros(len(own))
                escape[seen] = -np.log2(distinct[seen] / (total + distinct)[seen])
                self.bits[rows, :, lang] += escape[:, None]
                self.bits[first[k] + at, byte, lang] = -np.log2(n / (total + distinct)[at])
            new = (own[:, None] << 8) | np.arange(256)
            for j in range(min(k + 1, order) + 1):  # the longest kept suffix comes last
                if len(nodes[j]):
                    want = new & low(j)
                    at = np.minimum(np.searchsorted(nodes[j], want), len(nodes[j]) - 1)
                    self.next[rows] = np.where(nodes[j][at] == want, first[j] + at, self.next[rows])

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (row) in each language; a text's first byte has the empty context."""
        out = np.zeros((len(texts), len(self.langs)))
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(texts)), pieces)
        start = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
        flat = np.frombuffer(b"".join(texts) + b"\0", dtype=np.uint8)
        base = np.cumsum(sizes) - sizes
        size = np.minimum(PIECE, sizes[owner] - start)
        for at in range(0, len(owner), 1 << 14):
            part = slice(at, at + (1 << 14))
            own, begin, n = owner[part], start[part], size[part]
            order = np.argsort(-n, kind="stable")  # so that the pieces still read are always the first ones
            own, begin, n = own[order], begin[order], n[order]
            state = np.zeros(len(own), dtype=np.int32)
            sums = np.zeros((len(own), len(self.langs)))
            place = base[own] + begin
            for k in range(-self.order, 0):
                ready = begin + k >= 0
                state = np.where(ready, self.next[state, flat[np.where(ready, place + k, 0)]], state)
            left = np.searchsorted(-n, -np.arange(PIECE), side="left")  # pieces longer than k
            for k in range(PIECE):
                m = left[k]
                if not m:
                    break
                s, byte = state[:m], flat[place[:m] + k]
                sums[:m] += self.bits[s, byte]
                state[:m] = self.next[s, byte]
            np.add.at(out, own, sums)
        return out


def sampled(labelled: DataFrame) -> DataFrame:
    """(lang, piece) of the training sample: of each language the rows of the least hashes, at most SAMPLE_DOCS.

    Rows above a share of each language, by its number of rows, are left out before any are exchanged, so
    a frequent language brings no more rows to a task than a rare one. The shares, a row for each language, are
    broadcast: the driver holds each language's whole model anyway.
    """
    rows = labelled.where("text is not null and lang is not null and text != ''").select("lang", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11).alias("h"))
    rate = rows.groupBy("lang").agg((F.lit(2.0 * SAMPLE_DOCS + 64) / F.count("*")).alias("rate"))
    room = F.greatest(F.char_length("text") - SAMPLE_BYTES, F.lit(0)) + 1
    piece = F.substring("text", (F.pmod("h", room) + 1).cast("int"), F.lit(SAMPLE_BYTES))
    near = rows.join(F.broadcast(rate), "lang").where(F.col("h") < F.col("rate") * float(1 << 53))
    once = near.groupBy("lang", "h").agg(F.min(piece).alias("piece"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece"))
    return once.withColumn("n", place).where(F.col("n") <= SAMPLE_DOCS).select("lang", "piece")


def train(labelled: DataFrame) -> list[dict[str, Counts]]:
    """Models in blocks of languages, from (doc_id, text, lang) rows. Each language is counted in one task on its bounded sample."""

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        counts = frequent([t.encode("utf-8", "surrogatepass")[:SAMPLE_BYTES] for t in sorted(part["piece"])])
        blob = [[x.astype("<i8").tobytes() for x in c] for c in counts]
        return pd.DataFrame({"lang": part["lang"].iloc[:1], "counts": [blob]})

    fitted = sampled(labelled).groupBy("lang").applyInPandas(fit, "lang string, counts array<array<binary>>")
    # a language's counts are bounded by CONTEXTS * 256 entries
    models = {lang: [tuple(np.frombuffer(bytes(x), "<i8") for x in c) for c in counts] for lang, counts in fitted.collect()}
    langs = sorted(models)
    return [{lang: models[lang] for lang in langs[k : k + BLOCK]} for k in range(0, len(langs), BLOCK)]


class Scorer:
    """Code lengths in all languages; the tables of one block are held at a time."""

    def __init__(self, blocks: list[dict[str, Counts]]):
        self.blocks, self.held = blocks, (-1, None)
        self.langs = [lang for b in blocks for lang in sorted(b)]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        out = []
        for k, block in enumerate(self.blocks):
            if self.held[0] != k:
                self.held = (-1, None)
                self.held = (k, ContextTrees(block))
            out.append(self.held[1].code_lengths(texts))
        return np.concatenate(out, axis=1)


def predict(docs: DataFrame, model: list[dict[str, Counts]], carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry (other names than those that follow) and (lang_pred, score, bits_per_byte) of each row."""
    head = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = "text" if "text" in carry else "_text"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            # tables of one block stay; with more blocks each batch goes through all of them once
            step = 2000 if len(scorer.blocks) < 2 else max(1, len(batch))
            for at in range(0, len(batch), step):
                part = batch.iloc[at : at + step]
                texts = part[source].tolist()
                out = part[list(carry)].copy()
                known = np.array([bool(scorer.blocks) and t is not None and LETTER.search(t) is not None for t in texts], dtype=bool)
                pred, score, rate = np.full(len(part), UNKNOWN, dtype=object), np.zeros(len(part)), np.zeros(len(part))
                if known.any():
                    raw = [t.encode("utf-8", "surrogatepass") for t, k in zip(texts, known, strict=True) if k]
                    bits = scorer.code_lengths(raw)
                    best = bits.argmin(axis=1)
                    least = bits[np.arange(len(raw)), best]
                    pred[known] = np.array(scorer.langs, dtype=object)[best]
                    score[known] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                    rate[known] = least / np.array([len(t) for t in raw])
                out["lang_pred"], out["score"], out["bits_per_byte"] = pred, score, rate
                yield out

    return docs.select(*carry, *[F.col("text").alias("_text")] * ("text" not in carry)).mapInPandas(run, f"{head}, lang_pred string, score double, bits_per_byte double")


def held_out(folds: int = 3):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 1


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model, ("doc_id", "held_out"))
