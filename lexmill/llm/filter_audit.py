"""Operator 13: how five filters interact, in every order, by scanning Arrow buffers.

Texts stay in their Arrow buffers: a table of 256 entries classes every byte, and prefix sums over the batch give each
text's words (bytes that begin one), capitals, symbols and code points. A word's hash is the difference of two prefix
sums of byte times power of an odd number, divided by that power (all modulo 2 ** 64). Each text's word hashes are
sorted; neighbours of equal hash are verified byte by byte, so distinct words are exact (a text in which two words
share a hash is counted by the words themselves). Filters that look at one text become bits of a mask; the filter of
repeated texts adds its bit by a join on (text digest, smallest doc_id), a key that no two texts' rows share, so a text
of very many copies meets no task. Rows of a part are reduced to counts by mask, and the 120 orders by 5 steps are
sums over masks.

Null text is empty; a null language is the part "". A null doc_id is no smaller id, and its rows repeat nothing. Equal
ids with equal texts don't repeat one another. Labels of one document are joined by the greater value. A batch is
scanned in pieces of about PIECE bytes, a longer text in pieces cut at white space. Equal texts are told by SHA-256. An
empty table has no parts, so it gives no rows. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import materialize, table

FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
BLANKS = b" \t\n\x0b\f\r"
#: Bytes that are scanned at a time.
PIECE = 1 << 21
#: An odd number, so that its powers can be divided by modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
BLANK, CAPITAL, SYMBOL, INNER = 1, 2, 4, 8

CLASSES = np.zeros(256, dtype=np.uint8)
CLASSES[list(BLANKS)] = BLANK
CLASSES[65:91] = CAPITAL
CLASSES[list(SYMBOLS)] = SYMBOL
CLASSES[128:192] = INNER  # continues a code point


def powers(of: int, n: int) -> np.ndarray:
    out = np.full(n, of, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Scanner:
    """Counts of texts that lie one after another in a buffer."""

    def __init__(self, base: int = BASE):
        self.base = base
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def word_hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.up) < len(data):
            self.up, self.down = powers(self.base, len(data)), powers(pow(self.base, -1, 1 << 64), len(data))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        return (sums[end] - sums[start]) * self.down[start]

    def scan(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """For the texts between bounds: (words, distinct, capitals, symbols, code points) by text; and the (text, start, end) of each distinct word."""
        n = len(bounds) - 1
        kinds = CLASSES[data]

        def counted(hit: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(data) + 1, dtype=np.int64)
            np.cumsum(hit, out=sums[1:])
            return sums[bounds[1:]] - sums[bounds[:-1]]

        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[bounds] = True  # a text's first byte follows nothing
        word = kinds != BLANK
        start = np.flatnonzero(word & (cut[:-1] | np.concatenate([[True], ~word[:-1]])[: len(data)]))
        end = np.flatnonzero(word & (cut[1:] | np.concatenate([~word[1:], [True]])[: len(data)])) + 1
        text = np.searchsorted(bounds, start, side="right") - 1
        key = self.word_hashes(data, start, end)
        order = np.lexsort((key, text))
        start, end, text, key = start[order], end[order], text[order], key[order]
        again = np.zeros(len(start), dtype=bool)
        again[1:] = (text[1:] == text[:-1]) & (key[1:] == key[:-1])
        at = np.flatnonzero(again)
        length = end[at] - start[at]
        true = length == end[at - 1] - start[at - 1]
        place = np.repeat(np.cumsum(length) - length, length)
        step = np.arange(len(place)) - place
        one = np.repeat(start[at], length) + step
        other = np.minimum(np.repeat(start[at - 1], length) + step, len(data) - 1)
        unlike = np.zeros(len(at), dtype=bool)
        unlike[np.repeat(np.arange(len(at)), length)[data[one] != data[other]]] = True
        clash = np.unique(text[at[unlike | ~true]])  # texts with two words of one hash
        words = np.bincount(text, minlength=n)
        distinct = np.bincount(text[~again], minlength=n)
        first = [text[~again], start[~again], end[~again]]
        for k in clash:
            own, raw = np.flatnonzero(text == k), data.tobytes()
            seen = {raw[a:b]: (a, b) for a, b in zip(start[own], end[own], strict=True)}
            distinct[k] = len(seen)
            keep = first[0] != k
            first = [np.concatenate([x[keep], y]) for x, y in zip(first, (np.full(len(seen), k), *np.array(list(seen.values())).T), strict=True)]
        codes = np.diff(bounds) - counted(kinds == INNER)
        return np.stack([words, distinct, counted(kinds == CAPITAL), counted(kinds == SYMBOL), codes]), first

    def long_text(self, data: np.ndarray, piece: int) -> np.ndarray:
        """The counts of one text that is scanned in pieces."""
        total, seen, at = np.zeros(5, dtype=np.int64), set(), 0
        while at < len(data):
            end = min(len(data), at + piece)
            while end < len(data):  # a word is never cut
                blank = np.flatnonzero(CLASSES[data[end : end + 4096]] == BLANK)
                end = min(len(data), end + (int(blank[0]) if len(blank) else 4096))
                if len(blank):
                    break
            own = data[at:end]
            counts, (_, a, b) = self.scan(own, np.array([0, len(own)]))
            raw = own.tobytes()
            seen.update(raw[x:y] for x, y in zip(a, b, strict=True))
            total += counts[:, 0]
            at = end
        total[1] = len(seen)
        return total

    def counts(self, texts: pa.Array, piece: int = PIECE) -> np.ndarray:
        """(words, distinct, capitals, symbols, code points) by text of a string array; null is empty."""
        wide = texts.cast(pa.large_string()).fill_null("")
        if not len(wide):
            return np.zeros((5, 0), dtype=np.int64)
        _, places, values = wide.buffers()
        bounds = np.frombuffer(places, dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
        data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, dtype=np.uint8)
        out, at = np.zeros((5, len(wide)), dtype=np.int64), 0
        while at < len(wide):
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + piece, side="right")) - 1)
            own = data[bounds[at] : bounds[end]]
            if len(own) > piece:
                out[:, at] = self.long_text(own, piece)
            else:
                out[:, at:end] = self.scan(own, bounds[at : end + 1] - bounds[at])[0]
            at = end
        return out


def failed(counts: np.ndarray) -> np.ndarray:
    """The bits of the filters A to D that a text fails."""
    words, distinct, capitals, symbols, codes = counts
    fails = (words < 100, 100 * distinct < 80 * words, 100 * capitals > 10 * codes, symbols > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def scanned(docs: DataFrame, key: str = "doc_id", part: str = "lang") -> DataFrame:
    """(id, part, digest, mask) of each row: the filters A to D on its whole text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            mask = pa.array(failed(scanner.counts(batch.column("text"))), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], mask], names=["id", "part", "digest", "mask"])

    return rows.mapInArrow(run, f"id {docs.schema[key].dataType.simpleString()}, part string, digest binary, mask int")


def masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): the rows of each part by the filters they fail, and how many of them are labelled so."""
    rows = materialize(scanned(docs, key, part))
    # the first holder of each text; equal rows of it are all first
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(1))
    told = labels.groupBy(F.col(key).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    alone = F.col("id").isNull() | F.col("first").isNotNull()
    mask = F.col("mask") + F.when(alone, 0).otherwise(1 << FILTERS.index("E"))
    every = rows.join(first, ["digest", "id"], "left").withColumn("mask", mask)
    # rows without an id have no label and stay where they are
    every = every.where("id is not null").join(told, "id", "left").unionByName(every.where("id is null"), allowMissingColumns=True)
    one = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c)
    return every.groupBy("part", "mask").agg(F.count("*").alias("n"), one("good"), one("toxic"))


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def reduced(own: pd.DataFrame) -> pd.DataFrame:
    """All orders and steps of one part from its counts by mask (at most 32 rows)."""
    n, good, toxic = (np.zeros(1 << len(FILTERS), dtype=np.int64) for _ in range(3))
    for into, c in ((n, "n"), (good, "good"), (toxic, "toxic")):
        into[own["mask"].to_numpy()] = own[c].to_numpy()
    every = np.arange(len(n))
    rows, shares = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            hit, gone = (every & bit) > 0, (every & before) > 0
            here, before = hit & ~gone, before | bit
            kept = n[(every & before) == 0].sum()
            rows.append((own["part"].iloc[0], "".join(order), step, kept, n[here].sum(), n[hit & gone].sum(), n[bit], good[here].sum(), toxic[here].sum(), f))
            shares[f] += n[here].sum()
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])
    out["shapley"] = out["shapley"].map(shares)
    return out


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step."""
    return masks(docs, labels, key, part).groupBy("part").applyInPandas(reduced, RESULT)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
b AS (SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
    len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'),
    coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)] AS f FROM d LEFT JOIN l USING (doc_id)),
m AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM b GROUP BY part, f),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || c FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE length(filter_order) < 5 AND NOT contains(filter_order, c)),
s AS (SELECT filter_order, step, filter_order[step] AS letter, 1 + ascii(filter_order[step]) - ascii('A') AS k,
  list_transform(string_split(left(filter_order, step - 1), ''), lambda c: 1 + ascii(c) - ascii('A')) AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE length(filter_order) = 5),
x AS (SELECT part, filter_order, step, letter, n, good, toxic, f[k] AS fails, len(list_filter(f, lambda v: v)) AS fail_count, coalesce(list_bool_or(list_transform(earlier, lambda j: coalesce(f[j], false))), false) AS gone FROM m, s),
r AS (SELECT part, filter_order, step, letter, CAST(sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fails AND fail_count = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM x GROUP BY ALL)
SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r
"""
