"""Operator 3: token counts by offset-mapped attribution.

A document is encoded once, as a whole. The tokens' byte lengths give their offsets, which are
interval-joined (by binary search within the document) to sections given as code point spans. A token
that crosses a section's boundary is allotted by a rule:

start     to the section that holds its first byte (so counts of adjoining sections add up to the whole)
end       to the section that holds its last byte
majority  to the section that holds most of its bytes, the earlier of equal ones
split     to every section by its share of the token's bytes (fractions)

By default the sections are the document's lines, each with its line feed. Null and empty texts have
one empty section without tokens. Repeated rows give repeated results; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.bpe import VOCABULARY, Codec
from lexmill.llm.common import table

RULES = ("start", "end", "majority", "split")


def lines(raw: np.ndarray) -> np.ndarray:
    """Byte places where lines begin, and the end."""
    cut = np.flatnonzero(raw == 10) + 1
    return np.unique(np.concatenate([[0], cut, [len(raw)]])) if len(raw) else np.array([0, 0])


def attribute(begin: np.ndarray, end: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each adjoining section; sections: its bounds, ascending; tokens: [begin, end)."""
    n = len(sections) - 1
    first = np.searchsorted(sections, begin, side="right") - 1
    last = np.searchsorted(sections, end - 1, side="right") - 1
    first, last = np.clip(first, 0, n - 1), np.clip(last, 0, n - 1)
    crossing = np.zeros(n)
    counts = np.zeros(n)
    odd = np.flatnonzero(first != last)
    even = first == last
    counts += np.bincount(first[even], minlength=n)
    for k in odd.tolist():
        own = np.arange(first[k], last[k] + 1)
        share = np.minimum(sections[own + 1], end[k]) - np.maximum(sections[own], begin[k])
        crossing[own] += 1
        if rule == "split":
            counts[own] += share / share.sum()
        else:
            counts[{"start": own[0], "end": own[-1], "majority": own[share.argmax()]}[rule]] += 1
    return counts, crossing


def count(docs: DataFrame, rule: str = "start", sections: str | None = None, vocabulary: str = VOCABULARY, key: str = "doc_id") -> DataFrame:
    """(key, section, start, end, n_tokens, n_crossing) of each section; start and end in code points.

    sections: an array<long> column with the ascending inner bounds of sections in code points; default: lines.
    """
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is none of {RULES}")
    kind = docs.schema[key].dataType.simpleString()
    number = "double" if rule == "split" else "long"
    chosen = F.col(sections).alias("_bounds") if sections else F.lit(None).cast("array<long>").alias("_bounds")
    names = [key, "section", "start", "end", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(vocabulary)
        for batch in batches:
            for at in range(0, len(batch), 500):
                rows: list[list] = [[] for _ in names]
                part = batch.iloc[at : at + 500]
                for doc, text, bounds in zip(part[key], part["_text"], part["_bounds"], strict=True):
                    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
                    chars = np.flatnonzero((raw & 0xC0) != 0x80)  # where each code point begins
                    if bounds is None:
                        cut = lines(raw)
                    else:
                        inner = [int(b) for b in bounds if 0 < b < len(chars)]
                        cut = np.unique(np.concatenate([[0], chars[inner], [len(raw)]])) if len(raw) else np.array([0, 0])
                    end = np.cumsum(codec.lengths[np.frombuffer(codec.encode(text), dtype="<u4")])
                    begin = np.concatenate([[0], end[:-1]]) if len(end) else end
                    got, crossing = attribute(begin, end, cut, rule)
                    place = np.searchsorted(chars, cut)
                    for out, values in zip(rows, ([doc] * len(got), range(len(got)), place[:-1], place[1:], got, crossing), strict=True):
                        out.extend(values)
                out = pd.DataFrame(dict(zip(names, rows, strict=True)))
                yield out if number == "double" else out.astype({"n_tokens": "int64", "n_crossing": "int64"})

    texts = docs.select(key, F.coalesce("text", F.lit("")).alias("_text"), chosen)
    return texts.mapInPandas(run, f"`{key}` {kind}, section long, start long, end long, n_tokens {number}, n_crossing long" if number == "long" else f"`{key}` {kind}, section long, start long, end long, n_tokens double, n_crossing double")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(table(spark, sf_dir, "documents"))
