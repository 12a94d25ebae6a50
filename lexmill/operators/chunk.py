"""Chunkers as table functions (C1-C7). Packing has a running sum with reset, so it folds over an array."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import strip


def n_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))


def pack(paragraphs: Column, most: int, least: int, glue: str = "\n\n") -> Column:
    """Greedy packing of paragraphs into chunks of at most `most` words; a last chunk under `least` joins its predecessor.

    A single paragraph that is too long stays whole. Only places are folded; texts are joined once.
    """
    start = F.struct(F.array(F.lit(1)).alias("starts"), F.lit(0).alias("n"), F.lit(1).alias("i"))

    def add(a, k):
        flush = (a["n"] + k > most) & (a["i"] > F.element_at(a["starts"], -1))
        return F.struct(F.when(flush, F.concat(a["starts"], F.array(a["i"]))).otherwise(a["starts"]).alias("starts"), F.when(flush, k).otherwise(a["n"] + k).alias("n"), (a["i"] + 1).alias("i"))

    def end(a):
        merge = (a["n"] < least) & (F.size(a["starts"]) > 1)
        return F.when(merge, F.slice(a["starts"], 1, F.greatest(F.size(a["starts"]) - 1, F.lit(1)))).otherwise(a["starts"])

    def join(parts):
        bounds = F.transform(F.array(F.aggregate(F.transform(parts, lambda p: n_words(p)), start, add, end)), lambda s: F.zip_with(s, F.concat(F.slice(s, 2, F.size(s)), F.array(F.size(parts) + 1)), lambda x, y: F.struct(x.alias("a"), y.alias("b"))))
        return F.transform(F.element_at(bounds, 1), lambda x: F.array_join(F.slice(parts, x["a"], x["b"] - x["a"]), glue))

    # the paragraphs are bound once, so their split is not repeated for each use
    joined = F.element_at(F.transform(F.array(paragraphs), lambda p: join(p)), 1)
    return F.when(F.size(paragraphs) > 0, joined).otherwise(F.expr("cast(array() as array<string>)"))


def whole_or(c: Column, most: int, packed: Column) -> Column:
    return F.when(n_words(c) <= most, F.array(c)).otherwise(packed)


def chunk_long_text(c: Column, most: int = 1000, least: int = 200) -> Column:
    """C1."""
    return whole_or(c, most, pack(F.split(c, r"\n\n+"), most, least))


def split_text(c: Column, most: int = 1000, least: int = 200) -> Column:
    """Also at numbered lines; paragraphs are trimmed, empty ones dropped."""
    parts = F.filter(F.transform(F.split(c, r"\n\n+|\n(?=\d+\.?\s)"), lambda x: strip(x)), lambda x: x != "")
    return whole_or(c, most, pack(parts, most, least))


def chunk_sections(df: DataFrame, key: str, sections: list[str], most: int = 1000, least: int = 200) -> DataFrame:
    """(key, chunk_id, chunk_type, chunk_index, text); the index runs across sections."""
    one = lambda s: F.transform(F.when(F.coalesce(strip(s), F.lit("")) != "", split_text(F.col(s), most, least)).otherwise(F.expr("cast(array() as array<string>)")), lambda t: F.struct(F.lit(s).alias("chunk_type"), t.alias("text")))
    rows = df.select(key, F.posexplode(F.concat(*map(one, sections))).alias("chunk_index", "x"))
    return rows.select(key, F.concat(F.col(key).cast("string"), F.lit("_chunk_"), F.col("chunk_index")).alias("chunk_id"), "x.chunk_type", "chunk_index", "x.text")


def chunk_dossier(c: Column, most: int = 500) -> Column:
    """C4: no merging; windows of `most` words if there is no paragraph."""
    parts = F.filter(F.transform(F.split(c, "\n\n"), lambda x: strip(x)), lambda x: x != "")
    words = F.filter(F.split(c, r"\s+"), lambda x: x != "")
    windows = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(words) - 1) / most).cast("int"))), lambda k: F.array_join(F.slice(words, k * most + 1, most), " "))
    return F.when(F.size(parts) > 0, pack(parts, most, 0)).otherwise(F.filter(windows, lambda x: x != ""))


def windows(c: Column, most: int, overlap: int, seps: list[str], least_share: float) -> Column:
    """Character windows that end after the last separator past a share of the window; the next begins `overlap` before.

    array<struct<start,end>>, 0-based; none of a null text. Places are found in the text itself, without cutting windows out.
    """

    def bounds(text: str) -> list[dict]:
        out, begin, n = [], 0, len(text)
        while n:
            hard = min(begin + most, n)
            ends = (at + len(s) for s in seps if (at := text.rfind(s, begin, hard)) >= 0)
            stop = n if hard >= n else next((e for e in ends if e - begin > most * least_share), hard)
            out.append({"start": begin, "end": stop})
            if stop >= n:
                break
            begin = max(stop - overlap, begin + 1)
        return out

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(bounds, na_action="ignore")

    return run(c)


def cut(c: Column, bounds: Column) -> Column:
    return F.transform(bounds, lambda b: F.substring(c, b["start"] + 1, b["end"] - b["start"]))


def chunk_chars(c: Column, most: int = 1500, overlap: int = 200) -> Column:
    """Bounds; ends at sentences, paragraphs, lines or blanks past the half. Stops at the end of the text."""
    return windows(c, most, overlap, [". ", ".\n", "\n\n", "\n", " "], 0.5)


def chunk_for_extraction(c: Column, most: int = 4000, overlap: int = 200) -> Column:
    """Bounds; ends at a blank line in the last 500 characters. Clamped to the text."""
    return windows(c, most, overlap, ["\n\n"], 1 - 500 / most)
