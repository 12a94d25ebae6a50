"""Personal data: detection with places and scores, masking, summary."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import vocab

#: Entity types kept when dates are to stay; their recognisers are pluggable and off by default.
KEPT = {"DATE_TIME"}
SPAN = "array<struct<entity_type:string,start:int,end:int,score:double>>"
#: What a context word in the words before a match adds to its score, and how many words are looked at.
CONTEXT_GAIN, CONTEXT_WORDS = 0.35, 5
#: Characters that hold these words.
CONTEXT_REACH = 200
Own = tuple[tuple[str, str, float], ...]


def patterns(types: list[str] | None = None, more: Own = ()) -> list[tuple[str, str, float]]:
    """The recognisers (entity type, pattern, score) in use; more: the caller's own, such as an NER's lists."""
    return [p for p in (*vocab.PII, *more) if types is None or p[0] in types]


def plain(before: str) -> str:
    """The last CONTEXT_WORDS words, each between blanks."""
    return f" {' '.join(re.findall(r'\w+', before[-CONTEXT_REACH:].lower())[-CONTEXT_WORDS:])} "


class Finder:
    """Finds the spans of compiled recognisers in a text and settles overlaps."""

    def __init__(self, recognisers: list[tuple[str, str, float]], least: float):
        self.rules = [(t, re.compile(p, re.ASCII), s, [f" {w} " for w in vocab.PII_CONTEXT.get(t, [])]) for t, p, s in recognisers]
        self.least = least

    def candidates(self, text: str) -> list[tuple[float, int, int, str]]:
        """(score, start, end, entity type) of every match of at least the least score; a context word before it raises its score."""
        out = []
        for kind, rule, score, context in self.rules:
            for m in rule.finditer(text):
                own = score
                if context and own < 1:
                    before = plain(text[max(0, m.start() - CONTEXT_REACH) : m.start()])
                    own = min(1.0, round(own + CONTEXT_GAIN, 9)) if any(w in before for w in context) else own
                if own >= self.least and m.end() > m.start():
                    out.append((own, m.start(), m.end(), kind))
        return out

    def spans(self, text: str) -> list[tuple[str, int, int, float]]:
        """The kept spans by start: the best by score, then length, then start, then type is kept, unless it meets one that was."""
        starts, kept = [], []
        for score, a, b, kind in sorted(self.candidates(text), key=lambda x: (-x[0], x[1] - x[2], x[1], x[3])):
            at = bisect_left(starts, b)  # the last kept one that begins before this ends
            if not at or kept[at - 1][2] <= a:
                at = bisect_left(starts, a)
                starts.insert(at, a)
                kept.insert(at, (kind, a, b, score))
        return kept


def loose(pattern: str) -> str:
    """A pattern that matches wherever the pattern does, whatever its engine takes for a word's edge."""
    return pattern.replace(r"\b", "")


def found(c: Column, types: list[str] | None = None, least: float = 0.7, more: Own = ()) -> Column:
    """The kept spans of a text, by start, in code points (end exclusive). Null, blank and clean texts have none.

    Only texts that any pattern may match leave the JVM.
    """
    rules = patterns(types, more)

    @F.pandas_udf(SPAN)
    def run(texts: pd.Series) -> pd.Series:
        finder = Finder(rules, least)
        return pd.Series([None if t is None else [dict(zip(("entity_type", "start", "end", "score"), x, strict=True)) for x in finder.spans(t)] for t in texts], dtype=object)

    some = c.rlike("|".join(f"(?:{loose(p)})" for _, p, _ in rules)) if rules else F.lit(False)
    return F.coalesce(run(F.when(some, c)), F.expr(f"cast(array() as {SPAN})"))


def detect(df: DataFrame, key: str, text: str, types: list[str] | None = None, least: float = 0.7, more: Own = ()) -> DataFrame:
    """(key, entity_type, text, start, end, score) of each kept span."""
    rows = df.select(key, F.col(text).alias("_text"), F.explode(found(F.col(text), types, least, more)).alias("x"))
    return rows.select(key, "x.entity_type", F.expr("substring(_text, x.start + 1, x.end - x.start)").alias("text"), "x.start", "x.end", "x.score")


def masked(text: Column, spans: Column, form: str = "<{entity_type}>") -> Column:
    """Each of the spans (by start, without overlaps) replaced by the form."""
    head, tail = form.split("{entity_type}")
    end = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
    pieces = F.transform(spans, lambda x, i: F.concat(F.substring(text, end(i) + 1, x["start"] - end(i)), F.lit(head), x["entity_type"], F.lit(tail)))
    rest = F.substring(text, end(F.size(spans)) + 1, F.char_length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), rest))


def scrubbed(df: DataFrame, text: str, into: str, form: str = "<{entity_type}>", types: list[str] | None = None, least: float = 0.7, more: Own = ()) -> DataFrame:
    """Df with `into`, the text without personal data; dates stay (`KEPT`) unless types name them."""
    kinds = [t for t, _, _ in patterns(types, more) if types is not None or t not in KEPT]
    return df.withColumn("_spans", found(F.col(text), kinds, least, more)).withColumn(into, masked(F.col(text), F.col("_spans"), form)).drop("_spans")


def scrubbed_for_logging(df: DataFrame, text: str, into: str) -> DataFrame:
    """Dates are masked, too."""
    return scrubbed(df, text, into, "[REDACTED:{entity_type}]", sorted({t for t, _, _ in patterns()}))


def has_pii(c: Column, types: list[str] | None = None) -> Column:
    """Whether a text has a span (null texts have none)."""
    return F.size(found(c, types)) > 0


def summary(df: DataFrame, key: str, text: str, types: list[str] | None = None) -> DataFrame:
    """(entity_type, n) over all texts."""
    return df.select(F.explode(found(F.col(text), types)).alias("x")).groupBy("x.entity_type").agg(F.count("*").alias("n"))


def kinds(spans: Column, allowed: list[str] | None = None) -> Column:
    """The sorted entity types among spans, without the allowed ones."""
    types = F.array_distinct(F.transform(spans, lambda x: x["entity_type"]))
    return F.array_sort(F.array_except(types, F.array(*map(F.lit, allowed or [])).cast("array<string>")))
