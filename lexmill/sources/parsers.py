"""Parsers by name: rows of raw text to the decision schema or to articles.

A parser takes rows (id, file_name, text) and gives rows of its own schema. Others, such as PDF parsers, are
registered by their users; what they need is theirs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import bench, text, vocab
from lexmill.operators import articles

PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def parser(name: str):
    def add(f):
        PARSERS[name] = f
        return f

    return add


def parse(rows: DataFrame, name: str) -> DataFrame:
    if name not in PARSERS:
        raise KeyError(f"no parser {name!r}; there are {sorted(PARSERS)}")
    return PARSERS[name](rows)


def head(rows: DataFrame) -> DataFrame:
    """(id, file_name, text, language, date); null text is empty."""
    body = F.coalesce("text", F.lit(""))
    return rows.select("id", "file_name", body.alias("text"), text.document_language(body).alias("language"), text.date_of(body).alias("date"))


def metadata(lower_court):
    cited = F.struct(text.case_citations("text").alias("cases"), text.legal_citations("text", vocab.CODES).alias("laws"))
    return F.struct(bench.judges(F.col("text")).alias("judges"), cited.alias("citations"), lower_court.alias("lower_court")).alias("metadata")


@parser("decision")
def decision(rows: DataFrame) -> DataFrame:
    """D1 from plain text: language, date, outcome, courts, citations and sections. Null text parses as empty."""
    year = F.substring("date", 1, 4).try_cast("int").alias("year")
    return head(rows).select("id", "file_name", "date", year, "language", text.court("file_name").alias("court"), text.outcome("text").alias("outcome"), metadata(text.lower_court("text")), text.sections("text", "language").alias("content"))


@parser("cantonal decision")
def cantonal(rows: DataFrame) -> DataFrame:
    """As decision(), by the headers, courts and phrases of cantonal judgments; their language is Italian."""
    year = F.substring("date", 1, 4).try_cast("int").alias("year")
    rows = head(rows).withColumn("_s", text.cantonal_sections("text"))
    part = lambda c, name: F.nullif(text.join_lines(c), F.lit("")).alias(name)
    content = F.struct(part(text.regeste("text"), "regeste"), *(part(F.col(f"_s.{k}"), k) for k in ("facts", "reasoning", "decision")))
    lower = F.coalesce(text.lower_court("text"), text.cantonal_lower_court("text"))
    return rows.select("id", "file_name", "date", year, F.lit("it").alias("language"), text.cantonal_court("file_name").alias("court"), text.outcome("text").alias("outcome"), metadata(lower), content.alias("content"))


@parser("law")
def law(rows: DataFrame) -> DataFrame:
    """Articles of a law's text; id is its number. Page headers `n / m` go first."""
    clean = rows.select("id", F.regexp_replace(F.coalesce("text", F.lit("")), r"(?m)^\s*\d+\s*/\s*\d+\s*$\n?", "").alias("text"))
    return articles.articles(clean, "id", "text")


def attempted(rows: DataFrame, least: int = 1) -> DataFrame:
    """M5: rows with a status: error for no text, skipped under `least` characters, else success."""
    n = F.length(F.trim("text"))
    return rows.withColumn("status", F.when(F.coalesce(n, F.lit(0)) == 0, "error").when(n < least, "skipped").otherwise("success"))
