"""Statutes' text to articles with their hierarchy (C6, W7-W9), by one pass over each text's lines.

A text is one row, so its lines are folded where it lies and none is exchanged: the fold keeps the headings above the
line and the article that is open. A heading voids those below its level; an article ends where the next begins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import strip
from lexmill.operators.encode import slices

# fixed values: headings by language (German, French, Italian)
PART = r"^(?:(\d+)\.\s*Teil|Partie\s+(\d+)|Parte\s+(\d+))[:\s]+(.+)$"
TITLE = r"^(?:(\d+)\.\s*Titel|Titre\s+(\d+)[eè]?|Titolo\s+(\d+)[oº]?)[:\s]+(.+)$"
CHAPTER = r"^(?:(\d+)\.\s*Kapitel|Chapitre\s+(\d+)[eè]?|Capitolo\s+(\d+)[oº]?)[:\s]+(.+)$"
SECTION = r"^(?:(?:(\d+)\.\s*)?Abschnitt|Section\s+(\d+)?|Sezione\s+(\d+)?)[:\s]+(.+)$"
ARTICLE = re.compile(r"^Art\.\s*(\d+[a-z]?(?:bis|ter|quater|quinquies)?)(?:\s+(.+))?$", re.ASCII)
LEVELS = [("part", PART, "Teil"), ("title", TITLE, "Titel"), ("chapter", CHAPTER, "Kapitel"), ("section", SECTION, "Abschnitt")]
RULES = [re.compile(p, re.IGNORECASE) for _, p, _ in LEVELS]
NUMBERED = re.compile("^[0-9¹²³]+")
#: White space that strip() takes off.
BLANKS = " \t\n\x0b\f\r"
ARTICLES = "article_number string, article_title string, part string, title string, chapter string, section string, start_line int, end_line int, article_text string"


def heading(line: str) -> tuple[int, str] | None:
    """(level, what is shown of it) of a heading."""
    for level, rule in enumerate(RULES):
        if m := rule.match(line):
            number, word = next((x for x in m.groups()[:3] if x), None), LEVELS[level][2]
            if level < 3:
                return level, None if number is None else f"{number}. {word}: {m[4]}"
            return level, f"{word}: {m[4]}" if number is None else f"{word} {number}: {m[4]}"
    return None


def folded(text: str) -> Iterator[tuple]:
    """The articles of a text, in order."""
    lines = [x.strip(BLANKS) for x in text.split("\n")]
    above: list[str | None] = [None] * len(LEVELS)
    head, first = None, 0

    def article(end: int) -> tuple:
        number, title, own, levels, start = head
        return (number, title, *levels, start, end, "\n".join(lines[first:end]).strip("\n").strip(BLANKS))

    for at, line in enumerate(lines):
        if (found := heading(line)) and found[1] is not None:
            above = [*above[: found[0]], found[1], *[None] * (len(LEVELS) - found[0] - 1)]
        if m := ARTICLE.match(line):
            if head:
                yield article(at)
            ahead = lines[at + 1] if at + 1 < len(lines) else ""
            below = ahead if ahead and not m[2] and not NUMBERED.match(ahead) and not ahead.startswith("Art.") else None
            head, first = (m[1], m[2] or below, below is not None, list(above), at), at + 1 + (below is not None)
    if head:
        yield article(len(lines))


def articles(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, article_number, article_title, part, title, chapter, section, start_line, end_line, article_text); null texts have none.

    Only texts with a line that begins like an article leave the JVM. A worker holds the articles of some texts at a
    time, not those of an Arrow batch.
    """
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, {ARTICLES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32() if c.endswith(" int") else pa.string() for c in ARTICLES.split(", ")]
        for batch in batches:
            keys, texts = batch.columns
            for start, end in slices(pc.utf8_length(texts).to_pylist()):
                rows = [(i, *a) for i in range(start, end) for a in folded(texts[i].as_py())]
                if rows:
                    at, *columns = zip(*rows, strict=True)
                    made = [keys.take(pa.array(at)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
                    yield pa.RecordBatch.from_arrays(made, [key, *(c.split(" ")[0] for c in ARTICLES.split(", "))])

    return df.where(F.col(text).rlike(r"(?m)^\s*Art\.")).select(key, F.col(text).alias("_text")).mapInArrow(run, schema)


def paragraphs(c: Column, most: int = 500) -> Column:
    """The article's parts if it is over `most` words: numbered ones, else lettered ones, else those between blank lines."""
    from lexmill.operators.chunk import n_words, pack

    clean = lambda x: F.filter(F.transform(x, lambda x: strip(x)), lambda t: t != "")
    numbered, lettered = clean(F.split(c, r"\n(?=\d+\s)")), clean(F.split(c, r"\n(?=[a-z]\.\s)"))
    blank, sentences = clean(F.split(c, r"\n\n+")), clean(F.split(c, r"(?<=[.!?])\s+"))
    return F.when(n_words(c) <= most, F.array(c)).when(F.size(numbered) > 1, numbered).when(F.size(lettered) > 1, lettered).when(F.size(blank) > 1, blank).otherwise(pack(sentences, most, 0, " "))
