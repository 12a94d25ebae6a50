"""Operator 12: quality rules by cross-document line frequency, with DataFrame functions only.

Lines are normalised (A-Z lower-cased, digits to 0, white space to one blank, trimmed) and hashed; for each host the
distinct documents of a line are counted, equal texts being one document. Lines of more than `limit` documents of
their host are removed from its texts. A document is rejected if it fails the base rules (too few words, or too many
words in repeated windows), or if it is depleted: fewer than MIN_WORDS words are left, or less than half of its words.

Lines are exploded as hashes, never as texts, and counted with map-side combines over (host, line, text), so neither
a frequent line nor a large host meets one task. Lines above the limit are broadcast up to BROADCAST_ROWS of them;
beyond, they are dealt with salts. Only the hits come back, row by row.

Null texts have no words and no lines (and fail the base rules); a null host is a host of its own. Repeated rows stay,
each with the same verdict. An empty table gives no rows. Other columns are dropped by measure() and kept by clean().
Texts and windows are compared by 64-bit hashes; counts are per row, whatever the length of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import lower_ascii, materialize, table

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: A line of more documents of a host than this is no content.
LIMIT = 20
MIN_WORDS = 10
#: Percent of words in repeated windows that a text may have, and that it must keep.
MOST_REPEATED, LEAST_LEFT = 20, 50
BROADCAST_ROWS = 500_000
SALTS = 32


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def lines_of(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def normal(line: Column) -> Column:
    """What equal lines have in common."""
    return F.trim(F.regexp_replace(F.translate(lower_ascii(line), "123456789", "000000000"), SPACE + "+", " "))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of words that the text holds twice or more."""

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        same = lambda s, x, i: (F.get(s, i)["h"] == x["h"])
        twice = let(ordered, lambda s: F.filter(s, lambda x, i: F.coalesce(same(s, x, i - 1), F.lit(False)) | F.coalesce(same(s, x, i + 1), F.lit(False))))
        starts = F.sort_array(F.transform(twice, lambda x: x["at"]))
        return let(starts, lambda p: F.aggregate(F.transform(p, lambda a, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - a, F.lit(window)))), F.lit(0), lambda a, b: a + b))

    def counted(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))
        some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
        return F.when(F.size(w) > window, some).otherwise(0)

    return let(words, counted).cast("long")


def without(text: Column, characters: str) -> Column:
    """The number of code points that are none of these characters."""
    return F.char_length(F.translate(text, characters, ""))


def measure(docs: DataFrame, key: str = "doc_id", host: str = "source") -> DataFrame:
    """(row, key, host, text_hash, counts and base verdict, lines array<struct<h,n>>) of each row, at rest."""
    text = F.coalesce("text", F.lit(""))
    lines = let(lines_of(F.col("_text")), lambda x: F.struct(
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.transform(x, lambda l: F.struct(F.xxhash64(normal(l)).alias("h"), F.size(words_of(l)).alias("n"))).alias("lines"),
    ))
    told = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("_key"), F.col(host).alias("_host"), text.alias("_text"))
    words = let(words_of(F.col("_text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    rows = told.select(
        "row", "_key", "_host", F.xxhash64("_text").alias("text_hash"), without(F.col("_text"), BLANKS).cast("long").alias("word_chars"),
        (F.char_length("_text") - without(F.col("_text"), SYMBOLS)).cast("long").alias("n_symbols"), words.alias("_w"), lines.alias("_l"),
    ).select("row", F.col("_key").alias(key), F.col("_host").alias("host"), "text_hash", "word_chars", "n_symbols", "_w.*", "_l.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return materialize(rows.withColumn("base_failed", failed))


def frequent_lines(measured: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(host, h) of the lines that more than limit distinct texts of the host hold."""
    own = measured.select("host", "text_hash", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    return own.distinct().groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("host", "h")


def removed_lines(measured: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(row, removed_words, removed array<int>) of the rows that hold a frequent line: its words and the lines' places."""
    frequent = materialize(frequent_lines(measured, limit)).withColumnsRenamed({"host": "_host", "h": "_h"})
    lines = measured.select("row", "host", F.posexplode("lines").alias("at", "line")).select("row", "host", "at", "line.h", "line.n")
    same = F.col("host").eqNullSafe(F.col("_host")) & (F.col("h") == F.col("_h"))
    if frequent.count() <= BROADCAST_ROWS:
        hits = lines.join(F.broadcast(frequent), same)
    else:
        salted = frequent.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = lines.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("salt") == F.col("_salt")))
    return hits.groupBy("row").agg(F.sum("n").alias("removed_words"), F.collect_list("at").alias("removed"))


def judged(measured: DataFrame, limit: int = LIMIT) -> DataFrame:
    """measured without lines, with removed places, words_left and kept."""
    found = measured.drop("lines", "host", "text_hash").join(removed_lines(measured, limit), "row", "left")
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    depleted = (left < MIN_WORDS) | (100 * left < LEAST_LEFT * F.col("n_words"))
    return found.withColumn("words_left", left).withColumn("kept", ~F.col("base_failed") & ~depleted).drop("removed_words")


def clean(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", host: str = "source") -> DataFrame:
    """The kept rows of docs with all their columns; text has lost its frequent lines (and, where any went, its lines without a word)."""
    names = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    rest = F.struct(*(F.col(f"`{c}`").alias(v) for c, v in names.items()))
    rows = materialize(docs.select(rest.alias("rest"), F.col(key).alias("own_key"), F.col(host).alias("own_host"), "text", F.monotonically_increasing_id().alias("own_row")))
    # measure() numbers rows itself; here the number stands in for the key, too
    found = judged(measure(rows.select("own_row", "own_host", "text"), "own_row", "own_host"), limit).where("kept").select("own_row", "removed")
    lines = lines_of(F.col("text"))
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
    left = let(lines, lambda x: F.array_join(F.transform(places, lambda i: x[i]), "\n"))
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(left)
    return rows.join(found, "own_row").select(*((text if c == "text" else F.col("rest")[v]).alias(c) for c, v in names.items()))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(measure(table(spark, sf_dir, "documents")))
    lines = F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed_lines")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", lines, "words_left")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) - 3)) AS pos, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i : i + 4])) AS x FROM d WHERE len(w) >= 5),
c AS (SELECT DISTINCT r, unnest(range(pos, pos + 5)) AS word FROM (SELECT r, pos, count(*) OVER (PARTITION BY r, x) AS n FROM p) WHERE n > 1),
rep AS (SELECT r, count(*) AS n FROM c GROUP BY r),
l AS (SELECT r, doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
l2 AS (SELECT r, source, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
  trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT source, norm FROM l2 GROUP BY 1, 2 HAVING count(DISTINCT text) > 20),
h AS (SELECT r, count(*) - count(DISTINCT line) AS dup, sum(CASE WHEN f.norm IS NULL THEN 0 ELSE n END) AS gone, count(f.norm) AS lines
  FROM l2 LEFT JOIN f ON l2.norm = f.norm AND l2.source IS NOT DISTINCT FROM f.source GROUP BY r),
a AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lines, 0) AS n_removed_lines, CAST(len(w) - coalesce(gone, 0) AS BIGINT) AS words_left
  FROM d LEFT JOIN h USING (r) LEFT JOIN rep USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND words_left >= 10 AND 2 * words_left >= n_words AS kept FROM a
"""
