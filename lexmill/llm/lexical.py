"""Operator 11: ranked lexical search by a threshold-seeded join.

A document's impact for a term is the term's weight times a saturated share of its occurrences; its score for an
item sums the impacts of the item's terms, repeats included. For every term the k greatest impacts are stored with
their documents. The kth of them times the term's count is a lower bound of the item's kth score; the stored
documents, scored exactly, seed a closer one. An item's terms are put in order of their greatest possible share;
those whose sum of bounds stays below the threshold can't lift a document to it alone and are pruned. The join of the
other terms with the postings generates candidates, of which those that the pruned terms' bounds can lift to the
threshold are scored exactly. No document of a score that belongs to the k best is left out, ties included.

Postings are kept for the terms that occur in items only, numbered by those; whole texts are read once. The items'
terms are broadcast up to BROADCAST_ROWS of them; above that postings are dealt by term and salt, so that no frequent
term meets one task.

Null texts, and texts without a term, are no documents (and no items). Each row is a document, so repeated rows are
ranked one by one; equal scores go by doc_id (null last). Equal item_ids with several rows are separate items. An
empty table gives no rows. Other columns are dropped; a text of any length is exploded word by word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import lower_ascii, materialize, table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 20
#: Rows of (item, term) that are broadcast; beyond, both sides of the join are exchanged.
BROADCAST_ROWS = 500_000
#: Parts of a term's postings in an exchanged join.
SALTS = 32


def terms(text):
    return F.regexp_extract_all(lower_ascii(text), F.lit(TERM), F.lit(0))


def item_terms(items: DataFrame, key: str = "item_id") -> DataFrame:
    """(q, key, term, c) of items: q numbers the rows, c counts the term."""
    rows = items.select(F.monotonically_increasing_id().alias("q"), F.col(key).alias("_key"), terms("text").alias("w"))
    return materialize(rows.select("q", "_key", F.explode("w").alias("term")).groupBy("q", "_key", "term").agg(F.count("*").alias("c")).withColumnRenamed("_key", key))


def bounded(rows: DataFrame) -> bool:
    """Whether rows (of a table at rest) are few enough to be broadcast."""
    return rows.count() <= BROADCAST_ROWS


def sized(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if they are few enough."""
    return F.broadcast(rows) if bounded(rows) else rows


def by_term(posts: DataFrame, asked: DataFrame, on: str = "t", how: str = "inner") -> DataFrame:
    """posts joined to rows of asked by term; a term's postings are never in one task as a whole."""
    if bounded(asked):
        return posts.join(F.broadcast(asked), on, how)
    salted = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return posts.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, [on, "_salt"], how).drop("_salt")


def index(docs: DataFrame, vocabulary: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(row, key, n) of each document with a term, and the postings (row, n, t, tf) of the terms of vocabulary (t, term).

    Every document has one more word, null, which becomes its row of the first table.
    """
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("_key"), terms("text").alias("w")).where(F.size("w") > 0)
    every = words.select("row", "_key", F.size("w").cast("long").alias("n"), F.explode(F.concat("w", F.array(F.lit(None).cast("string")))).alias("term"))
    known = by_term(every, vocabulary, "term", "left").where("t is not null or term is null")
    counted = materialize(known.groupBy("row", "_key", "n", "t").agg(F.count("*").alias("tf")))
    return counted.where("t is null").select("row", F.col("_key").alias(key), "n"), counted.where("t is not null").select("row", "n", "t", "tf")


def impacts(heads: DataFrame, posts: DataFrame) -> DataFrame:
    """(row, t, impact) of postings by the weighting of the contract, in 64-bit integers."""
    n_docs, length = heads.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = materialize(posts.groupBy("t").agg(F.count("*").alias("df")).select("t", weight.alias("w")))
    m = f"(75 + (25L * n * {n_docs}L) div {max(length, 1)}L)"
    return by_term(posts, weights).selectExpr("row", "t", f"w * ((1000000000L * tf) div (1000L * tf + 12L * {m})) AS impact")


def best(rows: DataFrame, by: str, k: int, *order) -> DataFrame:
    """The first k rows of each group with their place from 1; tasks cut to k rows a group before the exchange."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def scored(pairs: DataFrame, posts: DataFrame, asked: DataFrame) -> DataFrame:
    """(q, row, score): the exact scores of distinct pairs (q, row)."""
    own = posts.join(sized(pairs), "row")  # a document's postings and the items it is a candidate of
    return own.join(sized(asked), ["q", "t"]).groupBy("q", "row").agg(F.sum(F.col("c") * F.col("impact")).alias("score"))


def search(docs: DataFrame, items: DataFrame, k: int = TOP, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """(item_key, rank, key, score) of each item's k best documents with a score above 0."""
    told = item_terms(items, item_key)
    vocabulary = materialize(told.select("term").distinct().select(F.monotonically_increasing_id().alias("t"), "term"))
    heads, posts = index(docs, vocabulary, key)
    posts = materialize(impacts(heads, posts).where("impact > 0"))
    asked = materialize(told.join(vocabulary, "term").select("q", "t", "c"))

    # the k greatest impacts of each term, and what an item can win by it
    stored = materialize(best(posts, "t", k, F.desc("impact"), "row"))
    bounds = stored.groupBy("t").agg(F.max("impact").alias("most"), F.max(F.when(F.col("rank") == k, F.col("impact"))).alias("kth"))
    shares = asked.join(bounds, "t").select("q", "t", "c", (F.col("c") * F.col("most")).alias("share"), (F.col("c") * F.coalesce("kth", F.lit(0))).alias("least"))
    seeds = materialize(by_term(stored.select("row", "t"), asked.select("q", "t")).select("q", "row").distinct())
    kth = best(scored(seeds, posts, asked), "q", k, F.desc("score")).where(F.col("rank") == k).select("q", F.col("score").alias("seeded"))
    least = shares.groupBy("q").agg(F.max("least").alias("least")).join(kth, "q", "left")
    shares = shares.drop("least").join(least.select("q", F.greatest("least", F.coalesce("seeded", F.lit(0))).alias("threshold")), "q")

    # terms in order of their shares; the sum up to a term bounds what it and all before it can win together
    below = Window.partitionBy("q").orderBy("share", "t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = materialize(shares.withColumn("sum", F.sum("share").over(below)))
    essential = shares.where(F.col("sum") >= F.col("threshold")).select("q", "t", "c")
    rest = shares.groupBy("q").agg(F.max("threshold").alias("threshold"), F.coalesce(F.sum(F.when(F.col("sum") < F.col("threshold"), F.col("share"))), F.lit(0)).alias("rest"))
    met = by_term(posts, essential).groupBy("q", "row").agg(F.sum(F.col("c") * F.col("impact")).alias("partial"))
    candidates = materialize(met.join(sized(rest), "q").where(F.col("partial") + F.col("rest") >= F.col("threshold")).select("q", "row"))
    found = scored(candidates, posts, asked).join(heads.select("row", key), "row")
    ranked = best(found, "q", k, F.desc("score"), F.asc_nulls_last(key), "row")
    return ranked.join(told.select("q", item_key).distinct(), "q").select(item_key, F.col("rank").cast("int").alias("rank"), key, "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT *, len(w) AS n FROM words WHERE len(w) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM d),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2.0 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, docs),
i AS (SELECT q, item_id, term, count(*) AS c FROM (
  SELECT q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS q, * FROM benchmark)) GROUP BY ALL),
a AS (SELECT q, item_id, r, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // l)))) AS BIGINT) AS score FROM i JOIN p USING (term) JOIN f USING (term), s GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r) AS rank FROM a WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM b WHERE rank <= 20
"""
