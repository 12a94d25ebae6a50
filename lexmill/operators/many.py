"""Many queries at once: a query set against all rows (R1-R3, J12-J14), and many strings in all texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators import ivf, postings
from lexmill.operators.filters import compile_filter
from lexmill.operators.ivf import ranked

#: Characters in a broadcast block of strings.
BLOCK = 1 << 22


def dense(points: DataFrame, queries: DataFrame, k: int = 50, filters: dict | None = None, threshold: float | None = None, exact: bool = True) -> DataFrame:
    """R1/R3/J13 for many queries: (query_id, id, score, rank) by the cosine of `dense` to `query_dense`, by an inverted file.

    Filters come before the top-k, as the threshold does. Rows without a vector, and of another length than a
    query's, are no candidates; a vector without length scores 0.
    """
    return ivf.Index(points.where(compile_filter(filters))).search(queries, k, threshold, exact)


def vectors(posts: DataFrame) -> DataFrame:
    """(id, t, w): the tokens' 64-bit hashes and the weights of each row of postings (id, token, weight), gathered by an exchange."""
    pair = F.struct(F.xxhash64("token").alias("t"), F.col("weight").cast("double").alias("w"))
    return posts.groupBy("id").agg(F.collect_list(pair).alias("x")).select("id", F.col("x.t").alias("t"), F.col("x.w").alias("w"))


def word_vectors(docs: DataFrame, words: Column) -> DataFrame:
    """(id, t, w) of texts' words where they lie: each occurrence stands for itself with weight 1 (a null w), so nothing is exchanged."""
    return docs.select("id", F.transform(words, lambda x: F.xxhash64(x)).alias("t"), F.lit(None).cast("array<double>").alias("w"))


def sparse(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """J12 for many queries: (query_id, id, score, rank) by the sum of products of vectors (id, t, w) and (query_id, token, weight), by posting lists.

    Only rows that share a token are candidates. A token may come more than once in a vector; its weights add up.
    """
    tokens = asked.select("query_id", F.xxhash64("token").alias("t"), F.col("weight").cast("double").alias("w")).where("token is not null")
    return postings.Postings(rows).search(tokens, k)


def fuse(lists: list[DataFrame], k: int, score) -> DataFrame:
    """J14 for many queries: (query_id, id, score, rank) of ranked lists; score: a rank's share."""
    rows = reduce(DataFrame.unionByName, [x.select("query_id", "id", score(F.col("rank")).alias("share")) for x in lists])
    return ranked(rows.groupBy("query_id", "id").agg(F.round(F.sum("share"), 12).alias("score")), k)


def containing(docs: DataFrame, items: DataFrame) -> DataFrame:
    """J4/J5 for items of any length: (item_id, id) where the text of (id, text) contains that of (item_id, text).

    Items go in blocks of about BLOCK characters, each an automaton that reads every text once. Null texts contain
    nothing and are in nothing; an empty item is in every text.
    """
    told = items.where("text is not null").select("item_id", "text")
    n = max(1, -(-(told.agg(F.sum(F.length("text") + 1)).first()[0] or 0) // BLOCK))
    kinds = f"item_id {items.schema['item_id'].dataType.simpleString()}, id {docs.schema['id'].dataType.simpleString()}"
    rows = docs.where("text is not null").select("id", "text")

    def one(block: DataFrame) -> DataFrame:
        of: dict[str, list] = {}
        for r in block.collect():  # about BLOCK characters
            of.setdefault(r.text, []).append(r.item_id)
        shared = docs.sparkSession.sparkContext.broadcast(of)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            machine = ahocorasick.Automaton()
            for text in shared.value:
                if text:
                    machine.add_word(text, text)
            machine.make_automaton()
            for batch in batches:
                out = []
                for key, text in zip(batch["id"], batch["text"], strict=True):
                    found = {w for _, w in machine.iter(text)} if len(machine) else set()
                    out += [(i, key) for w in (*found, *([""] if "" in shared.value else [])) for i in shared.value[w]]
                yield pd.DataFrame(out, columns=["item_id", "id"])

        return rows.mapInPandas(run, kinds)

    return reduce(DataFrame.unionByName, [one(told.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)) for k in range(n)])
