"""Dense search of a query set by an inverted file (R1-R3, J13): exact, or the nearest lists only.

Centroids are fitted on a bounded sample; every point lies in the list of its nearest centroid, with its residual (its
distance to it). Lists are partitions, cut into blocks of BLOCK_ROWS points; queries go to the blocks of their nearest
lists by an exchange, cut into groups of QUERY_ROWS, so neither side is broadcast or collected. By Cauchy-Schwarz a
list can't hold a better row than q.c + |q| * its greatest residual; in a second pass queries go to those lists whose
bound reaches their kth score. So the result is that of comparing all pairs, whatever the lists are; with exact=False the
second pass is left out.

Vectors are compared as unit vectors; scores are rounded to DIGITS; ties go to the lower id. Rows without a vector, and
of another length than a query's, are no candidates; a vector without length scores 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.sources.shared import landed

#: Rows the centroids are fitted on, rows a list should hold, and the most lists there are.
SAMPLE_ROWS, LIST_ROWS, MAX_LISTS = 20_000, 20_000, 2048
ROUNDS = 8
PROBED = 4
BLOCK_ROWS, QUERY_ROWS = 20_000, 2_000
#: Scores that are computed at a time.
TILE = 1 << 20
DIGITS = 9
SLACK = 1e-8


def unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


class Lists:
    """Centroids of each vector length; lists are numbered through all lengths."""

    def __init__(self, centroids: dict[int, np.ndarray]):
        self.centroids, self.first, n = centroids, {}, 0
        for size, c in sorted(centroids.items()):
            self.first[size], n = n, n + len(c)
        self.n = n

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of unit vectors of one length: their lists, and the residuals."""
        c = self.centroids[x.shape[1]]
        gap = ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)
        return self.first[x.shape[1]] + gap, np.linalg.norm(x - c[gap], axis=1)

    def bounds(self, q: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """What a row of each list of q's length can score at most (radius: -inf for an empty list)."""
        c, first = self.centroids[len(q)], self.first[len(q)]
        return c @ q + np.linalg.norm(q) * radius[first : first + len(c)]


def fitted(rows: DataFrame) -> Lists:
    """Centroids by some rounds of k-means on the SAMPLE_ROWS rows (id, dense) of the least hashes; about a list for LIST_ROWS rows."""
    counts = dict(map(tuple, rows.groupBy(F.size("dense")).count().limit(MAX_LISTS).collect()))
    n = sum(counts.values())
    sample = rows.orderBy(F.xxhash64("id", F.lit("sample"))).limit(SAMPLE_ROWS).select("dense").collect()
    by_size: dict[int, list] = {}
    for r in sample:
        by_size.setdefault(len(r.dense), []).append(r.dense)
    # a length that the sample doesn't hold has one list around the origin
    out = {}
    for size in counts:
        own = unit(by_size[size]) if size in by_size else np.zeros((1, size))
        lists = max(1, min(MAX_LISTS, -(-n * len(own) // (max(1, len(sample)) * LIST_ROWS)), len(own)))
        c = own[np.linspace(0, len(own) - 1, lists).astype(int)].copy()
        for _ in range(ROUNDS if lists > 1 else 1):
            near = ((c * c).sum(axis=1)[None, :] - 2 * own @ c.T).argmin(axis=1)
            for k in range(lists):
                if (near == k).any():
                    c[k] = own[near == k].mean(axis=0)
        out[size] = c
    return Lists(out)


class Index:
    """points (id, list, part, dense) at rest, the lists' centroids, and their radius and number of parts."""

    def __init__(self, points: DataFrame):
        rows = points.where("dense is not null and size(dense) > 0").select("id", "dense")
        self.lists = lists = fitted(rows)
        kind = points.schema["id"].dataType.simpleString()

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                size = batch["dense"].map(len).to_numpy()
                at, residual = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch))
                for s in np.unique(size):
                    own = np.flatnonzero(size == s)
                    at[own], residual[own] = lists.nearest(unit(batch["dense"].iloc[own]))
                yield batch.assign(list=at, residual=residual)

        placed = landed(rows.mapInPandas(place, f"id {kind}, dense array<double>, list int, residual double"))
        # at most MAX_LISTS rows for each length
        stats = placed.groupBy("list").agg(F.count("*"), F.max("residual")).collect() if lists.n else []
        self.radius, self.parts = np.full(lists.n, -np.inf), np.zeros(lists.n, dtype=np.int64)
        for k, rows_, most in stats:
            self.radius[k], self.parts[k] = most, -(-rows_ // BLOCK_ROWS)
        parts = F.element_at(F.array(*map(F.lit, map(int, self.parts))), F.col("list") + 1) if lists.n else F.lit(1)
        self.rows = placed.select("id", "dense", "list", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))

    def asked(self, queries: DataFrame, least: bool) -> DataFrame:
        """(query_id, query_dense, list, part) of the lists each query goes to: the PROBED of the best bounds; or the others whose
        bound reaches the query's `least` score."""
        lists, radius, parts = self.lists, self.radius, self.parts
        kind = queries.schema["query_id"].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    out, q = [], unit([row.query_dense])[0]
                    if len(q) in lists.centroids:
                        bound, first = lists.bounds(q, radius), lists.first[len(q)]
                        order = np.argsort(-bound, kind="stable")
                        some = order[PROBED:][bound[order[PROBED:]] >= row.least - SLACK] if least else order[:PROBED]
                        out = [(first + k, p) for k in some for p in range(parts[first + k])]
                    if out:
                        yield pd.DataFrame({"query_id": pd.Series([row.query_id] * len(out), dtype=object), "query_dense": [q] * len(out), "list": [x for x, _ in out], "part": [p for _, p in out]})

        return queries.mapInPandas(run, f"query_id {kind}, query_dense array<double>, list int, part int")

    def scored(self, asked: DataFrame, k: int, threshold: float | None) -> DataFrame:
        """(query_id, id, score): the k best rows of each block for each query that was sent to it."""
        asked = landed(asked)
        met = asked.groupBy("list", "part").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("groups"))
        own = ["list", "part", "group"]
        # a block that many queries go to is multiplied, so a task holds BLOCK_ROWS points and about QUERY_ROWS queries
        blocks = self.rows.join(met, ["list", "part"]).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select(*own, "id", "dense")
        grouped = asked.join(met, ["list", "part"]).withColumn("group", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int")).select(*own, "query_id", "query_dense")
        kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {self.rows.schema['id'].dataType.simpleString()}, score double"

        def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(points) and len(queries):
                x, ids = unit(points["dense"]), points["id"].to_numpy()
                order = np.argsort(ids, kind="stable")
                x, ids = x[order], ids[order]
                q, names = np.array(queries["query_dense"].tolist()), queries["query_id"].to_numpy()
                for at in range(0, len(q), step := max(1, TILE // len(x))):
                    scores = (q[at : at + step] @ x.T).round(DIGITS)
                    for row, score in enumerate(scores):
                        near = np.flatnonzero(score >= (-np.inf if threshold is None else threshold))
                        if len(near) > k:  # the kth best and its ties, then the lower ids
                            near = near[score[near] >= np.partition(score[near], len(near) - k)[len(near) - k]]
                            near = near[np.argsort(-score[near], kind="stable")[:k]]
                        out.append(pd.DataFrame({"query_id": pd.Series([names[at + row]] * len(near), dtype=object), "id": ids[near], "score": score[near]}))
            return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})

        return blocks.groupBy(*own).cogroup(grouped.groupBy(*own)).applyInPandas(run, kinds)

    def search(self, queries: DataFrame, k: int, threshold: float | None = None, exact: bool = True) -> DataFrame:
        """(query_id, id, score, rank) of the k best rows of each of queries (query_id, query_dense)."""
        queries = queries.where("query_dense is not null").select("query_id", "query_dense")
        found = self.scored(self.asked(queries, False), k, threshold)
        if exact and max(map(len, self.lists.centroids.values()), default=0) > PROBED:
            found = landed(ranked(found, k))
            kth = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
            floor = -2.0 if threshold is None else threshold
            told = queries.join(kth, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(floor)))
            found = found.drop("rank").unionByName(self.scored(self.asked(told, True), k, threshold))
        return ranked(found, k)


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) of the k best rows of each query; tasks cut to k rows a query before the exchange."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)

