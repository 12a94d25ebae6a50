"""What the operators of this subpackage share: table access, lineage cuts, connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OWN_DIR = "spark.lexmill.shared.dir"
A_TO_Z = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset (in tests), a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_DIR, None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set(OWN_DIR, found)  # spark.checkpoint.dir itself can't be set in a running session
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows are written to the shared folder and read back from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def lower_ascii(c):
    """A-Z to a-z, everything else unchanged."""
    return F.translate(c, *A_TO_Z)


def stars(edges: DataFrame) -> bool:
    """Whether every node hangs below one root that hangs below none."""
    roles = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("below")), F.struct(F.col("b").alias("x"), F.lit(0).alias("below")))).alias("r")).select("r.*")
    odd = roles.groupBy("x").agg(F.sum("below").alias("n"), F.min("below").alias("root")).where("n > 1 or (n > 0 and root = 0)")
    return odd.isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b): root is the smallest node reachable.

    Large-star and small-star steps alternate until the edge set is a set of stars. A hub only meets
    an aggregate with a map-side combine and joins that adaptive execution can split; no component is
    gathered. Edges are not null; an empty input gives an empty result.
    """
    edges = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    )
    for _ in range(max_rounds):
        if stars(edges):
            break
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        # large star: every larger neighbour is hung below the smallest node next to its hub
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours are hung below the smallest of them
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small, "a")
        edges = materialize(
            joined.select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b"))
            .where("a != b")
            .distinct()
        )
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
