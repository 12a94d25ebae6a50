"""Table maintenance: upsert, replace, delete, checkpoints (K1-K23), as whole new DataFrames or in place of a table's own buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.sources.shared import landed


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Insert or replace by key (null is a key); of several new rows of a key the last one wins."""
    fresh = latest(new, key, order)
    return others(old, fresh, key).unionByName(fresh)


def others(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of old whose key new has not."""
    return old.join(new.select(F.col(key).alias("_new")).distinct(), F.col(key).eqNullSafe(F.col("_new")), "left_anti")


def replace_group(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of every key (null is one) that new has are replaced as a whole."""
    return others(old, new, key).unionByName(new)


def delete(rows: DataFrame, condition: Column) -> DataFrame:
    """K10; a condition that is null keeps the row."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def set_where(rows: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Columns changed where the condition holds."""
    return rows.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def patched(rows: DataFrame, fixes: DataFrame, key: str) -> DataFrame:
    """Values of fixes override those of rows, by key."""
    other = [c for c in fixes.columns if c != key]
    return rows.join(fixes.withColumnsRenamed({c: f"_{c}" for c in other}), key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in other else F.col(c) for c in rows.columns))


def missing(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def pivoted(cells: DataFrame, row: str, field: str, value: str, fields: list[str]) -> DataFrame:
    """Long review cells to a wide table; cells that are missing are null."""
    return cells.groupBy(row).pivot(field, fields).agg(F.first(value))


def written(rows: DataFrame, path: str, **counts: Column) -> dict:
    """V6/K3: rows written as Parquet, and counts taken on the way, without a second pass."""
    seen = Observation()
    rows.observe(seen, F.count("*").alias("rows"), *(c.alias(n) for n, c in counts.items())).write.mode("append").parquet(path)
    return seen.get


def base_ids(chunks: DataFrame, column: str = "id") -> DataFrame:
    """M2: the distinct ids that the chunks' ids (`<id>_chunk_<n>`) begin with."""
    return chunks.select(F.regexp_replace(column, r"(?s)^(.*)_chunk_.*$", "$1").alias("id")).distinct()


def next_number(files: DataFrame, column: str = "path") -> DataFrame:
    """M2: one row, one more than the greatest number in `embeddings_<number>`, else 0."""
    number = F.regexp_extract(column, r"embeddings_(\d+)", 1).try_cast("int")
    return files.agg((F.coalesce(F.max(number), F.lit(-1)) + 1).alias("next_number"))


def widened(spark, path: str) -> DataFrame:
    """A folder whose later files have more columns than earlier ones; rows without a column have null."""
    return spark.read.option("mergeSchema", True).parquet(path)


def preferred(rows: DataFrame, key: str, value: str, status: str) -> DataFrame:
    """Of each key the value of the least status; ties go to the least value."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(status, value)).alias(value))


def dimension(own: DataFrame, *others: DataFrame) -> DataFrame:
    """The union of code sets."""
    for x in others:
        own = own.unionByName(x)
    return own.distinct()


def recent(rows: DataFrame, by: str, key: str) -> DataFrame:
    """Newest first; ties by key."""
    return rows.orderBy(F.desc(by), key)


def first_of_each(rows: DataFrame, key: str, order: str, value: str, most: int) -> DataFrame:
    """At most `most` values of each key, in order; a group is cut before it is gathered."""
    w = Window.partitionBy(key).orderBy(order, value)
    kept = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    parts = F.array_sort(F.collect_list(F.struct("_n", F.col(value).alias("v"))))
    return kept.groupBy(key).agg(F.transform(parts, lambda x: x["v"]).alias(f"{value}s"))


#: The column that tells a row's place in a table at rest.
PLACE = "_bucket"


def placed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn(PLACE, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def create(rows: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """A table at rest: one folder for each bucket of keys."""
    placed(rows, key, buckets).repartition(buckets, PLACE).write.partitionBy(PLACE).parquet(path)


def at_rest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(PLACE)


def merge_at_rest(new: DataFrame, path: str, key: str, buckets: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """The buckets that new's keys hit are read, merged with new, and put in place of the old ones; the others are not touched.

    merge(old, new) must keep every hit bucket filled, as upserts do. What it gives is written aside first, so a failure
    leaves the table as it was, and a run that comes again gives the same table. Returns the hit buckets (at most `buckets`).
    """
    spark = new.sparkSession
    new = placed(new, key, buckets)
    hit = sorted(r[0] for r in new.select(PLACE).distinct().collect())
    if hit:
        old = spark.read.parquet(path).where(F.col(PLACE).isin(*hit))
        made = landed(merge(old.select(new.columns), new))
        made.repartition(len(hit), PLACE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PLACE).parquet(path)
    return hit


def upsert_at_rest(new: DataFrame, path: str, key: str, order: str, buckets: int = 64) -> list[int]:
    """K1/K11 on a table that create() made with as many buckets."""
    return merge_at_rest(new, path, key, buckets, lambda old, rows: upsert(old, rows, key, order))


def replace_group_at_rest(new: DataFrame, path: str, key: str, buckets: int = 64) -> list[int]:
    """K12 on such a table."""
    return merge_at_rest(new, path, key, buckets, lambda old, rows: replace_group(old, rows, key))


def registry(rows: DataFrame, number: str, language: str, name: str, status: str, order: str, ranks: dict[str, int], other: int = 99) -> DataFrame:
    """(number, names, all_names): of each number and language the name of the least status rank, of several the last; and all its names, sorted."""
    rank = F.coalesce(*(F.when(F.col(status) == k, v) for k, v in ranks.items()), F.lit(other))
    best = F.max_by(F.col(name), F.struct(-rank, F.col(order)))
    each = rows.where(F.col(name).isNotNull()).groupBy(number, language).agg(best.alias("_name"), F.collect_set(name).alias("_all"))
    return each.groupBy(number).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(language, "_name")))).alias("names"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_all")))).alias("all_names"))


def inverse(rows: DataFrame, number: str, name: str) -> DataFrame:
    """(name, numbers): the sorted numbers of each name."""
    pairs = rows.where(F.col(name).isNotNull()).select(name, number).distinct()
    return pairs.groupBy(name).agg(F.array_sort(F.collect_list(number)).alias("numbers"))
