"""Streams (ST1-ST3, ST7, ST10) and limits as windows over tables (ST4-ST6): incremental files, sessions, context buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ingest(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, files: int = 500) -> None:
    """ST1, ST2, ST3: Parquet files not seen yet, in micro-batches, to a Parquet sink; resumes at the checkpoint."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def window_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling event-time window and key, with a watermark. The time is made a zoned timestamp first."""
    rows = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return rows.groupBy(F.window("_t", width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def sliding_count(rows: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """Of each row, the earlier requests of its key less than `seconds` before, itself included."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return rows.withColumn("in_window", F.count("*").over(w))


def rate_limited(rows: DataFrame, key: str, time: str, limits: dict[int, int]) -> DataFrame:
    """ST4/ST5: allowed is false where some window (seconds: most) is overfull; a sliding log of all requests."""
    flags = F.lit(True)
    for k, (seconds, most) in enumerate(limits.items()):
        rows = sliding_count(rows, key, time, seconds).withColumnRenamed("in_window", f"_w{k}")
        flags = flags & (F.col(f"_w{k}") <= most)
    return rows.withColumn("allowed", flags).drop(*(f"_w{k}" for k in range(len(limits))))


def lockouts(rows: DataFrame, key: str, time: str, failed: str, most: int = 5, seconds: int = 900) -> DataFrame:
    """ST6/A4: failures of the last 15 minutes since the key's last success, and whether they lock it."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    before = Window.partitionBy(key).orderBy(at, "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.sum((~F.col(failed)).cast("int")).over(before))
    w = Window.partitionBy(key, "_run").orderBy(at).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    rows = rows.withColumn("failures", F.sum(F.col(failed).cast("int")).over(w))
    return rows.withColumn("locked", F.col("failures") >= most).drop("_run")


def sessions(rows: DataFrame, key: str, time: str, gap: str = "24 hours") -> DataFrame:
    """ST7: (key, session_start, n) of runs of events with no gap over the expiry."""
    at = F.col(time).cast("timestamp")
    w = Window.partitionBy(key).orderBy(at, "event_id")
    new = (at > F.lag(at).over(w) + F.expr(f"interval {gap}")) | F.lag(at).over(w).isNull()
    rows = rows.withColumn("_s", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "_s").agg(F.min(time).alias("session_start"), F.count("*").alias("n")).drop("_s")


def session_counts(stream: DataFrame, key: str, time: str, gap: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """ST7 on a stream: (key, session_start, n) of each session, once the watermark has passed its end; later rows are dropped and counted."""
    rows = stream.select(F.col(key).alias("_key"), F.col(time).cast("timestamp").alias("_time")).withWatermark("_time", late)
    told = rows.groupBy("_key", F.session_window("_time", gap).alias("w")).agg(F.count("*").alias("n"))
    return told.select(F.col("_key").alias(key), F.col("w.start").alias("session_start"), "n")


def swap_context(batch: DataFrame, number: int, where: str, key: str, order: str, replaces) -> None:
    """ST10, for foreachBatch: all rows are appended to the history; of rows that replace, the last of a key is its context.

    Both are written under the batch's number: a batch that comes again overwrites what it wrote before, and starts from
    the context that the batch before it left.
    """
    spark = batch.sparkSession
    batch = batch.persist()
    batch.write.mode("overwrite").parquet(f"{where}/history/batch={number}")
    rows, old = batch.where(replaces), versions(spark, f"{where}/context", number)
    rows = rows if old is None else rows.unionByName(spark.read.schema(batch.schema).parquet(f"{where}/context/version={old}"))
    last = rows.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("x")).select("x.*")
    last.write.mode("overwrite").parquet(f"{where}/context/version={number}")
    batch.unpersist()


def versions(spark: SparkSession, path: str, before: int | None = None) -> int | None:
    """The greatest finished version=N folder below path (of those before a number)."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return None
    done = [f.getPath() for f in files.listStatus(root) if files.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    numbers = [int(p.getName().split("=")[1]) for p in done]
    return max((n for n in numbers if before is None or n < before), default=None)


def buckets(spark: SparkSession, where: str) -> tuple[DataFrame, DataFrame]:
    """The history and the newest context that swap_context left."""
    return spark.read.parquet(f"{where}/history").drop("batch"), spark.read.parquet(f"{where}/context/version={versions(spark, f'{where}/context')}")
