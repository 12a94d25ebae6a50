"""The folder that driver and executors share, and tables in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

OWN_DIR = "spark.lexmill.shared.dir"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local folder, which only a local master can share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_DIR, None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set(OWN_DIR, found)  # spark.checkpoint.dir itself can't be set in a running session
    return found


def landed(rows: DataFrame, **options) -> DataFrame:
    """rows by way of a table in the shared folder, so that they are computed once and survive lost executors; options: the writer's."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    rows.write.options(**options).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def there(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path, in whatever file system it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
