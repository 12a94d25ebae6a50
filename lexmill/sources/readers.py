"""Sources and sinks of files (S1-S25, K4-K9): schemas are explicit, malformed records are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text

DECISION = (
    "id string, file_name string, date string, year int, language string, court string, outcome string, "
    "metadata struct<judges:array<string>,citations:struct<cases:array<string>,laws:array<string>>,lower_court:string>, "
    "content struct<regeste:string,facts:string,reasoning:string,decision:string>"
)
ARTICLE = (
    "id string, base_id string, sr_number string, sr_name string, abbreviation string, abbreviations_all map<string,string>, language string, "
    "article_number string, article_title string, article_text string, paragraph_number int, is_partial boolean, part string, title string, chapter string, "
    "section string, hierarchy_path string, law_type string, domain string, cites_articles array<string>"
)
MAX_BYTES = 50 * 1024 * 1024


def decisions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One JSON object a file, by file name; files that don't parse are dropped."""
    rows = spark.read.schema(DECISION).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    rows = rows.withColumn("_source_file", F.col("_metadata.file_name")).where("id is not null")
    return rows if limit is None else rows.orderBy("_source_file").limit(limit)


def checked(spark: SparkSession, path: str, schema: str, whole: bool = False) -> DataFrame:
    """JSON rows (a line or, if whole, a file each) with _source_file, and _broken: what could not be parsed, which has nulls elsewhere."""
    rows = spark.read.schema(f"{schema}, _broken string").option("multiLine", whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.withColumn("_source_file", F.col("_metadata.file_name"))


def articles(spark: SparkSession, path: str) -> DataFrame:
    """S3: each file a JSON list of articles or one article."""
    return spark.read.schema(ARTICLE).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """HTML files as cleaned text."""
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return raw.select("path", text.html_to_text(F.col("value")).alias("text"))


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files up to 50 MB with hash, extension, and text of the plain ones. Others need a parser of their own."""
    rows = spark.read.format("binaryFile").load(path).where(F.col("length") <= MAX_BYTES)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return rows.select("path", "length", kind.alias("file_type"), text.file_hash(F.col("content")).alias("file_hash"), F.when(kind.isin("txt", "md"), F.try_validate_utf8(F.col("content").cast("string"))).alias("full_text"))


def stems(spark: SparkSession, path: str) -> DataFrame:
    """File stems of a folder; contents are not read."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("stem"))


def ids(rows: DataFrame, column: str = "id") -> DataFrame:
    """The distinct ids of a collection."""
    return rows.select(column).where(F.col(column).isNotNull()).distinct()


def logged_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Distinct file names that logs mention."""
    return spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(1))).alias("file")).distinct()


def hits(pages: DataFrame, key: str, per_page: int = 500, most: int = 9500, most_pages: int = 20) -> DataFrame:
    """(key, page, doc_id) of landed pages (key, page, hits), as far as an interface gives them: it stops at so many hits or pages."""
    kept = pages.where((F.col("page") < most_pages) & (F.col("page") * per_page < most))
    return kept.select(key, "page", F.explode("hits").alias("doc_id"))


def write_points(rows: DataFrame, path: str, per_file: int = 1000) -> None:
    """K5: Parquet files of at most per_file points."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", per_file).parquet(path)


def append_usage(rows: DataFrame, path: str) -> None:
    """K8: JSON lines."""
    rows.write.mode("append").json(path)


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8) -> DataFrame:
    """A relational table, in ranges of a numeric key if bounds are given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()
