"""Operator 6: shards by sampled splitters, with DataFrame functions only.

Rows are ordered by (text hash, doc_id, row tie), so equal texts lie together; the hash is the first
60 bits of the text's MD5, null standing with the empty text. A size-weighted sample
of keys (Efraimidis-Spirakis: the least -ln(u) / size) gives quantile boundaries; rows are put into
ranges between them, and ranges that came out overfull are subdivided by splitters of their own
sample. Running sums within ranges and range totals give every row its byte offset in the whole
order; shard k takes the rows that begin in the k-th of n equal shares. So shards differ from their
share by less than the largest row, whatever the sample was; a hot text is cut between its rows.

Law `bytes`: size is the UTF-8 bytes of the text (null: none) plus 8. Repeated rows are told apart by
a tie number, a null doc_id sorts first; an empty table gives no rows. Other columns are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import materialize, table

#: Rows a range should hold; ranges are sorted in one task each.
RANGE_ROWS = 20_000
MAX_RANGES = 4096
#: Sampled keys for each range.
SAMPLED = 16
ROW_BYTES = 8


def splitters(rows: DataFrame, weight: str, n: int) -> list:
    """n - 1 boundaries at the quantiles of a size-weighted sample of SAMPLED * n keys (bounded by MAX_RANGES)."""
    u = (F.pmod(F.xxhash64("h", "id", "tie", F.lit("sample")), F.lit(1 << 53)) + 1) / float((1 << 53) + 1)
    sample = rows.orderBy(-F.log(u) / F.col(weight)).limit(SAMPLED * n).select("h", "id", "tie").collect()
    keys = sorted(tuple(r) for r in sample)
    return sorted({keys[len(keys) * k // n] for k in range(1, n)}) if keys else []


def literal(keys: list):
    kind = "array<struct<h:bigint,id:bigint,tie:bigint>>"
    return F.array(*(F.struct(F.lit(h).cast("long").alias("h"), F.lit(i).cast("long").alias("id"), F.lit(t).cast("long").alias("tie")) for h, i, t in keys)).cast(kind) if keys else F.expr(f"cast(array() as {kind})")


def located(rows: DataFrame, bounds: list):
    """How many bounds are at most the row's key, by a coarse and a fine search of about the root of their number each."""
    step = max(1, math.isqrt(len(bounds)))
    key = F.struct("h", "id", "tie")
    count = lambda keys: F.size(F.filter(keys, lambda b: b <= key))
    if len(bounds) <= 16:
        return rows.withColumn("range", count(literal(bounds)))
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    fine = F.array(*map(literal, groups))
    rows = rows.withColumn("_coarse", count(literal([g[0] for g in groups])))
    inner = F.when(F.col("_coarse") > 0, (F.col("_coarse") - 1) * step + count(F.element_at(fine, F.greatest("_coarse", F.lit(1))))).otherwise(0)
    return rows.withColumn("range", inner.cast("int")).drop("_coarse")


def shard(docs: DataFrame, shards: int = 24, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = materialize(
        docs.select(
            "doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.monotonically_increasing_id().alias("tie"),
        )
    )
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    range_rows = max(range_rows, -(-n // MAX_RANGES))
    ranges = max(shards * 2, -(-n // range_rows))
    bounds = splitters(rows, "size", ranges)
    rows = located(rows, bounds)
    stats = {r[0]: (r[1], r[2]) for r in rows.groupBy("range").agg(F.count("*"), F.sum("size")).collect()}  # a row for each range
    over = sorted(k for k, (m, _) in stats.items() if m > 2 * range_rows)
    if over:  # subdivide by splitters drawn inside the overfull ranges
        more = []
        for k in over:
            more += splitters(rows.where(F.col("range") == k).withColumn("one", F.lit(1.0)), "one", min(MAX_RANGES, 1 + stats[k][0] // range_rows))
        bounds = sorted({*bounds, *more})
        rows = located(rows.drop("range"), bounds)
        stats = {r[0]: (r[1], r[2]) for r in rows.groupBy("range").agg(F.count("*"), F.sum("size")).collect()}
    offsets, at_row, at_byte = [], 0, 0
    for k in sorted(stats):
        offsets.append((k, at_row, at_byte))
        at_row, at_byte = at_row + stats[k][0], at_byte + stats[k][1]
    spark = docs.sparkSession
    base = spark.createDataFrame(offsets, "range int, rows_before long, bytes_before long")
    order = Window.partitionBy("range").orderBy("h", "id", "tie")
    # a range is a bounded number of rows; sums before each row run inside it
    placed = rows.join(F.broadcast(base), "range").select(
        "doc_id", "size", "text_crc32",
        (F.col("rows_before") + F.row_number().over(order) - 1).alias("row"),
        F.floor((F.col("bytes_before") + F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("decimal(38,0)") * shards / F.lit(max(total, 1)).cast("decimal(38,0)")).cast("int").alias("shard"),
    )
    placed = materialize(placed)
    first = F.broadcast(placed.groupBy("shard").agg(F.min("row").alias("first_row")))  # a row for each shard
    return placed.join(first, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


#: CRC-32 byte by byte with a table of its polynomial; shares are cut where `shard` cuts them.
ORACLE = """
WITH RECURSIVE t(k, b, c) AS (
  SELECT 0, range, range FROM range(256)
  UNION ALL SELECT k + 1, b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS l FROM t WHERE k = 8),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, CAST('0x' || left(md5(coalesce(text, '')), 15) AS BIGINT) AS h, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS x FROM documents),
o AS (
  SELECT *, row_number() OVER w AS n, CAST(sum(size) OVER w AS HUGEINT) - size AS offs, CAST(sum(size) OVER () AS HUGEINT) AS total
  FROM d WINDOW w AS (ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, CAST(offs * 24 // total AS INT) AS shard FROM o)
SELECT doc_id, size, xor(list_reduce(list_transform(x, lambda v: CAST('0x' || v AS BIGINT)), lambda c, v: xor(c >> 8, l[1 + (xor(c, v) & 255)]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32,
  'bytes' AS law, shard, n - min(n) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INT) AS grown_shard
FROM p, crc
"""
