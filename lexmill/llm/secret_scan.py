"""Operator 9: secret scans through an incremental blob ledger.

Every version of a document is addressed by the SHA-256 of its text (its blob). A history is a table of paths, the
commit that set each of them, and the text it got. Commits are scanned one after another: of a commit's changed paths
only those blobs are scanned that the ledger has not under the rule version; their findings are appended to the ledger,
a Parquet folder that the cluster shares, and joined back to all paths that hold the blob. So a text that comes again,
under another path or in a later commit, is never scanned twice, and new rules are a new rule version. The method adds
no spans to those of the base rules.

Each scan appends a file set of its own; readers take one row for each (blob, rule version), so scans that run at once,
or are repeated after a failure, leave the same findings. Null text counts as empty. Repeated rows are kept as they
come; a long text is scanned whole, in one task; a frequent text is one blob, found with a map-side combine. An empty
table gives no rows. Other columns are dropped, so none can clash.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import shared_dir, table

KINDS = ("assign", "access", "hex")
RULE_VERSION = "base-1"
FINDING = "array<struct<kind:string,start:long,end:long>>"
LEDGER = f"blob string, rule_version string, scan long, findings {FINDING}"


def either(word: str) -> str:
    """The word with ASCII letters in either case (IGNORECASE would also take some non-ASCII letters)."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# fixed values: the base rules
NAMES = "password passwd secret token api_?key".split()
ASSIGN = re.compile("(" + "|".join(map(either, NAMES)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs of 24 and more
LEAST = {"assign": 6, "access": 20}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by start, then kind as listed."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


def versions(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, blob) of each row."""
    return docs.select(key, F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))


def scan_blobs(docs: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION, scan: int = 0) -> DataFrame:
    """New ledger rows (blob, rule_version, scan, findings): one for each blob the ledger has not under this rule version."""
    text = F.coalesce("text", F.lit(""))
    blobs = docs.select(F.sha2(text, 256).alias("blob"), text.alias("text"))
    blobs = blobs.dropDuplicates(["blob"])  # map-side first, so copies of a hot text meet before the exchange
    if ledger is not None:  # the same exchange serves both
        blobs = blobs.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in base_spans(t)] for t in batch["text"]]
            yield pd.DataFrame({"blob": batch["blob"], "rule_version": rule_version, "scan": scan, "findings": found})

    return blobs.mapInPandas(run, LEDGER)


def join_back(docs: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION, key: str = "doc_id") -> DataFrame:
    """(key, blob, scan, findings) of each row of docs: the scan that read its blob, and what it found."""
    own = ledger.where(F.col("rule_version") == rule_version).select("blob", "scan", "findings")
    return versions(docs, key).join(own, "blob", "left").select(key, "blob", "scan", "findings")


def there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(blob, rule_version, scan, findings) of the ledger at path, empty where there is none yet; scans that raced left equal findings."""
    rows = spark.read.schema(LEDGER).parquet(path) if there(spark, path) else spark.createDataFrame([], LEDGER)
    return rows.groupBy("blob", "rule_version").agg(F.min("scan").alias("scan"), F.first("findings").alias("findings"))


def scan_to_ledger(docs: DataFrame, path: str, rule_version: str = RULE_VERSION, scan: int = 0) -> DataFrame:
    """Scans the blobs that the ledger at path lacks, appends them, and returns the ledger as it is then."""
    spark = docs.sparkSession
    known = read_ledger(spark, path) if there(spark, path) else None
    scan_blobs(docs, known, rule_version, scan).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def scan_history(history: DataFrame, path: str, commits: list[int], rule_version: str = RULE_VERSION) -> DataFrame:
    """(path, blob, findings, reused) and all columns but text of each row of history (path, commit, text, ...).

    The commits, in rising order, are scanned one after another, each against what the ledger at `path` holds by then;
    reused tells whether the ledger had the row's blob before its commit was scanned.
    """
    for c in commits:
        ledger = scan_to_ledger(history.where(F.col("commit") == c), path, rule_version, c)
    own = ledger.where(F.col("rule_version") == rule_version).select("blob", "scan", "findings")
    rows = history.withColumn("blob", F.sha2(F.coalesce("text", F.lit("")), 256)).drop("text")
    return rows.join(own, "blob", "left").withColumn("reused", F.col("scan") < F.col("commit")).drop("scan")


def digest(found: DataFrame, key: str = "doc_id", *more: str) -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans as text."""
    spans = F.array_join(
        F.transform("findings", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(key, *map(count, KINDS), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"), *more)


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """Each found span, merged where they overlap, as [kind]."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(found, key=lambda x: x[1:]):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(b, merged[-1][2])
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def committed(docs: DataFrame, commits: int = 2, key: str = "doc_id") -> DataFrame:
    """A history (path, commit, key, text) of documents: each is a file below its source, set by one of so many commits."""
    number = F.col(key).cast("string")
    return docs.select(
        F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce(number, F.lit("-"))).alias("path"),
        (F.pmod(F.xxhash64(number, F.lit("commit")), F.lit(commits)) + 1).alias("commit"), key, "text",
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of its own on the shared folder, filled by two commits that together hold every document."""
    found = scan_history(committed(table(spark, sf_dir, "documents")), f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}", [1, 2])
    return digest(found, "doc_id", "path", "blob", "commit", "reused")
