"""The corpus pipeline: language ID, near-dedup, decontamination, secret scan, BPE encoding.

Near copies are texts whose five-word shingles are 0.8 alike or more. Covering SimHash and MinHash bands give the
candidates, since a radius that masks can cover spans but the nearest of them; shingles decide.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last
return the columns of documents. Nulls, repeated rows and empty tables go through every stage as its
operator defines.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, fm_index, lang_id, secret_scan, simhash
from lexmill.llm.common import shared_dir, table

#: Below this posterior no language is clearly the best.
LEAST_SCORE = 0.5


def hidden(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...], list]:
    """docs under names that clash with no operator's (text keeps its own), these names, and the columns that restore docs."""
    names = {c: c if c == "text" else f"_c{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(v) for c, v in names.items())), tuple(names.values()), [F.col(v).alias(c) for c, v in names.items()]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text, no letter, or no clearly best one. Learns from the labelled rows."""
    model = lang_id.train(docs.select("doc_id", "text", "lang"))
    rows, carry, back = hidden(docs)
    found = lang_id.predict(rows, model, carry)
    return found.where((F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of near copies, the row with the least doc_id (null is the last; of equal ids the least text hash).

    Rows of equal id and text are copies, too: one of them stays. Rows that share an id but not their text go each its own way.
    """
    texts = simhash.representatives(docs.select("doc_id", "text"))
    # only texts that stand for their group, each with its least id, are joined to the rows, so copies meet nowhere
    keep = texts.where(F.col("node") == F.col("group_node")).select(F.col("id").alias("keep_id"), F.col("node").alias("keep_node"))
    rows, _, back = hidden(docs)
    key = f"_c{docs.columns.index('doc_id')}"
    rows = rows.withColumn("own_node", simhash.text_hash())
    kept = rows.join(keep, F.col(key).eqNullSafe(F.col("keep_id")) & (F.col("own_node") == F.col("keep_node")), "left_semi")
    return (kept.dropDuplicates([key, "own_node"]) if repeated(rows, key) else kept).select(back)


def repeated(rows: DataFrame, key: str) -> bool:
    n, ids = rows.agg(F.count("*"), F.countDistinct(F.struct(key, "own_node"))).first()
    return n > ids


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents: test words are a twentieth of the words or more. Others stay as they are."""
    rows, carry, back = hidden(docs)
    found = fm_index.find(rows, table(spark, sf_dir, "benchmark"), carry)
    return fm_index.judge(found, carry).where(~F.col("contaminated")).select(back)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by its kind in brackets; n_chars follows the text. All documents stay."""
    path = f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"
    ledger = secret_scan.scan_to_ledger(docs, path).where(F.size("findings") > 0)
    rows, _, back = hidden(docs)
    found = rows.withColumn("own_blob", F.sha2(F.coalesce("text", F.lit("")), 256)).join(ledger.select(F.col("blob").alias("own_blob"), "findings"), "own_blob", "left")

    @F.pandas_udf("string")
    def redact(text: pd.Series, findings: pd.Series) -> pd.Series:
        return pd.Series([secret_scan.redact(t, [(x["kind"], x["start"], x["end"]) for x in f]) for t, f in zip(text, findings, strict=True)], dtype=object)

    size = f"_c{docs.columns.index('n_chars')}" if "n_chars" in docs.columns else None
    hit = found.where("findings is not null").withColumn("text", redact("text", "findings"))
    hit = hit.withColumn(size, F.char_length("text").cast(docs.schema["n_chars"].dataType)) if size else hit
    return found.where("findings is null").select(back).unionByName(hit.select(back))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): the byte-level BPE ids of each text and the digests of its round trip."""
    return bpe.encode(docs)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secret_scan", secrets),
    ("byte_bpe", encode),
]
#: SQL cannot express code lengths, SimHash components and BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written as Parquet to the shared folder and read again."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


