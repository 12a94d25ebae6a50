"""Pluggable encoders, loaded once a worker (R16, V5), and runs over what is not encoded yet (K3, K9)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lexmill.sources.shared import there

#: What an encoder gives for each text: a dense vector and the weights of its tokens.
Encoded = tuple[list[float], dict[str, float]]
Encoder = Callable[[list[str]], list[Encoded]]


def isolated(encoder: Encoder, texts: list[str]) -> Iterator[tuple[list[float] | None, dict[str, float] | None, str | None]]:
    """(dense, sparse, error) of each text; a batch that fails is taken one by one, so only the texts at fault have an error."""
    try:
        yield from ((*x, None) for x in encoder(texts))
    except Exception as error:  # whatever an encoder raises concerns its texts
        if len(texts) == 1:
            yield None, None, f"{type(error).__name__}: {error}"[:500]
        else:
            for t in texts:
                yield from isolated(encoder, [t])


#: Characters of texts whose results a worker holds at a time, whatever an Arrow batch holds.
HELD = 1 << 20


def slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(start, end) of successive texts of at most HELD characters in all, one text at least."""
    start = held = 0
    for at, size in enumerate(sizes):
        if at > start and held + size > HELD:
            yield start, at
            start, held = at, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def encode(rows: DataFrame, load: Callable[[], Encoder], key: str = "id", body: str = "text", size: int = 32) -> DataFrame:
    """(key, dense, sparse, error) of each row: load() makes the encoder in each worker, which gets batches of `size` whole texts.

    What an encoder can't read of a long text is its own affair. Null texts are encoded as empty. A text that the encoder
    fails on has nulls and the error; the others of its batch are not affected.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load()
        for batch in batches:
            texts = [t or "" for t in batch[body]]
            for start, end in slices([len(t) for t in texts]):
                out = [x for at in range(start, end, size) for x in isolated(encoder, texts[at : min(at + size, end)])]
                made = pd.DataFrame(out, columns=["dense", "sparse", "error"])
                made.insert(0, key, batch[key].iloc[start:end].to_numpy())
                yield made

    return rows.select(key, body).mapInPandas(run, f"`{key}` {kind}, dense array<float>, sparse map<string,float>, error string")


def processed(rows: DataFrame, load: Callable[[], Encoder], path: str, key: str = "id", body: str = "text", least: int = 0) -> dict[str, int]:
    """K3/K9: encodes the rows that the table at path has not yet, appends them, and returns how many were embedded, skipped and failed.

    The table is the checkpoint: rows that were written before, failed ones included, and texts under `least` characters
    are skipped. A run that was stopped has written whole files or none, so the next one goes on where it ended.
    """
    spark = rows.sparkSession
    total = Observation()
    rows = rows.observe(total, F.count("*").alias("rows"))
    pending = rows.where(F.coalesce(F.length(body), F.lit(0)) >= least)
    if there(spark, path):
        pending = pending.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    seen = Observation()
    told = encode(pending, load, key, body).observe(seen, F.count_if(F.col("error").isNull()).alias("embedded"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    told.withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("error")).write.mode("append").partitionBy("status").parquet(path)
    counts = {k: int(v or 0) for k, v in seen.get.items()}
    return {**counts, "skipped": int(total.get["rows"]) - sum(counts.values())}


def hashed(dims: int = 64) -> Callable[[], Encoder]:
    """The default encoder: unit vectors of signed word hashes, and the words' frequencies."""

    def load():
        import hashlib
        import math
        import re
        from collections import Counter

        def one(text: str) -> Encoded:
            out = [0.0] * dims
            for w in text.lower().split():
                h = int.from_bytes(hashlib.md5(w.encode("utf-8", "surrogatepass")).digest()[:8], "little")
                out[h % dims] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in out)) or 1.0
            return [x / norm for x in out], {t: float(n) for t, n in Counter(re.findall(r"\w+", text.lower())).items()}

        return lambda texts: [one(t) for t in texts]

    return load
