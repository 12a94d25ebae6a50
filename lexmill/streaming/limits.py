"""Limits as state of a stream (ST4, ST5, ST6): counters that expire, sliding logs, lockouts that a success clears.

A key's state is one value: numbers for a counter, the times that still count for a log or a lockout, so it is bounded by
the limits, not by the history. A timer at the end of the longest window clears it. Within a micro-batch a key's rows are
taken in the order of (time, id); the batch (its number of files) bounds how many that are. A null key is a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
MICROS = 1_000_000


class Counters:
    """ST4's main rule: a count and an end for each window (seconds: most); each recorded request renews the ends.

    A request passes if every count is below its limit; only requests that pass are recorded.
    """

    def __init__(self, limits: dict[int, int]):
        self.limits = list(limits.items())

    def fresh(self) -> list[int]:
        return [0, 0] * len(self.limits)

    def take(self, state: list[int], t: int, value: bool) -> tuple[list[int], bool, int]:
        """(state, allowed, remaining) after a request at t."""
        counts = [0 if state[2 * k + 1] <= t else state[2 * k] for k in range(len(self.limits))]
        left = min(most - n for n, (_, most) in zip(counts, self.limits, strict=True))
        if left <= 0:
            return [x for k, n in enumerate(counts) for x in (n, state[2 * k + 1])], False, 0
        return [x for n, (seconds, _) in zip(counts, self.limits, strict=True) for x in (n + 1, t + seconds * MICROS)], True, left - 1

    def end(self, state: list[int]) -> int:
        """When nothing of the state counts any more."""
        return max(state[1::2])


class Log:
    """ST4's fallback, ST5: the times of recorded requests; a window counts those less than its seconds ago."""

    def __init__(self, limits: dict[int, int]):
        self.limits, self.longest = list(limits.items()), max(limits) * MICROS

    def fresh(self) -> list[int]:
        return []

    def take(self, state: list[int], t: int, value: bool) -> tuple[list[int], bool, int]:
        kept = [x for x in state if t - x < self.longest]
        left = min(most - sum(t - x < seconds * MICROS for x in kept) for seconds, most in self.limits)
        return (kept, False, 0) if left <= 0 else ([*kept, t], True, left - 1)

    def end(self, state: list[int]) -> int:
        return max(state, default=0) + self.longest


class Lockout:
    """ST6: failures (value is true) of the last seconds since the last success; `most` of them lock the key, a success clears them."""

    def __init__(self, most: int = 5, seconds: int = 900):
        self.most, self.longest = most, seconds * MICROS

    def fresh(self) -> list[int]:
        return []

    def take(self, state: list[int], t: int, value: bool) -> tuple[list[int], bool, int]:
        """(state, allowed, failures): while locked, failures go on being counted, the newest `most` of them being kept."""
        kept = [*(x for x in state if t - x < self.longest), t] if value else []
        return kept, len(kept) < self.most, len(kept)

    def end(self, state: list[int]) -> int:
        return max(state, default=0) + self.longest


class Limiter(StatefulProcessor):
    """Runs a rule over each key's rows (id, t, value)."""

    def __init__(self, rule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("numbers", "numbers array<long>, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        own = sorted(rows, key=lambda r: (r.t, r.id is None, 0 if r.id is None else r.id))
        state, timer = (list(x[0]), x[1]) if (x := self.state.get()) else (self.rule.fresh(), None)
        out = []
        for r in own:
            state, allowed, number = self.rule.take(state, r.t, bool(r.value))
            out.append(Row(key=key[0], id=r.id, allowed=allowed, number=number))
        due = self.rule.end(state) // 1000 + 1  # timers are milliseconds
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)
        self.state.update((state, due))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def limited(stream: DataFrame, rule, key: str, time: str, ident: str, value=None, late: str = "1 hour") -> DataFrame:
    """(key, ident, allowed, number) of each row of a stream; rows later than the watermark are dropped (they are counted in its progress)."""
    kind = dict(stream.dtypes)
    at = F.col(time).cast("timestamp")
    rows = stream.select(F.col(key).alias("key"), F.col(ident).alias("id"), at.alias("_time"), F.unix_micros(at).alias("t"), (F.lit(True) if value is None else value).alias("value"))
    schema = f"key {kind[key]}, id {kind[ident]}, allowed boolean, number long"
    told = rows.withWatermark("_time", late).groupBy("key").transformWithState(Limiter(rule), schema, "append", "eventtime")
    return told.select(F.col("key").alias(key), F.col("id").alias(ident), "allowed", "number")


@contextmanager
def rocks(spark: SparkSession):
    """State with timers needs this state store."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if old is None else spark.conf.set(PROVIDER, old)


def drain(stream: DataFrame, sink: str, checkpoint: str) -> list[dict]:
    """Runs the stream over all that is there, to Parquet, and returns its progress; a later call goes on at the checkpoint."""
    with rocks(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return list(query.recentProgress)
