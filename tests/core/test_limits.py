"""Limits as stream state: rules by hand, restarts, late rows, and state that goes away."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lexmill.streaming import ingest, limits

SCHEMA = "event_id long, u string, ts timestamp, failed boolean"


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def plain(rule, rows):
    """The rule over all rows of each key in order, without a stream."""
    state, out = {}, {}
    for i, u, ts, failed in sorted(rows, key=lambda r: (r[2], r[0])):
        t = int((ts - dt.datetime(1970, 1, 1)).total_seconds()) * limits.MICROS
        state[u], allowed, number = rule.take(state.get(u, rule.fresh()), t, failed)
        out[i] = (u, allowed, number)
    return out


def test_rules():
    c = limits.Counters({10: 2, 100: 3})
    s, got = c.fresh(), []
    for t in (0, 1, 9, 10, 11, 20, 109, 111, 211):
        s, ok, left = c.take(s, t * limits.MICROS, True)
        got.append((ok, left))
    # a hit renews both ends: at 10 the short window lasts until 11, at 11 it is over, the long one until 111
    assert got == [(True, 1), (True, 0), (False, 0), (False, 0), (True, 0), (False, 0), (False, 0), (True, 1), (True, 1)]
    log, s, got = limits.Log({10: 2}), [], []
    for t in (0, 5, 9, 10, 15):
        s, ok, _ = log.take(s, t * limits.MICROS, True)
        got.append(ok)
    assert got == [True, True, False, True, True]
    lock, s, got = limits.Lockout(3, 100), [], []
    for t, failed in ((0, True), (1, True), (2, True), (3, False), (4, True), (103, True), (104, True)):
        s, ok, n = lock.take(s, t * limits.MICROS, failed)
        got.append((ok, n))
    assert got == [(True, 1), (True, 2), (False, 3), (True, 0), (True, 1), (True, 2), (True, 2)]


def slices(rng, n, keys):
    times = sorted(rng.randint(0, 50_000) for _ in range(n))
    rows = [(i, rng.choice(keys), at(t), rng.random() < 0.7) for i, t in enumerate(times)]
    return [rows[k : k + n // 4] for k in range(0, n, n // 4)]


@pytest.mark.parametrize("rule", [limits.Counters({600: 2, 3600: 4}), limits.Log({900: 2, 7200: 5}), limits.Lockout(3, 3600)])
def test_stream_with_restarts(spark, tmp_path, rule):
    parts = slices(random.Random(3), 240, ["a", "b", "hot", "hot", "hot", None])
    source, sink, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    progress = []
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        progress += limits.drain(limits.limited(stream, rule, "u", "ts", "event_id", F.col("failed"), "0 seconds"), sink, checkpoint)  # each is a new query
    got = {r.event_id: (r.u, r.allowed, r.number) for r in spark.read.parquet(sink).collect()}
    want = plain(rule, [r for p in parts for r in p])
    # the first row of a later slice may fall on the watermark itself; no other is late
    late = sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"])
    assert len(want) - len(got) == late == 0 and got == want


def test_state_goes_away_and_late_rows_are_counted(spark, tmp_path):
    rule = limits.Counters({10: 2})
    source, sink, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    told = []
    for rows in ([(k, f"u{k}", at(k), True) for k in range(40)], [(100, "x", at(9000), True)], [(101, "x", at(20000), True), (102, "u1", at(0), True)], [(103, "y", at(20001), True)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        told += limits.drain(limits.limited(spark.readStream.schema(SCHEMA).parquet(source), rule, "u", "ts", "event_id", None, "0 seconds"), sink, checkpoint)
    operators = [p["stateOperators"][0] for p in told if p["stateOperators"]]
    assert operators[-1]["numRowsTotal"] < 10  # forty keys have gone by their timers
    assert sum(o["numRowsDroppedByWatermark"] for o in operators) == 1
    assert 102 not in {r.event_id for r in spark.read.parquet(sink).collect()}


def test_sessions_on_a_stream(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice("abc"), at(t), True) for i, t in enumerate(sorted(rng.sample(range(100_000), 90)))]
    source, sink, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    told = []
    late = [(900, "a", at(0), True), (901, "zz", at(1), True)]
    beats = [[(1000 + k, None, at(10**6 + 10**5 * k), True)] for k in range(2)]  # close what is open
    for part in (rows[:30], rows[30:60], rows[60:], late, *beats):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = ingest.session_counts(spark.readStream.schema(SCHEMA).parquet(source), "u", "ts", "3000 seconds", "0 seconds")
        told += limits.drain(stream, sink, checkpoint)
    got = sorted((r.u, r.session_start, r.n) for r in spark.read.parquet(sink).where("u is not null").collect())
    want = ingest.sessions(spark.createDataFrame(rows, SCHEMA), "u", "ts", "3000 seconds").collect()
    assert got == sorted((r.u, r.session_start, r.n) for r in want)
    assert sum(o["numRowsDroppedByWatermark"] for p in told for o in p["stateOperators"]) == len(late)


def test_context_buckets_repeat(spark, tmp_path):
    schema = "conv long, turn long, role string, text string"
    batches = [[(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c"), (3, 0, "assistant", "z")], [(1, 2, "user", "d"), (2, 1, "user", None)], [(1, 1, "user", "older")]]
    where = f"file://{tmp_path}/buckets"
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema)
        for _ in range(2):  # a batch may come again after a failure
            ingest.swap_context(df, k, where, "conv", "turn", F.col("role") == "user")
    history, context = ingest.buckets(spark, where)
    assert history.count() == 7
    assert sorted((r.conv, r.turn, r.text) for r in context.collect()) == [(1, 2, "d"), (2, 1, None)]
    ingest.swap_context(df, 1, where, "conv", "turn", F.col("role") == "user")  # an older batch again changes nothing that is newer
    assert {r.turn for r in ingest.buckets(spark, where)[1].collect()} == {2, 1}


def test_limiter_takes_rows():
    """A pandas frame for each key and batch cost more than the rule itself; rows come in any order, ids may be null."""
    from types import SimpleNamespace as Plain

    held = []
    limiter = limits.Limiter(limits.Log({10: 1}))
    limiter.handle = Plain(registerTimer=held.append, deleteTimer=held.remove)
    limiter.state = Plain(get=lambda: None, update=held.append)
    rows = [Plain(id=i, t=t * limits.MICROS, value=True) for i, t in ((3, 20), (None, 0), (1, 0))]
    assert [tuple(r) for r in limiter.handleInputRows(("u",), iter(rows), None)] == [("u", 1, True, 0), ("u", None, False, 0), ("u", 3, True, 0)]
    assert held == [30_001, ([20 * limits.MICROS], 30_001)]
