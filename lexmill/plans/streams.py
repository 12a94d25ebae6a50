"""Windows over events and file streams (ST*, W14, A4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexmill.plans.registry import query, table
from lexmill.sources.shared import shared_dir
from lexmill.streaming import ingest, limits


@query("st4_w14_rate_limit", "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW) <= 2 AND count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '86399.999999 seconds' PRECEDING AND CURRENT ROW) <= 5 AS allowed FROM events")
def st4(s, d):
    rows = table(s, d, "events").select("event_id", "user_id", "ts")
    return ingest.rate_limited(rows, "user_id", "ts", {3600: 2, 86400: 5}).select("event_id", "user_id", "allowed")


@query("st5_auth_limit", "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '899.999999 seconds' PRECEDING AND CURRENT ROW) <= 1 AS allowed FROM events WHERE event_type = 'signup'")
def st5(s, d):
    rows = table(s, d, "events").where("event_type = 'signup'").select("event_id", "user_id", "ts")
    return ingest.rate_limited(rows, "user_id", "ts", {900: 1}).select("event_id", "user_id", "allowed")


@query("st6_lockout", "WITH e AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events WHERE event_type IN ('error', 'signup')) SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts RANGE BETWEEN INTERVAL '172799.999999 seconds' PRECEDING AND CURRENT ROW) AS BIGINT) AS failures FROM e")
def st6(s, d):
    rows = table(s, d, "events").where("event_type in ('error', 'signup')").withColumn("failed", F.col("event_type") == "error")
    return ingest.lockouts(rows, "user_id", "ts", "failed", 2, 172800).select("event_id", "user_id", "failures")


@query("st7_sessions", "WITH e AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 24 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM g GROUP BY user_id, s")
def st7(s, d):
    return ingest.sessions(table(s, d, "events"), "user_id", "ts")


@query("st1_stream_ingest_counts", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def st1(s, d):
    """Events come in as a file stream into a table in the shared folder, which is then counted."""
    folder = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    rows = table(s, d, "events")
    rows.repartition(8).write.parquet(f"{folder}/in")
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    ingest.ingest(s, f"{folder}/in", schema, f"{folder}/out", f"{folder}/checkpoint", 3)
    got = s.read.parquet(f"{folder}/out")
    return got.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))



SLICES = 3


def sliced(s, rows, order):
    """rows in SLICES parts by rising order, as streams read them: each time the earlier ones are there, too."""
    first, last = rows.agg(F.min(order), F.max(order)).first()
    step = None if first is None else (last - first) / SLICES
    folder = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    for k in range(SLICES):
        lower = F.lit(True) if k == 0 or step is None else F.col(order) >= F.lit(first + k * step)
        upper = F.lit(True) if k == SLICES - 1 or step is None else F.col(order) < F.lit(first + (k + 1) * step)
        rows.where(lower & upper).write.mode("append").parquet(f"{folder}/in")
        yield s.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/state"


def limit_stream(s, rows, rule, value=None):
    """The rule's decisions of each row; every part is a query of its own that goes on from the state before."""
    for stream, out, state in sliced(s, rows, "ts"):
        limits.drain(limits.limited(stream, rule, "user_id", "ts", "event_id", value), out, state)
    return s.read.parquet(out)


#: Counts and ends of two windows, renewed by every request that passes; a fold over each user's requests.
COUNTERS = """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (
  SELECT user_id, n, event_id, true AS ok, 1 AS h, t + 3600000000 AS he, 1 AS d, t + 86400000000 AS de FROM e WHERE n = 1
  UNION ALL
  SELECT user_id, n, event_id, ok, h + ok::INT, CASE WHEN ok THEN t + 3600000000 ELSE he END, d + ok::INT, CASE WHEN ok THEN t + 86400000000 ELSE de END
  FROM (SELECT *, h < 2 AND d < 5 AS ok FROM (
    SELECT e.user_id, e.n, e.event_id, e.t, CASE WHEN f.he <= e.t THEN 0 ELSE f.h END AS h, CASE WHEN f.de <= e.t THEN 0 ELSE f.d END AS d, f.he, f.de FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)))
SELECT event_id, user_id, ok AS allowed, CASE WHEN ok THEN least(2 - h, 5 - d) ELSE 0 END AS number FROM f
"""


@query("st4_limit_stream", COUNTERS)
def st4_stream(s, d):
    """All events as requests under an hourly and a daily limit."""
    return limit_stream(s, table(s, d, "events"), limits.Counters({3600: 2, 86400: 5}))


@query("st5_auth_stream", """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'signup'),
f AS (
  SELECT user_id, n, event_id, true AS ok, [t] AS log FROM e WHERE n = 1
  UNION ALL
  SELECT user_id, n, event_id, len(kept) < 2, CASE WHEN len(kept) < 2 THEN list_append(kept, t) ELSE kept END
  FROM (SELECT e.user_id, e.n, e.event_id, e.t, list_filter(f.log, lambda x: e.t - x < 259200000000) AS kept FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
SELECT event_id, user_id, ok AS allowed, CASE WHEN ok THEN 2 - len(log) ELSE 0 END AS number FROM f
""")
def st5_stream(s, d):
    """Sign-ups under a limit of two in three days, by a log of those that passed."""
    return limit_stream(s, table(s, d, "events").where("event_type = 'signup'"), limits.Log({259200: 2}))


@query("st6_lockout_stream", "WITH e AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events WHERE event_type IN ('error', 'signup')), f AS (SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts RANGE BETWEEN INTERVAL '172799.999999 seconds' PRECEDING AND CURRENT ROW) AS BIGINT) AS number FROM e) SELECT event_id, user_id, number < 2 AS allowed, number FROM f")
def st6_stream(s, d):
    """Errors as failures, sign-ups as successes that clear them."""
    rows = table(s, d, "events").where("event_type in ('error', 'signup')")
    return limit_stream(s, rows, limits.Lockout(2, 172800), F.col("event_type") == "error")


@query("st7_session_stream", "WITH e AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 24 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM g GROUP BY user_id, s")
def st7_stream(s, d):
    """Sessions of all events; two rows without a user, far later, move the watermark past the last sessions' ends."""
    rows = table(s, d, "events").select("event_id", "user_id", "ts")
    for stream, out, state in sliced(s, rows, "ts"):
        limits.drain(ingest.session_counts(stream, "user_id", "ts"), out, state)
    for days in (30, 60):
        beat = rows.agg((F.max("ts") + F.expr(f"interval {days} days")).alias("ts")).select(F.lit(None).cast("long").alias("event_id"), F.lit(None).cast(rows.schema["user_id"].dataType).alias("user_id"), "ts")
        beat.write.mode("append").parquet(out.removesuffix("out") + "in")
        limits.drain(ingest.session_counts(stream, "user_id", "ts"), out, state)
    return s.read.parquet(out).where("user_id is not null").withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


@query("st10_context_swap", "SELECT conv_id, count(*) AS n_history, max(turn) FILTER (role = 'user') AS context_turn, arg_max(length(text), turn) FILTER (role = 'user') AS context_chars FROM conversations GROUP BY conv_id")
def st10(s, d):
    """The history of each conversation grows (bucket A), its context is the last question (bucket B), batch by batch."""
    where = f"{shared_dir(s)}/buckets-{uuid.uuid4().hex}"
    for stream, _, state in sliced(s, table(s, d, "conversations"), "turn"):
        query_ = stream.writeStream.foreachBatch(lambda batch, k: ingest.swap_context(batch, k, where, "conv_id", "turn", F.col("role") == "user"))
        query_.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    history, context = ingest.buckets(s, where)
    n = history.groupBy("conv_id").agg(F.count("*").alias("n_history"))
    return n.join(context.select("conv_id", F.col("turn").alias("context_turn"), F.length("text").alias("context_chars")), "conv_id", "left")
