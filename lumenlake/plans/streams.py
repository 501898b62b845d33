"""Queries that run as streams over all events at hand, with state in RocksDB, beside their SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenlake.plans.registry import query
from lumenlake.sources.adapters import table
from lumenlake.sources.scratch import run_now, working_folder
from lumenlake.streaming import events as streams
from lumenlake.streaming import stateful


def _events(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")  # a pattern may name a file, where a stream's path has to be a folder


def _time(seconds: str) -> Column:
    return F.timestamp_micros(F.round(F.col(seconds) * 1_000_000).cast("long")).cast("timestamp_ntz")


GAP, LONGEST = 6 * 3_600, 24 * 3_600


@query(f"""WITH RECURSIVE e AS (SELECT user_id, ts AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
w AS (SELECT user_id, i, t AS first, t AS last, 1::BIGINT AS n, NULL::TIMESTAMP AS out_first, NULL::TIMESTAMP AS out_last, NULL::BIGINT AS out_n FROM e WHERE i = 1
    UNION ALL SELECT e.user_id, e.i, CASE WHEN f THEN t ELSE first END, t, CASE WHEN f THEN 1 ELSE n + 1 END, CASE WHEN f THEN first END, CASE WHEN f THEN last END, CASE WHEN f THEN n END
    FROM (SELECT e.*, w.first, w.last, w.n, e.t >= least(w.last + INTERVAL {GAP} SECOND, w.first + INTERVAL {LONGEST} SECOND) AS f FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1) e),
o AS (SELECT user_id, out_first AS first, out_last AS last, out_n AS n FROM w WHERE out_n IS NOT NULL
    UNION ALL SELECT user_id, first, last, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS back FROM w) WHERE back = 1 AND least(last + INTERVAL {GAP} SECOND, first + INTERVAL {LONGEST} SECOND) <= (SELECT max(ts) FROM events))
SELECT user_id::VARCHAR AS user_id, first AS first_at, least(last + INTERVAL {GAP} SECOND, first + INTERVAL {LONGEST} SECOND) AS fired_at, n, CASE WHEN last + INTERVAL {GAP} SECOND <= first + INTERVAL {LONGEST} SECOND THEN 'quiet' ELSE 'wait' END AS reason FROM o""")
def debounced_scans(spark, d):
    """Scans after six quiet hours or a day of waiting, for each user's changes; what still waits at the last event is not told."""
    changes = streams.timed(_events(spark, d), late="0 seconds")
    out = run_now(stateful.debounced(changes, "user_id", gap=GAP, longest=LONGEST), working_folder(spark, "debounced"))
    return out.select(F.col("key").alias("user_id"), _time("first_at").alias("first_at"), _time("fired_at").alias("fired_at"), "n", "reason")


@query("""WITH f AS (SELECT *, event_type = 'error' OR value < 20 AS failed FROM events),
r AS (SELECT *, count(*) FILTER (WHERE NOT failed) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f),
n AS (SELECT *, count(*) FILTER (WHERE failed) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS nth, CASE WHEN event_id % 3 <> 0 THEN event_id END AS job FROM r),
last AS (SELECT user_id, run, max(nth) AS failures FROM n GROUP BY ALL)
SELECT user_id::VARCHAR AS user_id, ts AS at, 'offline' AS status, CASE WHEN job IS NULL THEN NULL WHEN event_id % 4 = 0 THEN 'cancel' ELSE 'pause' END AS action, job FROM n WHERE failed AND nth = 2
UNION ALL SELECT n.user_id::VARCHAR, ts, 'online', 'scan', NULL FROM n JOIN last ON last.user_id = n.user_id AND last.run = n.run - 1 WHERE NOT failed AND failures >= 2""")
def library_monitor(spark, d):
    """Events as checks of each user's library: what goes offline pauses or cancels the job that runs, what is back is scanned."""
    k = F.col("event_id")
    checks = _events(spark, d).withColumns({"ts": F.col("ts").cast("timestamp"), "online": ~((F.col("event_type") == "error") | (F.col("value") < 20)), "job": F.when(k % 3 != 0, k), "job_type": F.when(k % 4 == 0, "THUMBNAILS").otherwise("SCAN")})
    out = run_now(stateful.monitored(checks, "user_id", "online", "job", "job_type", nth="event_id"), working_folder(spark, "monitor"))
    return out.select(F.col("key").alias("user_id"), _time("at").alias("at"), "status", "action", "job")
