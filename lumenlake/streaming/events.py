"""Streams of change events: filtering, bursts by session, debounce with a longest wait, offline detection, append-only feeds.

Event-time watermarks bound the state, which is an extension: a library that only counts in memory has none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GAP_SECONDS, WAIT_SECONDS, BURST, FAILURES = 2.0, 15.0, 200, 2


def read_events(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def timed(events: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The events with a timestamp that a watermark may follow."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def without_own(events: DataFrame, path: Column, own_folder: str) -> DataFrame:
    """Events but for those in the library's own folder."""
    return events.where(~((path == own_folder) | path.startswith(f"{own_folder}/")))


def sessions(events: DataFrame, key: str, gap: str = "2 seconds", ts: str = "ts", burst: int = BURST) -> DataFrame:
    """Sessions by gap and key, with their counts, and whether they reach a burst. Runs on batches and streams alike."""
    by = events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return by.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", (F.col("n") >= burst).alias("burst"))


FLUSH = "key string, first_at double, fired_at double, n long, reason string"


def _fire(key: str, first: float, at: float, n: int, reason: str) -> pd.DataFrame:
    return pd.DataFrame({"key": [key], "first_at": [first], "fired_at": [at], "n": [n], "reason": [reason]})


def debounce(events: DataFrame, key: str, ts: str = "ts", gap: float = GAP_SECONDS, longest: float = WAIT_SECONDS) -> DataFrame:
    """Flushes per key: once gap seconds pass without an event, or longest seconds after the first that waits.

    The state is the first and last time and the count of what waits; a timer in event time ends a quiet key.
    """

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name = str(keys[0])
        first, last, n = state.get if state.exists else (0.0, 0.0, 0)
        out = []
        if state.hasTimedOut:
            state.remove()
            yield _fire(name, first, min(last + gap, first + longest), n, "quiet" if last + gap <= first + longest else "wait")
            return
        for at in sorted(t for pdf in batches for t in pdf["at"]):
            if n and at >= min(last + gap, first + longest):
                out.append(_fire(name, first, min(last + gap, first + longest), n, "quiet" if last + gap <= first + longest else "wait"))
                n = 0
            first, last, n = (at if not n else first), max(at, last if n else at), n + 1
        state.update((first, last, n))
        due = int(min(last + gap, first + longest) * 1000)
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield from out

    keyed = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("double").alias("at"), F.col(ts))
    return keyed.groupBy("key").applyInPandasWithState(run, FLUSH, "first double, last double, n long", "append", GroupStateTimeout.EventTimeTimeout)


def offline(checks: DataFrame, key: str, online: str, ts: str = "ts", failures: int = FAILURES) -> DataFrame:
    """A report when a key has failed failures times in a row, once until it is back."""

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (run_length,) = state.get if state.exists else (0,)
        out = []
        for row in pd.concat(list(batches)).sort_values("at").itertuples():
            run_length = 0 if row.online else run_length + 1
            if run_length == failures:
                out.append(pd.DataFrame({"key": [str(keys[0])], "at": [row.at]}))
        state.update((run_length,))
        yield from out

    keyed = checks.select(F.col(key).cast("string").alias("key"), F.col(online).alias("online"), F.col(ts).cast("double").alias("at"))
    return keyed.groupBy("key").applyInPandasWithState(run, "key string, at double", "run int", "append", GroupStateTimeout.NoTimeout)


def catch_ups(changes: DataFrame, scans: DataFrame, key: str, ts: str = "ts", begin: str = "began_at", end: str = "ended_at") -> DataFrame:
    """For each full scan during which something changed: one catch-up, due at the scan's end, with the number of changes it stands for.

    An equi-join on the library's key; its scans, which are few, meet its changes by time. In a stream, micro-batches do as much by themselves:
    what arrives while one runs waits for the next.
    """
    during = (F.col(ts) >= F.col(begin)) & (F.col(ts) < F.col(end))
    met = changes.select(key, ts).join(scans.select(key, begin, end), key).where(during)
    return met.groupBy(key, begin, F.col(end).alias("due_at")).agg(F.count(F.lit(1)).alias("n"))


def at_once(changes: DataFrame, scans: DataFrame, key: str, ts: str = "ts", begin: str = "began_at", end: str = "ended_at") -> DataFrame:
    """The changes that no full scan holds up."""
    s = scans.select(F.col(key).alias("__k"), begin, end)
    return changes.join(s, (F.col(key) == F.col("__k")) & (F.col(ts) >= F.col(begin)) & (F.col(ts) < F.col(end)), "left_anti")


def sweep(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str = "300 seconds"):  # noqa: ANN201
    """work(rows, number) at fixed intervals, on what arrived since the last time; the checkpoint remembers what was done."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def append_feed(events: DataFrame, folder: str, checkpoint: str):  # noqa: ANN201
    """All events at hand, appended to a Parquet feed; what was appended before is not read again."""
    return events.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def to_table(stream: DataFrame, name: str, checkpoint: str | None = None):  # noqa: ANN201
    """All events at hand, into a table in memory; for tests."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def rolling_rate(events: DataFrame, key: str, order: list[str], ts: str = "ts", rows: int = 2_000) -> DataFrame:
    """Events a second over the last rows events of each key; null where they share one time. The order begins with the time.

    As times rise, a window's least is its first: a look back instead of a minimum over rows events for each event.
    """
    by = Window.partitionBy(key).orderBy(*order)
    at = F.col(ts).cast("timestamp").cast("double")
    first = F.coalesce(F.lag(at, rows - 1).over(by), F.first(at).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.least(F.row_number().over(by), F.lit(rows)).cast("long")
    return events.withColumn("seconds", F.round(at - first, 3)).withColumn("in_window", n).withColumn("rate", F.when(F.col("seconds") > 0, F.round(F.col("in_window") / F.col("seconds"), 6)))
