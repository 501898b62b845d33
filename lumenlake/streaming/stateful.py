"""Streams with state and timers of their own, in RocksDB: debounced scans, and offline detection that pauses a job.

State is kept by key and survives restarts with the checkpoint; its schemas may gain fields. An event-time timer ends what waits for silence, so
the watermark decides when a key that has gone quiet is reported.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenlake.streaming.events import FAILURES, FLUSH, GAP_SECONDS, WAIT_SECONDS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Jobs that a lost library cancels, as they begin anew when it is back; any other is paused.
CANCELLED = ("THUMBNAILS", "METADATA")


def use_rocksdb(spark: SparkSession) -> None:
    """State stores of queries that start from now on; state is larger than memory then, and timers need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Debounce(StatefulProcessor):
    """A flush when gap seconds pass without an event, or longest seconds after the first that waits."""

    def __init__(self, gap: float, longest: float) -> None:
        self.gap, self.longest = gap, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "first double, last double, n long, timer long")

    def _due(self, first: float, last: float) -> tuple[float, str]:
        quiet, cap = last + self.gap, first + self.longest
        return (quiet, "quiet") if quiet <= cap else (cap, "wait")

    def _flush(self, key: tuple, first: float, last: float, n: int) -> Row:
        at, reason = self._due(first, last)
        return Row(key=key[0], first_at=first, fired_at=at, n=n, reason=reason)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        first, last, n, timer = self.waiting.get() or (0.0, 0.0, 0, -1)
        for at in sorted(r["at"] for r in rows):
            if n and at >= self._due(first, last)[0]:
                yield self._flush(key, first, last, n)
                n = 0
            first, last, n = (at, at, 1) if not n else (first, max(last, at), n + 1)
        due = max(int(self._due(first, last)[0] * 1_000), timerValues.getCurrentWatermarkInMs() + 1)
        if due != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.waiting.update((first, last, n, due))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        if waiting := self.waiting.get():
            self.waiting.clear()
            yield self._flush(key, *waiting[:3])

    def close(self) -> None:
        pass


def debounced(events: DataFrame, key: str, ts: str = "ts", gap: float = GAP_SECONDS, longest: float = WAIT_SECONDS) -> DataFrame:
    """key, first_at, fired_at, n and reason (quiet or wait) of each flush; events need a watermark on ts.

    Only a micro-batch's times of a key are held at once. Events behind the watermark are dropped, and those without a key or time; ties wait together.
    Rows reach Python as rows: a data frame for each key and each flush costs more than the debounce.
    """
    use_rocksdb(events.sparkSession)
    timed = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(ts).cast("double").alias("at"), F.col(ts))
    return timed.groupBy("key").transformWithState(Debounce(gap, longest), FLUSH, "Append", "EventTime")


def pauses(previous: Column, failures: Column, job: Column, least: int = FAILURES) -> Column:
    """Whether a failed check pauses the active job: not if the library was offline already, at the first failure, or without a job."""
    return ~previous.eqNullSafe("offline") & (failures >= least) & job.isNotNull()


CHANGE = "key string, at double, status string, action string, job long"


class Monitor(StatefulProcessor):
    """A library's status by its checks: offline after least failures in a row, until one succeeds."""

    def __init__(self, least: int) -> None:
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "status string, failures int")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        status, failures = self.state.get() or ("unconfigured", 0)
        for row in sorted(rows, key=lambda r: (r["at"] is None, r["at"] or 0.0, r["nth"] is None, r["nth"] or 0)):  # nulls last
            if row["online"]:
                if status == "offline":
                    yield Row(key=key[0], at=row["at"], status="online", action="scan", job=None)
                status, failures = "online", 0
                continue
            failures += 1
            if status != "offline" and failures >= self.least:
                job = row["job"]
                action = None if job is None else "cancel" if row["job_type"] in CANCELLED else "pause"
                yield Row(key=key[0], at=row["at"], status="offline", action=action, job=job)
                status = "offline"
        self.state.update((status, failures))

    def close(self) -> None:
        pass


def monitored(checks: DataFrame, key: str, online: str, job: str, job_type: str, ts: str = "ts", nth: str | None = None, failures: int = FAILURES) -> DataFrame:
    """key, at, status (offline, online), action (pause, cancel, scan or none) and job at each change of a library's status.

    A library that goes offline pauses its active job, or cancels one that begins anew anyway; one that is back is scanned. Checks of one
    time follow in the order of nth.
    """
    use_rocksdb(checks.sparkSession)
    order = F.lit(0).cast("long") if nth is None else F.col(nth).cast("long")
    known = checks.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("double").alias("at"), order.alias("nth"), F.col(online).alias("online"), F.col(job).cast("long").alias("job"), F.col(job_type).alias("job_type"))
    return known.groupBy("key").transformWithState(Monitor(failures), CHANGE, "Append", "None")
