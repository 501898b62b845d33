"""Streams in RocksDB state: the same flushes and pauses as by definition, across restarts."""

from __future__ import annotations

import pytest
from lumenlake.sources.scratch import run_now
from lumenlake.streaming import events, stateful
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_streaming import FAR, SCHEMA, START, at, flushes, write


@pytest.mark.parametrize("times", [[0, 1, 2, 10], [i * 1.5 for i in range(40)], [5, 5, 6.5, 30]])
def test_debounce_goes_on_from_its_checkpoint(spark, tmp_path, times):
    """Each part is a run of its own, which ends and starts again from the checkpoint."""
    folder, half = tmp_path / "in", len(times) // 2
    for part in (times[:half], times[half:], []):
        rows = [("a", at(t)) for t in part] if part else [FAR, ("end", at(10_000_001))]
        write(spark, folder, rows, SCHEMA)
        stream = events.timed(events.read_events(spark, str(folder), SCHEMA), late="1 hour")
        out = run_now(stateful.debounced(stream, "path"), str(tmp_path / "out"))
    zero = START.timestamp()
    found = sorted((round(r["first_at"] - zero, 3), round(r["fired_at"] - zero, 3), r["n"]) for r in out.collect() if r["key"] == "a")
    assert found == [tuple(round(x, 3) for x in f) for f in flushes(times)]


def test_what_has_no_key_or_time_waits_for_nothing(spark, tmp_path):
    folder = tmp_path / "in"
    write(spark, folder, [("a", at(0)), ("a", None), (None, at(0)), (None, at(100)), ("a", at(1)), FAR, ("end", at(10_000_001))], SCHEMA)
    out = run_now(stateful.debounced(events.timed(events.read_events(spark, str(folder), SCHEMA), late="1 hour"), "path"), str(tmp_path / "out"))
    zero = START.timestamp()
    assert [(r["key"], r["first_at"] - zero, r["n"]) for r in out.collect() if r["key"] != FAR[0]] == [("a", 0, 2)]


class Kept:
    """One value of state; timers come to nothing."""

    value = None

    def get(self):
        return self.value

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def registerTimer(self, at):  # noqa: N802
        pass

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 0


def test_rows_and_flushes_are_no_data_frames(spark):
    """A frame for each of a key's flushes took ten times as long as the rest."""
    stream, kept = stateful.Debounce(2.0, 15.0), Kept()
    stream.init(kept)
    told = list(stream.handleInputRows(("a",), iter([Row(key="a", at=10.0 * i) for i in range(1_000)]), kept))
    assert [tuple(r) for r in told] == [("a", 10.0 * i, 10.0 * i + 2, 1, "quiet") for i in range(999)] and kept.value[:3] == (9_990.0, 9_990.0, 1)
    checks, kept = stateful.Monitor(2), Kept()
    checks.init(kept)
    rows = [Row(key="h", at=t, nth=0, online=ok, job=job, job_type="SCAN") for t, ok, job in ((None, True, 7), (3.0, False, 7), (2.0, False, None), (1.0, True, 7))]
    assert [tuple(r) for r in checks.handleInputRows(("h",), iter(rows), kept)] == [("h", 3.0, "offline", "pause", 7), ("h", None, "online", "scan", None)]


@pytest.mark.parametrize(
    ("previous", "failures", "job", "paused"),
    [("online", 1, 42, False), ("offline", 1, 42, False), ("unconfigured", 1, 42, False), ("online", 2, 42, True), ("online", 3, 99, True), ("online", 2, None, False), ("online", 1, None, False), ("unconfigured", 2, 42, True), ("offline", 2, 42, False), ("offline", 10, 42, False), (None, 2, 42, True)],
)
def test_what_pauses_a_job(spark, previous, failures, job, paused):
    df = spark.createDataFrame([(previous, failures, job)], "previous string, failures int, job long")
    assert df.select(stateful.pauses(F.col("previous"), F.col("failures"), F.col("job"))).first()[0] is paused


CHECKS = "host string, ts timestamp, online boolean, job long, job_type string"


def test_a_lost_library_pauses_its_job_once_across_restarts(spark, tmp_path):
    folder = tmp_path / "in"
    checks = [
        [("h", at(0), True, 7, "SCAN"), ("h", at(1), False, 7, "SCAN"), ("g", at(0), False, None, None)],
        [("h", at(2), False, 7, "SCAN"), ("h", at(3), False, 7, "SCAN"), ("g", at(2), True, None, None), ("g", at(3), False, 8, "METADATA")],
        [("h", at(4), True, None, None), ("g", at(4), False, 8, "METADATA"), ("h", at(5), False, None, None), ("h", at(6), False, None, None)],
    ]
    for rows in checks:
        write(spark, folder, rows, CHECKS)
        out = run_now(stateful.monitored(events.read_events(spark, str(folder), CHECKS), "host", "online", "job", "job_type"), str(tmp_path / "out"))
    zero = START.timestamp()
    found = sorted((r["key"], r["at"] - zero, r["status"], r["action"], r["job"]) for r in out.collect())
    assert found == [("g", 4, "offline", "cancel", 8), ("h", 2, "offline", "pause", 7), ("h", 4, "online", "scan", None), ("h", 6, "offline", None, None)]
