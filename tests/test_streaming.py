"""Streams: sessions, debounce with a longest wait, offline reports, append-only feeds."""

from __future__ import annotations

import datetime as dt
import itertools

import pytest
from lumenlake.streaming import events

NAMES = (f"stream_{i}" for i in itertools.count())
START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def write(spark, folder, rows: list[tuple], schema: str) -> None:
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def collected(spark, stream, tmp_path) -> list:
    name = next(NAMES)
    q = events.to_table(stream, name, f"{tmp_path}/{name}")
    q.awaitTermination(120)
    if q.exception():
        raise q.exception()
    return spark.table(name).collect()


def at(seconds: float) -> dt.datetime:
    return START + dt.timedelta(seconds=seconds)


SCHEMA = "path string, ts timestamp"
FAR = ("end", at(10_000_000))


def flushes(times: list[float], gap: float = events.GAP_SECONDS, longest: float = events.WAIT_SECONDS) -> list[tuple]:
    """(first, fired, n) by definition."""
    out, waiting = [], []
    for t in sorted(times):
        if waiting and t >= min(waiting[-1] + gap, waiting[0] + longest):
            out.append((waiting[0], min(waiting[-1] + gap, waiting[0] + longest), len(waiting)))
            waiting = []
        waiting.append(t)
    return [*out, (waiting[0], min(waiting[-1] + gap, waiting[0] + longest), len(waiting))]


@pytest.mark.parametrize("times", [[0, 1, 2, 10], [0, 1.9, 3.9, 5.8], [i * 1.5 for i in range(40)], [5]])
def test_debounce_fires_after_quiet_or_the_longest_wait(spark, tmp_path, times):
    folder = tmp_path / "in"
    half = len(times) // 2
    for part in (times[:half], times[half:]):
        if part:
            write(spark, folder, [("a", at(t)) for t in part], SCHEMA)
    write(spark, folder, [FAR], SCHEMA)
    write(spark, folder, [("end", at(10_000_001))], SCHEMA)
    stream = events.timed(events.read_events(spark, str(folder), SCHEMA), late="1 hour")
    rows = collected(spark, events.debounce(stream, "path"), tmp_path)
    zero = START.timestamp()
    found = sorted((round(r["first_at"] - zero, 3), round(r["fired_at"] - zero, 3), r["n"]) for r in rows if r["key"] == "a")
    assert found == [tuple(round(x, 3) for x in f) for f in flushes(times)]


def test_sessions_in_a_stream_equal_those_in_a_batch(spark, tmp_path):
    folder = tmp_path / "in"
    rows = [(f"u{i % 3}", at((i * 37) % 500)) for i in range(200)]
    write(spark, folder, rows[:90], SCHEMA)
    write(spark, folder, rows[90:], SCHEMA)
    write(spark, folder, [FAR], SCHEMA)
    batch = events.sessions(spark.createDataFrame(rows, SCHEMA), "path", "5 seconds", burst=4)
    stream = events.sessions(events.timed(events.read_events(spark, str(folder), SCHEMA)), "path", "5 seconds", burst=4)
    assert sorted(map(str, collected(spark, stream, tmp_path))) == sorted(map(str, batch.collect()))


def test_bursts_at_the_edge(spark):
    rows = [(k, at(i * 0.01)) for k, n in (("x", 199), ("y", 200), ("z", 201)) for i in range(n)]
    found = {r["path"]: r["burst"] for r in events.sessions(spark.createDataFrame(rows, SCHEMA), "path").collect()}
    assert found == {"x": False, "y": True, "z": True}


def test_own_folder_is_left_out(spark):
    df = spark.createDataFrame([("lib/.app", at(0)), ("lib/.app/x", at(0)), ("lib/.apple", at(0))], SCHEMA)
    assert [r["path"] for r in events.without_own(df, df["path"], "lib/.app").collect()] == ["lib/.apple"]


@pytest.mark.parametrize(("online", "reports"), [("1", 0), ("10", 0), ("101", 0), ("100", 1), ("1000", 1), ("1001001", 2), ("00", 1)])
def test_offline_after_two_failures_once(spark, tmp_path, online, reports):
    folder, schema = tmp_path / "in", "host string, ts timestamp, online boolean"
    for i, c in enumerate(online):
        write(spark, folder, [("h", at(i), c == "1")], schema)
    rows = collected(spark, events.offline(events.read_events(spark, str(folder), schema), "host", "online"), tmp_path)
    assert len(rows) == reports


def test_feed_appends_once(spark, tmp_path):
    source, feed, mark = tmp_path / "in", str(tmp_path / "feed"), str(tmp_path / "mark")
    for n in (3, 5):
        write(spark, source, [(str(i), at(i)) for i in range(n)], SCHEMA)
        events.append_feed(events.read_events(spark, str(source), SCHEMA), feed, mark).awaitTermination(60)
    assert spark.read.parquet(feed).count() == 8


def test_rolling_rate(spark):
    df = spark.createDataFrame([("a", at(i), i) for i in range(5)], "path string, ts timestamp, n int")
    rows = events.rolling_rate(df, "path", ["ts", "n"], rows=3).orderBy("n").collect()
    assert [(r["in_window"], r["seconds"], r["rate"]) for r in rows] == [(1, 0.0, None), (2, 1.0, 2.0), (3, 2.0, 1.5), (3, 2.0, 1.5), (3, 2.0, 1.5)]


def test_sweeps_do_what_arrived(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    spark.range(3).write.parquet(folder)
    stream = spark.readStream.schema("id long").parquet(folder)
    running = events.sweep(stream, lambda rows, n: seen.append(rows.count()), str(tmp_path / "c"), "1 second")
    running.processAllAvailable()
    spark.range(2).write.mode("append").parquet(folder)
    running.processAllAvailable()
    running.stop()
    assert sum(seen) == 5 and len(seen) >= 2
