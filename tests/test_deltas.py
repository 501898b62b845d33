"""Upserts as deltas against a merge in Python, in one table and from a stream that crashes."""

from __future__ import annotations

import random

import pytest
from lumenlake.sources.deltas import UpsertTable

ROWS = "path string, id long, size long, thumb string"


def table(spark, folder, name: str, rows: list[tuple]) -> UpsertTable:
    found = UpsertTable(spark, str(folder), name, "path", ["size"], ("thumb",), buckets=4)
    found.create(spark.createDataFrame(rows, ROWS))
    return found


def rows_of(df) -> list[tuple]:
    return sorted(tuple(r[c] for c in ("path", "id", "size", "thumb")) for r in df.collect())


def applied(known: dict, changes: list[tuple]) -> None:
    """(path, size, thumb, deleted) rows of one version: deletions first, then the greatest values."""
    for path in {c[0] for c in changes if c[0] is not None}:
        own = [c for c in changes if c[0] == path]
        if any(c[3] for c in own):
            known.pop(path, None)
        sets = sorted(((c[1] is not None, c[1] or 0), (c[2] is not None, c[2] or ""), c[1], c[2]) for c in own if not c[3])
        if sets:
            *_, size, thumb = sets[-1]
            old = known.get(path, (None, None, None))
            known[path] = (old[0], size, thumb if thumb is not None else old[2])


CHANGES = "path string, size long, thumb string, deleted boolean"


def test_versions_equal_a_merge(spark, tmp_path):
    rng = random.Random(1)
    base = [(f"p{i}", i, i * 10, f"t{i}" if i % 3 else None) for i in range(60)]
    found, known = table(spark, tmp_path / "t", "deltas_a", base), {p: (i, s, t) for p, i, s, t in base}
    for version in range(1, 7):
        changes = [(rng.choice([f"p{rng.randrange(90)}", None]) if rng.random() < 0.1 else f"p{rng.randrange(90)}", rng.choice([None, rng.randrange(99)]), rng.choice([None, None, f"n{version}"]), rng.random() < 0.25) for _ in range(25)]
        assert found.upsert(spark.createDataFrame(changes, CHANGES), version, "deleted")
        applied(known, changes)
        assert rows_of(found.read()) == sorted((p, *v) for p, v in known.items())
        if version == 4:
            found.compact()
            assert found.versions() == (4, [])
            assert not found.upsert(spark.createDataFrame(changes, CHANGES), 4, "deleted")
    assert rows_of(found.read()) == sorted((p, *v) for p, v in known.items())
    found.delete(spark.createDataFrame([("p1",), ("p2",)], "path string"), 9)
    assert {"p1", "p2"}.isdisjoint(r[0] for r in rows_of(found.read()))


def test_only_deltas_are_shuffled(spark, tmp_path):
    found = table(spark, tmp_path / "t", "deltas_b", [(f"p{i}", i, i, None) for i in range(50)])
    found.upsert(spark.createDataFrame([("p1", 5, None, False)], CHANGES), 1, "deleted")
    plan = found.read()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_a_version_that_was_cut_short_is_unseen(spark, tmp_path):
    found = table(spark, tmp_path / "t", "deltas_c", [("a", 1, 1, None)])
    spark.createDataFrame([("a", (9, None), False)], "path string, row struct<size:long,thumb:string>, deleted boolean").write.parquet(f"{tmp_path}/t/delta-1")
    assert rows_of(found.read()) == [("a", 1, 1, None)]
    found.upsert(spark.createDataFrame([("a", 2, "x", False)], CHANGES), 1)
    assert rows_of(found.read()) == [("a", 1, 2, "x")]


def test_another_session_finds_the_table(spark, tmp_path):
    found = table(spark, tmp_path / "t", "deltas_d", [("a", 1, 1, None)])
    spark.sql("DROP TABLE deltas_d_0")
    assert rows_of(UpsertTable(spark, str(tmp_path / "t"), "deltas_d", "path", ["size"], ("thumb",), buckets=4).read()) == [("a", 1, 1, None)]
    assert found.versions() == (0, [])


def test_a_stream_that_crashes_changes_nothing_twice(spark, tmp_path):
    """The second batch is written, and its stream dies before it is committed; the next run does it again."""
    found, source = table(spark, tmp_path / "t", "deltas_e", [("a", 1, 1, "t"), ("b", 2, 2, None)]), str(tmp_path / "in")
    for some in ([("a", 5, None, False), ("c", 6, "u", False)], [("b", None, None, True), ("a", 7, None, False)]):
        spark.createDataFrame(some, CHANGES).coalesce(1).write.mode("append").parquet(source)

    def stream():
        return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(source)

    class Crashing(UpsertTable):
        def _take(self, rows, batch, deleted):
            super()._take(rows, batch, deleted)
            if batch == 1:
                raise RuntimeError("lost")

    crashing = Crashing(spark, str(tmp_path / "t"), "deltas_e", "path", ["size"], ("thumb",), buckets=4)
    with pytest.raises(Exception, match="lost"):
        crashing.take_stream(stream(), str(tmp_path / "c"), "deleted", every=None).awaitTermination()
    wanted = [("a", 1, 7, "t"), ("c", None, 6, "u")]
    assert rows_of(found.read()) == wanted
    found.take_stream(stream(), str(tmp_path / "c"), "deleted", every=None).awaitTermination()
    assert rows_of(found.read()) == wanted and found.versions() == (0, [1, 2])
    found.compact()
    spark.createDataFrame([("b", 3, None, False)], CHANGES).coalesce(1).write.mode("append").parquet(source)
    running = found.take_stream(stream(), str(tmp_path / "c"), "deleted")
    running.processAllAvailable()
    running.stop()
    assert rows_of(found.read()) == [*wanted[:1], ("b", None, 3, None), *wanted[1:]]
