"""Folder digests, near places, JSON, whole-table places, trigrams and free names against definitions."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest
from lumenlake.operators import grams, jobs, observed, planning, props, ranked, reconcile, related
from pyspark.sql import functions as F

FILES = "relative_path string, size_bytes long, quick_fingerprint string, modified_at long"


def snapshots(spark, seed: int):
    rng = random.Random(seed)
    paths = [f"{rng.choice(['', 'a/', 'a/b/', 'c/', 'c/d/', 'e/', 'e/f/g/'])}f{i}" for i in range(120)]
    before = [(p, rng.randrange(9), f"m{i}", 1) for i, p in enumerate(paths)]
    now = []
    for p, size, mark, at in before:
        if p.startswith(("a/", "c/d")) and rng.random() < 0.3:
            what = rng.choice(["gone", "touched", "moved"])
            if what == "touched":
                now.append((p, size + 1, mark, 2))
            elif what == "moved":
                now.append((f"new/{p.replace('/', '-')}", size, mark, at))
            continue
        now.append((p, size, mark, at))
    return spark.createDataFrame(now, FILES), spark.createDataFrame(before, FILES)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reconciling_changed_folders_equals_reconciling_all(spark, seed):
    now, before = snapshots(spark, seed)
    rows = lambda df: sorted(map(str, df.collect()))
    kept = reconcile.folder_digests(before)
    assert rows(reconcile.reconcile_changed(now, before)) == rows(reconcile.reconcile(now, before)) == rows(reconcile.reconcile_changed(now, before, kept))
    assert rows(reconcile.reconcile_changed(now, before, root="a")) == rows(reconcile.reconcile(now, before, root="a"))
    with pytest.raises(ValueError, match="full"):
        reconcile.reconcile_changed(now, before, full=True)


def test_equal_trees_are_the_highest(spark):
    now, before = snapshots(spark, 1)
    digests = [{r["folder"]: (r["files"], r["digest"]) for r in reconcile.tree_digests(reconcile.folder_digests(x)).collect()} for x in (now, before)]
    same = {f for f, d in digests[0].items() if digests[1].get(f) == d}
    highest = {f for f in same if f == "" or (f.rpartition("/")[0] if "/" in f else "") not in same}
    found = reconcile.equal_trees(*(reconcile.tree_digests(reconcile.folder_digests(x)) for x in (now, before)))
    assert {r["folder"] for r in found.collect()} == highest and "e" in highest and "a" not in same
    one = reconcile.tree_digests(reconcile.folder_digests(now))
    assert [r["folder"] for r in reconcile.equal_trees(one, one).collect()] == [""]
    assert digests[0][""][0] == now.count()


def test_near_places(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, round(rng.uniform(-0.3, 0.3), 2)]), round(rng.uniform(-0.3, 0.3), 2)) for i in range(150)] + [(200 + i, 0.1, 0.1) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double").select("id", *[F.col(c).cast("decimal(12,6)").alias(c) for c in ("lat", "lon")])
    cents = [(i, None if a is None else round(a * 100), round(o * 100)) for i, a, o in rows]
    want = {i: sum(j != i and b is not None and abs(a - b) < 5 and abs(o - p) < 5 for j, b, p in cents) if a is not None else 0 for i, a, o in cents}
    assert {r["id"]: r["near"] for r in related.near_counts(df).collect()} == want


def test_json_of_any_kind(spark):
    rows = [("x", '{"k": 1, "a": [1, {"b": "t"}]}'), ("x", '{"k": "two"}'), ("x", '{"k": 3'), ("x", None), ("y", "[5, null]"), ("y", "7")]
    df = spark.createDataFrame(rows, "kind string, text string")
    assert sorted(map(tuple, props.counted(df, "kind", "text", "$.k").collect())) == [("x", 4, 1, 1, 1, 1), ("y", 2, 0, 0, 0, 0)]
    known = props.parsed(df, "text", "v")
    assert [r[0] for r in known.select(props.prop("v", "$.a[1].b")).collect()] == ["t"] + [None] * 5
    found = props.entries(known, "v").select("text", "pos", "key", props.prop("value", "$").alias("value")).where("text like '[%'").orderBy("pos").collect()
    assert [(r["pos"], r["key"], r["value"]) for r in found] == [(0, None, "5"), (1, None, None)]


@pytest.mark.parametrize("rows", [0, 1, 500])
def test_places_pages_and_neighbours_of_a_whole_table(spark, tmp_path, rows):
    rng = random.Random(5)
    some = [(i, rng.choice([None, *range(40)])) for i in range(rows)]
    df = spark.createDataFrame(some, "id long, at int")
    found = ranked.Ranked(df, [F.desc_nulls_last("at"), F.col("id")], f"{tmp_path}/r", 7)
    want = [i for i, at in sorted(some, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    assert [r["id"] for r in found.places().orderBy("place").collect()] == want
    for number, size in ((1, 20), (3, 70), (8, 70), (2, 500), (99, 10)):
        page = found.page(number, size).orderBy("place").collect()
        assert [r["id"] for r in page] == want[(number - 1) * size : number * size]
        assert [r["place"] for r in page] == list(range((number - 1) * size + 1, (number - 1) * size + 1 + len(page)))
    near = {r["id"]: (r["prev_id"], r["next_id"]) for r in found.neighbours("id").collect()}
    assert near == {i: (want[n - 1] if n else None, want[n + 1] if n + 1 < len(want) else None) for n, i in enumerate(want)}
    plan = found.page(3, 70)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_trigrams_find_what_a_scan_finds(spark, tmp_path):
    texts = ["The Licence", "100% of_it", "ÉTÉ été", "aaaa", "ab", "", None, "abab abc", "x" * 50_000 + "needle", "\U0001f600\U0001f601\U0001f602"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    index = grams.write_index(df, "id", "text", f"{tmp_path}/i", 3)
    for pattern in ("licen", "0% o", "f_i", "été", "aaa", "aaaaa", "ab", "", "abab", "NEEDLE", "\U0001f600\U0001f601\U0001f602", "bac"):
        want = [i for i, t in enumerate(texts) if t is not None and pattern.lower() in t.lower()]
        assert sorted(r["id"] for r in grams.search(df, index, pattern, "id", "text").collect()) == want, pattern
    assert "PushedFilters: [In(gram" in grams.candidates(index, "licence")._jdf.queryExecution().executedPlan().toString()


def test_posting_lists_in_chunks(monkeypatch):
    monkeypatch.setattr(grams, "CHUNK", 5)
    texts = ["abcabc", "", "ab", "\U0001f600b\U0010ffff", "abcdefghijk", "bca", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10, 10 + len(texts)), pa.int64()), pa.array(texts, pa.string())], ["id", "text"])
    parts = [r for b in grams._posted(iter([batch])) for r in b.to_pylist()]
    want = {(t[i : i + 3], at) for at, t in enumerate(texts, 10) if t for i in range(len(t) - 2)}
    assert sorted((r["gram"], i) for r in parts for i in r["ids"]) == sorted(want)


def test_many_patterns_with_one_index(spark, tmp_path):
    """Ids that repeat or are null, characters beyond the first plane; each text is read once for the index."""
    texts = [(1, "abc the Abc"), (1, "ABC"), (1, "bcd"), (None, "xabcx"), (None, None), (2, ""), (3, "ab"), (4, "a\U0001f600b\U0010ffffc%_é"), (5, "ÉTÉ abcd"), (6, "ab bc abd")]
    df, seen = spark.createDataFrame(texts, "id long, text string"), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    index = grams.write_index(df.mapInArrow(counted, df.schema), "id", "text", f"{tmp_path}/i", 3)
    assert seen.value == len(texts)
    patterns = ["abc", "AB", "a\U0001f600b", "\U0010ffffc%", "été", "abcd", "bcd", "zzz", "", "abc"]
    want = sorted(((p, i) for p in patterns for i, t in texts if t is not None and p.lower() in t.lower()), key=repr)
    assert sorted(((r["pattern"], r["id"]) for r in grams.search_all(df, index, patterns, "id", "text").collect()), key=repr) == want
    some = [p for p in patterns if len(p) > 2]
    assert sorted((tuple(r) for r in grams.search_all(df, index, some, "id", "text").collect()), key=repr) == [w for w in want if len(w[0]) > 2]
    for p in patterns:
        assert sorted((r["id"] for r in grams.search(df, index, p, "id", "text").collect()), key=repr) == sorted((i for i, t in texts if t is not None and p.lower() in t.lower()), key=repr), p
    plan = grams.search_all(df, index, some, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan and plan.count("FileScan") == 1


def test_names_as_people_sort_them(spark):
    names = ["b", "a", "B", "Ä", "ä", "A", "z", "é", "E", "a1"]
    df = spark.createDataFrame([(n, n == "z") for n in names], "name string, folder boolean")
    found = [r["name"] for r in df.orderBy(*jobs.folders_first(F.col("folder"), F.col("name"))).collect()]
    assert found == ["z", "a", "A", "ä", "Ä", "a1", "b", "B", "E", "é"]


def free_names(paths: list[str], existing: set[str]) -> list[str]:
    """Each further file of a path takes the path's next number that no name on disk and no first choice has."""
    taken, out, last = existing | set(paths), [], {}
    for p in paths:
        if p not in last and p not in existing:
            last[p] = 0
            out.append(p)
            continue
        stem, ext = re.fullmatch(r"(.*?)((?:\.[^./]*)?)", p).groups()
        n = last.get(p, 0) + 1
        while f"{stem}_{n}{ext}" in taken:
            n += 1
        last[p] = n
        out.append(f"{stem}_{n}{ext}")
    return out


@pytest.mark.parametrize("seed", range(4))
def test_names_made_unique(spark, seed):
    rng = random.Random(seed)
    name = lambda: rng.choice(["d/a.jpg", "d/a.jpg", "d/a_1.jpg", "d/a_2.jpg", "d/a_7.jpg", "d/b", "d/b_1", "d/c.x.y"])
    paths, existing = [name() for _ in range(40)], {name() for _ in range(3)} | {f"d/a_{n}.jpg" for n in rng.sample(range(1, 30), 8)}
    routes = spark.createDataFrame(list(enumerate(paths)), "id long, dest_path string")
    found = planning.renamed(routes, spark.createDataFrame([(e,) for e in existing], "dest_path string"), ["id"]).orderBy("id").collect()
    assert [r["dest_path"] for r in found] == free_names(paths, existing)


def test_a_write_tells_its_numbers(spark, tmp_path):
    now, before = snapshots(spark, 2)
    actions, path = reconcile.reconcile(now, before), f"{tmp_path}/actions"
    told = observed.write_actions(actions, lambda df: df.write.parquet(path), before.count())
    want = {r["action"].lower(): r["count"] for r in spark.read.parquet(path).groupBy("action").count().collect()}
    assert {k: v for k, v in told.items() if k in want} == want and told["live_after"] == told["disk_files"] == now.count()
    with pytest.raises(observed.BrokenInvariant):
        observed.write_actions(actions.where("action <> 'NEW'").limit(50), lambda df: df.write.parquet(f"{tmp_path}/lost"), before.count())
    with pytest.raises(observed.BrokenInvariant):
        observed.write_actions(actions.withColumn("action", F.lit("ODD")), lambda df: df.write.format("noop").mode("overwrite").save(), 0)
    empty = actions.limit(0)
    assert observed.write_actions(empty, lambda df: df.write.format("noop").mode("overwrite").save(), 0)["rows"] == 0


def test_a_listing_tells_what_it_skips(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", "hidden_file"), ("c", "system_file"), ("d", "hidden_file")], "path string, reason string")
    told = observed.write_listing(df, lambda x: x.write.parquet(f"{tmp_path}/l"), "reason", ("hidden_file", "system_file", "other"))
    assert told == {"kept": 1, "hidden_file": 2, "system_file": 1, "other": 0}
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/l").collect()] == [("a",)]
