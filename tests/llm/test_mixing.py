"""Mixing against its definition: targets, epochs, keys, cuts."""

from __future__ import annotations

import random
import re
from fractions import Fraction

import pytest
from lumenlake.llm import mixing
from pyspark.sql import functions as F


def test_targets_share_the_budget():
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    assert mixing.targets([100]) == [150]
    found = mixing.targets([10, 1_000, 500])
    assert found[0] == 20 and found[1] + found[2] == 2_265 - 20 and found[1] * 2 == found[2] if found[2] < 1_000 else found[2] == 1_000
    for sizes in ([5, 70, 900, 3, 0, 12], [1] * 9, [1_000, 1]):
        got = mixing.targets(sizes)
        assert all(0 <= t <= 2 * s for t, s in zip(got, sizes)) and sum(got) == sum(sizes) * Fraction(3, 2)


def corpus(seed: int, n: int = 400) -> list[tuple]:
    rng = random.Random(seed)
    sources = ["hot"] * 6 + ["b", "c", "ü", None]
    rows: list[tuple] = [(i, rng.choice(["a b", "one", "", None, " x\ty\n z ", "w " * rng.randint(1, 200)]), rng.choice(sources)) for i in range(n)]
    return [*rows, rows[3], (None, "null id", "b"), (None, None, None), (n, "", "empty source"), (n + 1, "z " * 50_000, "c")]


@pytest.mark.parametrize(("few", "bins"), [(1_000, 1_024), (7, 4)])
def test_each_source_gives_its_target(spark, monkeypatch, few, bins):
    monkeypatch.setattr(mixing, "SORTED_ROWS", few)
    monkeypatch.setattr(mixing, "BINS", bins)
    rows = corpus(few)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, rest int, size int")
    quality = spark.createDataFrame([(i, 2.0 if i % 3 else 0.5) for i in range(0, 300, 2)], "doc_id long, weight double")
    found = mixing.mix(docs, ["doc_id", "source"], quality=quality).collect()
    assert len(found) == len(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r["size"] for r in found) == sorted(words(t) for _, t, _ in rows)
    by: dict = {}
    for r in found:
        by.setdefault(r["source"], []).append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in by[s]) for s in order]
    for source, size, target in zip(order, sizes, mixing.targets(sizes)):
        assert {(r["source_size"], round(r["target"], 6)) for r in by[source]} == {(size, round(float(target), 6))}
        assert sum(r["taken"] for r in by[source]) == round(target)
        epochs = int(target // size) if size else 0
        # Complete epochs first; then whole documents by key, and one cut at most.
        extra = [r["taken"] - epochs * r["size"] for r in by[source]]
        assert all(0 <= x <= r["size"] for x, r in zip(extra, by[source]))
        assert sum(0 < x < r["size"] for x, r in zip(extra, by[source])) <= 1
        assert all(r["taken"] <= 2 * r["size"] for r in by[source])
    again = mixing.mix(docs.repartition(5), ["doc_id", "source"], quality=quality).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_documents_are_drawn_in_the_order_of_their_keys(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SORTED_ROWS", 5)
    monkeypatch.setattr(mixing, "BINS", 3)
    import math

    docs = spark.createDataFrame([(i, "a b c", "s" if i % 4 else "t") for i in range(200)], "doc_id long, text string, source string")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(mixing.SEED), "doc_id", "text"), 11).cast("double") + 0.5) / float(1 << 53)
    keys = {r["doc_id"]: -math.log(r["u"]) for r in docs.select("doc_id", u.alias("u")).collect()}
    found = mixing.mix(docs, ["doc_id", "source"]).collect()
    for source in ("s", "t"):
        own = sorted((r for r in found if r["source"] == source), key=lambda r: keys[r["doc_id"]])
        least = min(r["taken"] for r in own) // 3 * 3
        extra = [r["taken"] - least for r in own]
        assert extra == sorted(extra, reverse=True)


def test_equal_rows_share_the_cut(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "s")] * 7, "doc_id long, text string, source string")
    found = mixing.mix(docs, ["doc_id"]).collect()
    # 52.5 words are wanted of 35: an epoch, and 18 words that seven equal rows share.
    assert {r["taken"] for r in found} == {5 + 18 // 7}


def test_better_documents_are_taken_more_often(spark):
    docs = spark.createDataFrame([(i, "a b c d", "one") for i in range(4_000)], "doc_id long, text string, source string")
    quality = spark.createDataFrame([(i, 4.0 if i % 4 < 2 else 0.25) for i in range(4_000)], "doc_id long, weight double")
    by = mixing.mix(docs, ["doc_id"], quality=quality).groupBy((F.col("doc_id") % 4 < 2).alias("good")).agg(F.sum("taken").alias("n")).collect()
    n = {r["good"]: r["n"] for r in by}
    assert n[True] > 1.2 * n[False]


def test_kept_columns_give_way_to_the_result(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 77, "x")], "doc_id long, text string, source string, size int, __id string")
    out = mixing.mix(docs, docs.columns)
    assert out.columns == ["doc_id", "text", "source", "__id", "size", "source_size", "target", "taken"]
    assert tuple(out.first()) == (1, "a b", "s", "x", 2, 2, 3.0, 3)


def test_empty_table_and_null_quality(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs, ["doc_id"]).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    assert sorted(tuple(r) for r in mixing.quality_weights(labels).collect()) == [(1, 2.0), (2, 0.5)]


def test_weights_move_keys_and_shuffles_change_nothing(spark, monkeypatch):
    import math

    from lumenlake.llm import common

    rows = [(i if i % 5 else None, f"a b c {i}", "st"[i % 4 == 0]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {i: 3.0 if i % 2 else 0.25 for i in range(0, 200, 3)}
    quality = spark.createDataFrame(list(weights.items()), "doc_id long, weight double")
    found = sorted(map(tuple, mixing.mix(docs, ["doc_id", "text", "source"], quality=quality).collect()), key=str)
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, mixing.mix(docs, ["doc_id", "text", "source"], quality=quality).collect()), key=str) == found
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(mixing.SEED), "doc_id", "text"), 11).cast("double") + 0.5) / float(1 << 53)
    keys = {r["text"]: -math.log(r["u"]) / weights.get(r["doc_id"], 1.0) for r in docs.select("doc_id", "text", u.alias("u")).collect()}
    for source in "st":
        own = sorted((r for r in found if r[2] == source), key=lambda r: keys[r[1]])
        extra = [taken - taken // size * size if taken % size else taken // size for _, _, _, size, _, _, taken in own]
        whole = [taken // size for _, _, _, size, _, _, taken in own]
        assert whole == sorted(whole, reverse=True) and sum(0 < x < 4 and t % s > 0 for x, (_, _, _, s, _, _, t) in zip(extra, own)) <= 1
