"""Near duplicates against exact Jaccard similarities of all pairs."""

from __future__ import annotations

import random

import pytest
from lumenlake.llm import common, neardup
from lumenlake.llm.components import components


def shingles(text: str | None) -> frozenset:
    words = neardup_words(text)
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def neardup_words(text: str | None) -> list[str]:
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [w for w in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]


def brute(rows: list[tuple]) -> list[tuple]:
    """(doc_id, class_id, n_links) of every row."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and (rows[i][1] == rows[j][1] or len(a & b) >= 0.8 * len(a | b) - 1e-9):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    groups: dict[int, list] = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in groups.items()}
    return sorted(((rows[i][0], least[root(i)], links[i]) for i in range(len(rows))), key=str)


def near_texts(seed: int, bases: int = 12) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows: list[tuple] = [(9_000, None), (9_001, ""), (9_002, " \n"), (9_003, "short"), (9_004, "Short"), (9_005, "one two"), (None, "one two"), (9_006, None)]
    n = 0
    for _ in range(bases):
        base = rng.choices(words, k=rng.choice([6, 40, 120, 300]))
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            text = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((n, " ".join(text)))
            n += 1
    return rows + [(0, rows[8][1]), (n, rows[9][1].upper())]


@pytest.mark.parametrize("unit", [1_024, 3])
def test_classes_and_links_equal_brute_force(spark, monkeypatch, unit):
    monkeypatch.setattr(neardup, "UNIT", unit)
    rows = near_texts(unit)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, rep int")
    found = neardup.near_duplicates(docs).select("doc_id", "class_id", "n_links").collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows)


def test_large_groups_of_near_copies_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(neardup, "UNIT", 16)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(150):
        text = base[:]
        text[rng.randrange(400)] = f"v{i}"
        rows.append((i, " ".join(text)))
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["class_id"], r["n_links"]) for r in found} == {(0, 149)}


def test_keep_one_of_each_class(spark):
    rows = near_texts(5)
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, gone_id long")
    kept = neardup.keep_one(docs)
    assert kept.schema == docs.schema
    classes = {}
    for doc_id, class_id, links in brute(rows):
        if links == 0:
            classes[doc_id, "alone"] = doc_id
        else:
            classes[class_id] = class_id
    found = [r["doc_id"] for r in kept.collect()]
    # Rows without words stand alone; a class is kept as its row of the smallest id.
    assert sorted(x for x in found if x is not None) == sorted(set(classes.values()) - {None})
    assert {9_000, 9_001, 9_002, 9_006} <= set(found)


def test_equal_rows_without_ids_leave_one(spark):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (None, "other words of its own here"), (1, None), (1, None), (2, "x y z"), (2, "x y z"), (3, "x y z")]
    kept = [tuple(r) for r in neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept, key=str) == sorted([rows[0], rows[2], (1, None), (1, None), (2, "x y z")], key=str)


def test_shuffled_where_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    rows = near_texts(8, bases=6)
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id", "n_links").collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(docs).count() == neardup.keep_one(docs).count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    least = dict(neardup.least_matches())
    assert all(least[n] < 0.8 * n for n in least) and least[neardup.HASHES] > 0.3 * neardup.HASHES
    assert neardup.expected_miss() < 5e-6


def test_very_long_texts(spark):
    long = " ".join(f"t{i % 99_991}" for i in range(300_000))
    rows = [(1, long), (2, long + " more"), (3, "other text entirely with words")]
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: (1, 1), 2: (1, 1), 3: (3, 0)}


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1_000 + i, 1_001 + i) for i in range(64)] + [(5, 5)]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            hi, lo = sorted((root(a), root(b)), reverse=True)
            parent[hi] = lo
    found = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in parent}
