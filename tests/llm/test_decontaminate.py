"""Containment search against brute force."""

from __future__ import annotations

import math
import random
import re

from lumenlake.llm import common, decontaminate


def words_of(text: str | None) -> list[str]:
    return [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]


def shingles(words: list[str]) -> set[str]:
    """Runs of five words; fewer words are one shingle."""
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def leaks(docs, items) -> set[tuple]:
    out = set()
    known = [(i, shingles(words_of(t))) for i, t in items]
    for d, text in docs:
        words = words_of(text)
        line = f" {' '.join(words)} "
        held = shingles(words) if len(words) >= 5 else set()
        for i, own in known:
            shared = sum(s in held if s.count(" ") == 4 else f" {s} " in line for s in own)
            if own and shared >= math.ceil(len(own) * 0.8 - 1e-9):
                out.add((d, i, shared, len(own)))
    return out


def corpus(seed: int):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Über", "naïve"]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 4, 5, 6, 9, 20, 64])))) for i in range(40)] + [(100, None), (101, "")]
    docs = []
    for d in range(150):
        body = rng.choices(words, k=rng.choice([0, 4, 30, 400]))
        if rng.random() < 0.7:
            item = rng.choice(items)[1]
            passage = (item or "").split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                if passage:
                    passage[rng.randrange(len(passage))] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = passage
        docs.append((d, ", ".join(body).upper() if rng.random() < 0.3 else " ".join(body)))
    return docs, items


def test_no_pair_is_lost_or_made_up(spark):
    docs, items = corpus(4)
    docs += [(500, None), (501, ""), (502, " ".join(["filler"] * 200_000) + " " + items[5][1])]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, hash string, item long")
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, size int")
    found = {(r["doc_id"], r["item_id"], r["shared"], r["item_shingles"]) for r in decontaminate.find_leaks(d, b).collect()}
    assert found == leaks(docs, items) and len(found) > 30
    kept = decontaminate.drop_leaks(d, b)
    assert kept.schema == d.schema
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {x[0] for x in found}


def test_shuffled_where_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    docs, items = corpus(9)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["shared"], r["item_shingles"]) for r in decontaminate.find_leaks(d, b).collect()} == leaks(docs, items)


def test_repeated_null_and_empty_tables(spark):
    item = "one two three four five six seven"
    rows = [(1, f"x {item} y"), (1, f"x {item} y"), (None, f"z {item}"), (2, "other words that match nothing at all"), (3, "It was too — SHORT!"), (4, "too shortly")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(7, item), (7, item), (8, "too short")], "item_id long, text string")
    assert sorted((r["doc_id"] or 0, r["item_id"], r["shared"]) for r in decontaminate.find_leaks(d, b).collect()) == [(0, 7, 3), (1, 7, 3), (3, 8, 1)]
    assert [r["doc_id"] for r in decontaminate.drop_leaks(d, b).collect()] == [2, 4]
    assert decontaminate.find_leaks(d.limit(0), b).count() == decontaminate.find_leaks(d, b.limit(0)).count() == 0
    leaked = spark.createDataFrame([(1, f"x {item}", 5)], "doc_id long, text string, leaked long")
    assert decontaminate.drop_leaks(leaked, b).count() == 0


def test_no_python_runs_in_the_plan(spark):
    d, b = spark.createDataFrame([(1, "x")], "doc_id long, text string"), spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert not re.search("Python|Pandas|Arrow", decontaminate.find_leaks(d, b)._jdf.queryExecution().executedPlan().toString())
