"""Exact top-k search against all scores."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from lumenlake.llm import knn
from pyspark.sql import functions as F


def brute(rows: list[tuple], k: int, wanted) -> set[tuple]:
    whole = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, v in whole:
        if wanted(i):
            first[i] = min(first.get(i, v), v)
    out = set()
    for q, v in first.items():
        near = lambda x: max(-knn.LARGEST, min(knn.LARGEST, x))
        scores = sorted((-near(sum(a * b for a, b in zip(v, w))), i) for i, w in whole if i != q)[:k]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)}
    return out


def vectors(seed: int, n: int = 300, dim: int = 6) -> list[tuple]:
    rng = random.Random(seed)
    centre = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(5)]
    rows: list[tuple] = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centre)]) for i in range(n)]
    rows += [(n + i, list(rows[7][1])) for i in range(60)]  # ties
    return rows + [(2_000, None), (2_001, [None] + [0.0] * (dim - 1)), (2_020, [math.nan] * dim), (2_040, [math.inf] + [0.0] * (dim - 1)), (None, [1.0] * dim), (2_060, [0.0] * dim)]


@pytest.mark.parametrize(("block", "group"), [(4_096, 512), (8, 3)])
def test_equals_brute_force(spark, monkeypatch, block, group):
    monkeypatch.setattr(knn, "BLOCK_ROWS", block)
    monkeypatch.setattr(knn, "GROUP_QUERIES", group)
    rows = vectors(block)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, cell int, score long")
    found = {tuple(r) for r in knn.top_k(df, F.col("vec_id") % 20 == 0).collect()}
    assert found == brute(rows, 20, lambda i: i % 20 == 0)


@pytest.mark.parametrize("block", [1, 5, 1_000])
def test_bounds_in_blocks_equal_bounds_at_once(monkeypatch, block):
    """Summaries of many rings: the needed ones, whatever number of distances is looked at together."""
    rng = np.random.default_rng(2)
    pivots = rng.integers(-50, 50, (9, 4))
    cells = [{"cell": c, "ring": r, "far": float(rng.uniform(0, 90)), "near": sorted(rng.uniform(0, 60, rng.integers(0, 5)).tolist()) or None} for c in range(9) for r in range(3)]
    queries = rng.integers(-50, 50, (30, 4))
    monkeypatch.setattr(knn, "NEAR_BLOCK", block)
    found = knn.Summaries(pivots, cells, 3)
    norm, to_pivot = np.sqrt((queries**2).sum(1)), queries @ pivots.T
    for i in range(30):
        sure = sorted((to_pivot[i, c] - norm[i] * d for c, d in zip(found.near_cell, found.near)), reverse=True)[3]
        want = {j for j in range(len(found.cell)) if to_pivot[i, found.cell[j]] + norm[i] * found.far[j] >= sure - 1e-6}
        assert {int(b) for a, b in zip(*found.needed(queries[i : i + 1]))} == want


def test_fewer_rows_than_k_and_large_components(spark):
    rows = [(0, [1e9, -3.0]), (1, [2e9, 5.5]), (2, [-1e9, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in knn.top_k(df, F.col("vec_id") % 20 == 0).collect()} == brute(rows, 20, lambda i: i % 20 == 0)


def test_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.5]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(tuple(r) for r in knn.top_k(df, F.col("vec_id") == 0).collect())
    assert [(q, n, s) for q, n, _, s in found] == [(0, 1, 32 * 64 + 32 * 64), (0, 2, 32 * 64 + 32 * 64), (0, 3, 32 * 64)]


@pytest.mark.parametrize("block", [4_096, 8])
def test_ids_that_repeat_more_than_k_times(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "BLOCK_ROWS", block)
    rows = [(0, [2.0, 0.0])] * 25 + [(i, [1.0 + i / 1_000, 0.1]) for i in range(1, 201)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [tuple(r) for r in knn.top_k(df, F.col("vec_id") == 0).collect()]
    assert len(found) == 20 and set(found) == brute(rows, 20, lambda i: i == 0)


def test_empty_tables_and_no_queries(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert knn.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert knn.top_k(df, F.col("vec_id") % 20 == 0).count() == 0
    assert knn.top_k(df, F.lit(True)).count() == 0
