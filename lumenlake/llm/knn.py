"""Exact top-k inner-product search as a Voronoi kNN join.

1. Vectors are quantised, floor(SCALE * x), and dealt to cells by their nearest pivot. Pivots are a bounded sample
   of distinct vectors in the order of a hash: half the root of the number of vectors, MOST_PIVOTS at most.
2. A cell is cut into rings of about BLOCK_ROWS rows: by distance to the pivot, in RINGS steps up to the cell's radius, and by a hash
   where a ring holds more. A block's summary has its largest distance, its row count, and the k + 1
   smallest distances of different ids; an id that repeats counts once, by one of its rows.
3. For a query q and a row x of a cell with pivot p, |q.x - q.p| <= |q| |x - p|. From the smallest distances follow
   scores that some k rows of other ids than the query's are sure to reach, hence a bound for the k-th best; blocks whose
   best possible score is below it are not needed by the query.
4. Queries of the same cells form groups of about GROUP_QUERIES. Each block goes to those groups of which a query needs it,
   and only there; each pair of block and group is solved on its own, and each query's best k of all pairs are kept.

Scores are exact integers, those beyond 64 bits the nearest long; ties go to the smaller id. Vectors that are null, or hold null or non-finite components, take
no part; shorter ones count as padded with zeros. Repeated ids are rows of their own, and a query's own rows
(all of its id) are never among its candidates; an id that repeats among the queries is asked once, by its first
vector in order. Extra columns are harmless.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import cut, map_units, tidied

SCALE, LEAST_PIVOTS, MOST_PIVOTS, RINGS = 64, 16, 4_096, 4
BLOCK_ROWS, GROUP_QUERIES, ASKED = 4_096, 512, 64
LARGEST = (1 << 63) - 1


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id and v, array of long, of the rows that take part."""
    x = F.col(vector_col)
    fine = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return df.where(F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, fine)).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products, exactly: as doubles or longs where they hold all sums, else as Python's integers, clipped."""
    most = np.abs(a.astype(np.float64)).max(initial=0) * np.abs(b.astype(np.float64)).max(initial=0) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -LARGEST, LARGEST).astype(np.int64)


def _assign(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, v, cell and dist of every row: the nearest pivot, ties to the first."""
    p = pivots.astype(np.float64)
    norms = (p**2).sum(1)

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            for lo in range(0, len(pdf), 1_024):
                part = pdf.iloc[lo : lo + 1_024]
                x = _matrix(part["v"], p.shape[1]).astype(np.float64)
                cell = (norms - 2 * (x @ p.T)).argmin(1)
                dist = np.sqrt(((x - p[cell]) ** 2).sum(1))
                yield part.assign(cell=cell.astype(np.int32), dist=dist)

    return rows.mapInPandas(tidied(run), "vec_id long, v array<long>, cell int, dist double")


#: Distances of summaries that are held for a batch of queries at a time.
NEAR_BLOCK = 8_192


class Summaries:
    """What the queries have to know of the blocks: arrays of a bounded number of rows each."""

    def __init__(self, pivots: np.ndarray, cells: list, k: int) -> None:
        self.pivots, self.k = pivots, k
        cells = sorted(cells, key=lambda r: (r["cell"], r["ring"]))
        self.cell = np.array([r["cell"] for r in cells], np.int64)
        self.ring = np.array([r["ring"] for r in cells], np.int64)
        self.far = np.array([r["far"] for r in cells], np.float64)
        near = [(r["cell"], d) for r in cells for d in r["near"] or []]
        self.near_cell = np.array([c for c, _ in near], np.int64)
        self.near = np.array([d for _, d in near], np.float64)

    def needed(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of queries, and of the cells' rings that they need."""
        q = q.astype(np.float64)
        to_pivot = q @ self.pivots.T.astype(np.float64)
        norm = np.sqrt((q**2).sum(1))[:, None]
        slack = 1e-9 * (1 + np.abs(to_pivot).max(initial=0) + norm.max(initial=0) * self.far.max(initial=0))
        # One of the k + 1 surest ids may be the query's own. They are found a block at a time, as there are up to k + 1 for each ring.
        top = np.full((len(q), self.k + 1), -np.inf)
        for lo in range(0, len(self.near), NEAR_BLOCK):
            some = slice(lo, lo + NEAR_BLOCK)
            both = np.concatenate([top, to_pivot[:, self.near_cell[some]] - norm * self.near[some]], axis=1)
            top = np.partition(both, -(self.k + 1), axis=1)[:, -(self.k + 1) :]
        bound = top.min(1)
        best = to_pivot[:, self.cell] + norm * self.far
        return np.nonzero(np.clip(best, -LARGEST, LARGEST) >= np.clip(bound[:, None] - slack, -LARGEST, LARGEST))


def _solve(unit: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k rows of the unit's block for each of its queries."""
    is_query = unit["is_query"].to_numpy()
    queries, rows = unit[is_query], unit[~is_query]
    if not len(queries) or not len(rows):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    dim = int(unit["v"].map(len).max())
    rows = rows.sort_values("vec_id", kind="stable")
    ids, own = rows["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
    score = _scores(_matrix(queries["v"], dim), _matrix(rows["v"], dim))
    lowest = np.iinfo(np.int64).min
    score[own[:, None] == ids[None, :]] = lowest
    picked = min(k, len(ids))
    # A stable sort keeps smaller ids first; only rows that reach the k-th best score are sorted.
    least = np.partition(score, len(ids) - picked, axis=1)[:, len(ids) - picked]
    out_q, out_i, out_s = [], [], []
    for i, line in enumerate(score):
        at = np.flatnonzero((line >= least[i]) & (line > lowest))
        at = at[np.argsort(-line[at], kind="stable")][:k]
        out_q.append(np.full(len(at), own[i]))
        out_i.append(ids[at])
        out_s.append(line[at])
    return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_i), "score": np.concatenate(out_s)})


def top_k(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best other rows of each row that queries picks, by its id as vec_id."""
    rows = quantised(df, id_col, vector_col)
    n, dim = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    most = min(MOST_PIVOTS, max(LEAST_PIVOTS, math.isqrt(n) // 2))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * most).select("v").collect()
    distinct = list(dict.fromkeys(tuple(r["v"]) for r in sample))[:most]
    pivots = np.zeros((max(1, len(distinct)), max(1, dim)), np.int64)
    for i, v in enumerate(distinct):
        pivots[i, : len(v)] = v

    placed = cut(_assign(rows, pivots), "placed")
    radius = placed.groupBy("cell").agg(F.max("dist").alias("radius"))
    ring = F.least(F.floor(F.col("dist") / F.greatest("radius", F.lit(1e-12)) * RINGS), F.lit(RINGS - 1)).cast("int")
    ringed = placed.join(F.broadcast(radius), "cell").withColumn("ring", ring).drop("radius")  # a row for each pivot
    smallest = Window.partitionBy("cell", "ring").orderBy("dist")
    once = ringed.groupBy("vec_id").agg(F.min(F.struct("cell", "ring", "dist")).alias("at")).select("at.*")
    near = once.select("cell", "ring", "dist", F.row_number().over(smallest).alias("n")).where(F.col("n") <= k + 1).groupBy("cell", "ring").agg(F.collect_list("dist").alias("near"))
    sizes = ringed.groupBy("cell", "ring").agg(F.max("dist").alias("far"), F.count(F.lit(1)).alias("rows"))
    cells = sizes.join(near, ["cell", "ring"], "left").collect()  # MOST_PIVOTS * RINGS rows at most
    spark = df.sparkSession
    blocks = {(r["cell"], r["ring"]): max(1, -(-r["rows"] // BLOCK_ROWS)) for r in cells}

    asked = placed.where(queries).withColumn("first", F.row_number().over(Window.partitionBy("vec_id").orderBy("v"))).where("first = 1").drop("first")
    counts = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    group_of, before = {}, 0
    for cell in sorted(counts):
        group_of[cell] = (before // GROUP_QUERIES, max(1, -(-counts[cell] // GROUP_QUERIES)))
        before += counts[cell]
    place = spark.createDataFrame([(c, *g) for c, g in group_of.items()] or [(-1, 0, 1)], "cell int, first_group long, splits long")
    grouped = asked.join(F.broadcast(place), "cell").withColumn("grp", F.col("first_group") + F.pmod(F.xxhash64("vec_id"), "splits")).select("vec_id", "v", "grp")
    summaries = Summaries(pivots, cells, k)
    # Bounds are arithmetic, not rows: the few rows of the queries are dealt to as many tasks as their work is worth.
    tasks = max(1, min(-(-before // ASKED), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    grouped = grouped.repartition(tasks)

    def needs(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            for lo in range(0, len(pdf), ASKED):
                part = pdf.iloc[lo : lo + ASKED]
                if len(summaries.cell):
                    i, at = summaries.needed(_matrix(part["v"], pivots.shape[1]))
                    yield part.iloc[i].assign(cell=summaries.cell[at].astype(np.int32), ring=summaries.ring[at].astype(np.int32))

    needed = cut(grouped.mapInPandas(tidied(needs), "vec_id long, v array<long>, grp long, cell int, ring int"), "needed")
    split = spark.createDataFrame([(*c, n) for c, n in blocks.items()] or [(-1, 0, 1)], "cell int, ring int, splits long")
    split = F.broadcast(split)  # MOST_PIVOTS * RINGS rows at most
    pairs = needed.select("cell", "ring", "grp").distinct()
    data = ringed.join(split, ["cell", "ring"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "dist", F.monotonically_increasing_id()), "splits"))
    data = data.join(pairs, ["cell", "ring"]).select(F.xxhash64("cell", "ring", "block", "grp").alias("unit"), F.lit(False).alias("is_query"), "vec_id", "v")
    ask = needed.join(split, ["cell", "ring"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)))
    ask = ask.select(F.xxhash64("cell", "ring", "block", "grp").alias("unit"), F.lit(True).alias("is_query"), "vec_id", "v")
    found = map_units(data.unionByName(ask), "unit", functools.partial(_solve, k=k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
