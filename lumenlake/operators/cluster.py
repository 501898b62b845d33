"""Clusters of vectors: centroids, assignment, merging, and the exact sequential clustering within a partition key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions.exprs import cosine

THRESHOLD = 0.42
#: Elements (clusters times dimensions) of the centroids that one pass broadcasts.
BLOCK_ELEMENTS = 2_000_000


def centroids(vectors: DataFrame, cluster: str, vector: str, digits: int = 6) -> DataFrame:
    """Element-wise mean and count per cluster. Elements are averaged as rows, combined before the shuffle."""
    by = vectors.select(cluster, F.posexplode(vector).alias("pos", "x")).groupBy(cluster, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    back = by.groupBy(cluster).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("c"))
    return back.select(cluster, "n", F.transform("c", lambda s: F.round(s["m"], digits)).alias("centroid"))


def assign(vectors: DataFrame, centers: DataFrame, id_col: str, vector: str, cluster: str, threshold: float = THRESHOLD, block_elements: int = BLOCK_ELEMENTS) -> DataFrame:
    """The nearest cluster of each vector with its similarity; null below the threshold. Ties go to the smaller cluster.

    One matrix product per batch of vectors and block of centroids, in Arrow batches: a row goes in and a row comes out for each vector and block.
    Blocks have block_elements elements at most and go to the tasks with the code; more than one block means more passes, one for each,
    and a maximum per vector. Vectors and centroids without a length take no part.
    """
    known = centers.where(F.col(cluster).isNotNull()).select(F.col(cluster).cast("long").alias("c"), F.col("centroid").cast("array<double>").alias("v"))
    shape = known.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    blocks = max(1, -(-shape["n"] * (shape["d"] or 1) // block_elements))
    kinds = dict(vectors.dtypes)
    schema = f"{id_col} {kinds[id_col]}, sim double, c_id long"
    picked = vectors.select(id_col, F.col(vector).cast("array<double>").alias("v"))
    parts = []
    for n in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("c"), F.lit(blocks)) == n).orderBy("c").collect()  # a block
        table = np.array([r["v"] for r in rows], float).reshape(len(rows), shape["d"] or 1)
        norms = np.sqrt((table**2).sum(1))
        names, unit = np.array([r["c"] for r in rows], np.int64)[norms > 0], table[norms > 0] / norms[norms > 0, None]
        parts.append(picked.mapInPandas(_nearest(names, unit, id_col), schema))
    best = reduce(lambda a, b: a.unionByName(b), parts)
    if blocks > 1:
        best = best.groupBy(id_col).agg(F.max(F.struct("sim", (-F.col("c_id")).alias("neg"))).alias("best")).select(id_col, F.col("best.sim").alias("sim"), (-F.col("best.neg")).alias("c_id"))
    return best.select(id_col, F.when(F.col("sim") >= threshold, F.col("c_id")).cast(dict(centers.dtypes)[cluster]).alias(cluster), "sim")


def _nearest(names: np.ndarray, unit: np.ndarray, id_col: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The most similar of the unit vectors for each row of a batch; similarities are rounded before they are compared."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["v"].notna()]
            for lo in range(0, len(pdf) if len(names) else 0, 512):
                some = pdf.iloc[lo : lo + 512]
                rows = np.stack(some["v"].to_numpy()).astype(float)
                norms = np.sqrt((rows**2).sum(1))
                good = norms > 0
                sims = np.round(rows[good] @ unit.T / norms[good, None], 6)
                at = sims.argmax(1)
                yield pd.DataFrame({id_col: some[id_col].to_numpy()[good], "sim": sims[np.arange(len(at)), at] + 0.0, "c_id": names[at]})

    return run


def merge(vectors: DataFrame, cluster: str, from_id: int, to_id: int) -> DataFrame:
    """The vectors with one cluster's rows in another."""
    return vectors.withColumn(cluster, F.when(F.col(cluster) == from_id, F.lit(to_id)).otherwise(F.col(cluster)))


def covers(vectors: DataFrame, cluster: str, id_col: str, score: str) -> DataFrame:
    """The best row of each cluster as its cover."""
    return vectors.groupBy(cluster).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(id_col)).alias("neg"))).alias("best")).select(cluster, (-F.col("best.neg")).alias("cover_id"))


def sequential(vectors: DataFrame, key: str, id_col: str, vector: str, threshold: float = THRESHOLD) -> DataFrame:
    """Incremental clustering in the order of ids within each key: a vector joins the most similar centroid or begins a cluster.

    A row's cluster depends on all rows before it, so a key's rows are one sequence, and keys (libraries) run side by side. A sequence streams
    through its task in sorted batches: what is held is the sum of each cluster, not the rows. Of equally similar clusters the first counts;
    rows without a vector are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, sums, norms, n = object(), np.zeros((0, 0)), np.zeros(0), 0
        for pdf in batches:
            labels = []
            for k, v in zip(pdf[key], pdf[vector], strict=True):
                k = None if pd.isna(k) else k
                x = np.asarray(v, float)
                if k != current:
                    current, sums, norms, n = k, np.zeros((16, len(x))), np.zeros(16), 0
                length = np.linalg.norm(x)
                scale = norms[:n] * length
                sims = sums[:n] @ x / np.where(scale > 0, scale, 1)
                best = int(sims.argmax()) if n else -1
                if best < 0 or sims[best] < threshold:
                    if n == len(norms):
                        sums, norms = np.concatenate([sums, np.zeros_like(sums)]), np.concatenate([norms, np.zeros_like(norms)])
                    best, n = n, n + 1
                sums[best] += x
                norms[best] = np.linalg.norm(sums[best])
                labels.append(best)
            yield pdf[[key, id_col]].assign(cluster=labels)

    kinds = dict(vectors.dtypes)
    dealt = vectors.where(F.col(vector).isNotNull()).select(key, id_col, vector).repartition(key).sortWithinPartitions(key, id_col)
    return dealt.mapInPandas(run, f"{key} {kinds[key]}, {id_col} {kinds[id_col]}, cluster long")


def nearest(vectors: DataFrame, query: list[float], id_col: str, vector: str, k: int) -> DataFrame:
    """Exact k most similar vectors to one query."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, F.round(cosine(F.col(vector), q), 6).alias("sim")).where("sim is not null").orderBy(F.desc("sim"), id_col).limit(k)


def suppressed(boxes: DataFrame, key: str, overlap: float = 0.4) -> DataFrame:
    """Boxes (x, y, w, h, score) that greedy suppression keeps in each image, best first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "x", "y"], ascending=[False, True, True])
        x, y, w, h = (pdf[c].to_numpy(float) for c in "xywh")
        free = np.ones(len(pdf), bool)
        for i in range(len(pdf)):
            if free[i]:  # what a kept box overlaps goes
                across = np.clip(np.minimum(x[i] + w[i], x + w) - np.maximum(x[i], x), 0, None) * np.clip(np.minimum(y[i] + h[i], y + h) - np.maximum(y[i], y), 0, None)
                union = w[i] * h[i] + w * h - across
                free[i + 1 :] &= ~((union > 0) & (across > overlap * union))[i + 1 :]
        return pdf[free]

    return boxes.groupBy(key).applyInPandas(run, boxes.schema)


def sizes(vectors: DataFrame, cluster: str) -> DataFrame:
    """Rows per cluster with the rank by size."""
    by = vectors.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    # Clusters of one size share a rank's beginning; a window of sizes, which are few, instead of one of all clusters.
    sizes_ = by.groupBy("n").agg(F.count(F.lit(1)).alias("same"))
    before = sizes_.select("n", (F.sum("same").over(Window.orderBy(F.desc("n"))) - F.col("same")).alias("before"))
    return by.join(before, "n").withColumn("rank", (F.col("before") + F.row_number().over(Window.partitionBy("n").orderBy(cluster))).cast("int")).select(cluster, "n", "rank")
