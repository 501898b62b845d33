"""Connected components of an undirected graph of links, by alternating star steps in DataFrame joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm import common
from lumenlake.llm.common import cut

#: More rounds than a graph of 2**60 nodes needs; each round at least halves the stars' number.
MOST_ROUNDS = 60
#: Bytes of a node and its minimum.
NODE_BYTES = 16


def components(edges: DataFrame, a: str = "a", b: str = "b", cut: Callable[[DataFrame, str], DataFrame] = cut) -> DataFrame:
    """node and comp, the smallest node of its component, of every node with a link. cut: writes the tables of the rounds.

    Alternating large-star and small-star steps (Kiveris and others, 2014): nodes link to the smallest
    neighbour, edges at most stay as many, and the number of rounds grows with the logarithm of the nodes.
    A star's centre meets its links only in partial aggregates; the minima come back to the links by a broadcast while the
    links are few enough for it, else by a join that AQE may split.
    """
    pairs = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct()
    pairs = cut(pairs, "edges")
    before = _mark(pairs)
    for _ in range(MOST_ROUNDS):
        # A minimum for each node, and at most two nodes for a link.
        few = 2 * NODE_BYTES * before[0] <= common.BROADCAST_BYTES
        back = F.broadcast if few else lambda df: df
        # Large star: neighbours above a node go to the smallest of its neighbours and itself.
        both = pairs.select(F.col("lo").alias("n"), F.col("hi").alias("m")).unionByName(pairs.select(F.col("hi").alias("n"), F.col("lo").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("least"))
        large = both.where("m > n").join(back(least), "n").select(F.col("least").alias("lo"), F.col("m").alias("hi")).where("lo < hi").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = large.join(back(least), "hi").select(F.col("least"), F.explode(F.array("lo", "hi")).alias("m"))
        pairs = cut(small.select(F.col("least").alias("lo"), F.col("m").alias("hi")).where("lo < hi").distinct(), "edges")
        after = _mark(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).unionByName(pairs.select(F.col("lo").alias("node"), F.col("lo").alias("comp")).distinct())


def _mark(pairs: DataFrame) -> tuple:
    """Number and sum of hashes of the links: equal for equal sets."""
    return tuple(pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")), F.lit(0))).first())
