"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Size: a document's number of words (runs of non-blanks; null: 0). Sources, by code point and null last, get the
weights 3, 1, 2, repeating, and share BUDGET times all sizes; a target stops at MOST_EPOCHS times its source's
size and the excess goes to the others by weight until none is above.

A target's whole multiples of the source's size are complete epochs: every document is taken that often. The
rest is drawn: each document has the key -ln(u) / w, with u a hash of its id and text and w its quality weight; documents
are taken in the order of their keys until the rest is full, the last of them in part. So a source gives its target, cut to a word.

The order is not laid out in full: all that has to be known of it is each source's cut, the key at which its prefix sum
reaches the rest. It is found in rounds over narrow rows without texts: the keys between a source's bounds fall into BINS
bins, whose sizes are summed up in order, and the bin that holds the cut gives the next bounds; once few rows are left they
are sorted. Every row's share then follows from its own key, so texts move only where the weights are too many to be broadcast.

Rows of one key, that is of one id and text, share what is left at the cut by size, rounded down. Null ids and texts are
hashed as such. A source without words has the target 0, very long texts count whole, and an empty table
gives no rows. Extra columns are harmless. The same data gives the same result.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import SPACE, Scratch, bounded, cut

WEIGHTS, BUDGET, MOST_EPOCHS = (3, 1, 2), Fraction(3, 2), 2
#: Bins of a round, rows of a source that are sorted, rounds at most, and the hash's seed.
BINS, SORTED_ROWS, ROUNDS, SEED = 1_024, 1_000, 6, 17
#: Over how many keys null ids spread for one unit of their draw.
SPREAD = 100_000
RESULTS = ("size", "source_size", "target", "taken")


def words(text: Column) -> Column:
    """Number of runs of non-blanks; 0 for null."""
    parts = F.split(text, f"[{SPACE}]+", -1)
    outer = lambda at: F.when(F.element_at(parts, at) == "", 1).otherwise(0)
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(F.greatest(F.lit(0), F.size(parts) - outer(1) - outer(-1))).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, budget: Fraction = BUDGET, most: int = MOST_EPOCHS) -> list[Fraction]:
    """Targets of sources in order: the budget by weight, none above most times its size."""
    share = [weights[i % len(weights)] for i in range(len(sizes))]
    caps = [Fraction(most * s) for s in sizes]
    left, out, open_ = sum(sizes) * budget, [Fraction(0)] * len(sizes), set(range(len(sizes)))
    while open_:
        unit = left / sum(share[i] for i in open_)
        full = {i for i in open_ if unit * share[i] >= caps[i]}
        for i in full or open_:
            out[i] = caps[i] if full else unit * share[i]
            left -= out[i]
        open_ -= full or open_
    return out


def _keyed(docs: DataFrame, kept: dict[str, str], id_col: str, text_col: str, source_col: str, quality: DataFrame | None) -> DataFrame:
    """The kept columns with __source, size and __key."""
    text = docs[text_col]
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), docs[id_col], text), 11).cast("double") + 0.5) / float(1 << 53)
    sized = docs.select(*[docs[c].alias(k) for k, c in kept.items()], docs[id_col].alias("__id"), docs[source_col].alias("__source"), words(text).alias("size"), (-F.log(u)).alias("__draw"))
    if quality is None:
        return sized.withColumn("__key", F.col("__draw"))
    # Null ids have no weight; where the join is a shuffle, a second key spreads them.
    sized = sized.withColumn("__spread", F.when(F.col("__id").isNull(), F.floor(F.col("__draw") * SPREAD)).otherwise(F.lit(0)).cast("long"))
    met = sized.join(quality, (F.col("__id") == F.col("__of")) & (F.col("__spread") == F.col("__at")), "left")
    return met.withColumn("__key", F.col("__draw") / F.coalesce("__w", F.lit(1.0)))


def _reaches(rows: DataFrame, order: str) -> DataFrame:
    """Of rows with __s, rest, before and sum, in order, the one of each source in which before and the sums reach the rest."""
    upto = F.col("before") + F.sum("sum").over(Window.partitionBy("__s").orderBy(order))
    rows = rows.withColumn("upto", upto).where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("sum") < F.col("rest")))
    return rows.withColumn("before", F.col("upto") - F.col("sum"))


def cuts(keyed: DataFrame, rests: list[tuple]) -> dict[str | None, tuple[float, int, int]]:
    """For each (source, rest above 0, least key, largest key, rows): the cut's key, the words left there, and the words of its key."""
    spark = keyed.sparkSession
    bounds = [(s, rest, 0, lo, hi, n) for s, rest, lo, hi, n in rests]
    out = {}
    for left in range(ROUNDS, -1, -1):
        if not bounds:
            break
        plan = spark.createDataFrame(bounds, "__s string, rest long, before long, lo double, hi double, n long")
        near = keyed.select("__source", "size", "__key").join(F.broadcast(plan), F.col("__source").eqNullSafe(F.col("__s")) & F.col("__key").between(F.col("lo"), F.col("hi")))  # a row for each source
        few = (F.col("n") <= SORTED_ROWS) if left else F.lit(True)
        if not left or any(b[5] <= SORTED_ROWS for b in bounds):
            by_key = near.where(few).groupBy("__s", "rest", "before", "__key").agg(F.sum("size").alias("sum"))
            for r in _reaches(by_key, "__key").collect():
                out[r["__s"]] = (r["__key"], r["rest"] - r["before"], r["sum"])
        # Exponential keys fall evenly into bins of exp(-key).
        at = (F.exp(-F.col("lo")) - F.exp(-F.col("__key"))) / F.nullif(F.exp(-F.col("lo")) - F.exp(-F.col("hi")), F.lit(0.0))
        binned = near.where(~few).withColumn("bin", F.least(F.floor(F.coalesce(at, F.lit(0.0)) * BINS), F.lit(BINS - 1)))
        by_bin = binned.groupBy("__s", "rest", "before", "bin").agg(F.sum("size").alias("sum"), F.min("__key").alias("lo"), F.max("__key").alias("hi"), F.count(F.lit(1)).alias("n"))
        wide = any(b[5] > SORTED_ROWS for b in bounds) and left
        bounds = [(r["__s"], r["rest"], r["before"], r["lo"], r["hi"], r["n"]) for r in _reaches(by_bin, "bin").collect()] if wide else []
    return out


def mix(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: DataFrame | None = None) -> DataFrame:
    """keep, size, source_size, target, taken of every row. quality: id_col and weight, above 0, once per id; others weigh 1.

    A kept column with the name of a result gives way to it. The driver sees a row per source.
    """
    spark = docs.sparkSession
    kept = {f"__kept{i}": c for i, c in enumerate(c for c in keep if c not in RESULTS)}
    if quality is not None:
        quality = bounded(cut(quality.select(F.col(id_col).alias("__of"), F.col("weight").cast("double").alias("__w"), F.lit(0).cast("long").alias("__at")), "weights"))
    with Scratch(spark, "keys") as scratch:
        plan, found = _plan(scratch(_keyed(docs, {}, id_col, text_col, source_col, quality).select("__source", "size", "__key"), "keys"))
    # Keys are 0 or more, so a cut of -1 draws nothing.
    goals = spark.createDataFrame([(*p[:4], *found.get(p[0], (-1.0, 0, 1))) for p in plan], "__s string, source_size long, target double, epochs long, cut double, rest long, cut_size long")
    rows = _keyed(docs, kept, id_col, text_col, source_col, quality).join(F.broadcast(goals), F.col("__source").eqNullSafe(F.col("__s")))  # a row for each source
    share = F.floor(F.col("size") * F.col("rest") / F.col("cut_size"))
    drawn = F.when(F.col("__key") < F.col("cut"), F.col("size")).when(F.col("__key") == F.col("cut"), share).otherwise(0)
    return rows.select(*[F.col(k).alias(c) for k, c in kept.items()], "size", "source_size", "target", (F.col("epochs") * F.col("size") + drawn).cast("long").alias("taken"))


def _plan(keyed: DataFrame) -> tuple[list[tuple], dict]:
    """(source, size, target, epochs, rest, least key, largest key, rows) of each source, and the cuts of the rests."""
    totals = keyed.groupBy("__source").agg(F.sum("size").alias("source_size"), F.min("__key").alias("lo"), F.max("__key").alias("hi"), F.count(F.lit(1)).alias("rows")).collect()
    totals.sort(key=lambda r: (r["__source"] is None, r["__source"] or ""))
    plan = []
    for r, goal in zip(totals, targets([r["source_size"] for r in totals]), strict=True):
        size = r["source_size"]
        epochs = int(goal // size) if size else 0
        plan.append((r["__source"], size, float(goal), epochs, round(goal - epochs * size), r["lo"], r["hi"], r["rows"]))
    return plan, cuts(keyed, [(s, rest, lo, hi, n) for s, _, _, _, rest, lo, hi, n in plan if rest])


def quality_weights(labels: DataFrame, id_col: str = "doc_id", good: float = 2.0, bad: float = 0.5) -> DataFrame:
    """id_col and weight of every labelled document: good if a label says quality 1, else bad; null labels count for nothing."""
    best = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg(F.max("quality").alias("q"))
    return best.select(id_col, F.when(F.col("q") > 0, good).otherwise(bad).alias("weight"))
