"""Benchmark decontamination: containment search by size-partitioned MinHash, verified exactly, in DataFrame functions.

Texts are lower-cased and cut into words (runs of letters and digits); a shingle is WORDS consecutive words, and an item of fewer words
is one shingle, itself. An item is found in a document if at least THRESHOLD of the item's distinct shingles occur in it, however long
the document is.

Search: items are partitioned by their number of shingles into classes up to a power of two, u. An item of a class
is sketched by its floor((1 - THRESHOLD) u) + 1 smallest hashes. A document that holds THRESHOLD of the item's
shingles lacks too few to miss the whole sketch, so a document that shares a sketch hash is a candidate and no
pair is lost. Candidates, and they alone, are then verified: their items' shingles, as words, meet those of their documents.

Sketches and candidates are broadcast only while they are small in bytes; beyond that the same joins are shuffled. Null and empty texts
match nothing, empty tables give no rows, and very long texts are searched whole. Repeated documents or items of one id count once. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import bounded, cut

WORDS, THRESHOLD = 5, 0.8


def words(text: Column) -> Column:
    """The text's words in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), "")


def runs(w: Column, k: int, of: Callable[[Column], Column]) -> Column:
    """of() each run of k of the words, in order; empty for fewer words."""
    some = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: of(F.slice(w, i, k)))
    return F.when(F.size(w) >= k, some).otherwise(F.filter(F.array(of(w)), lambda _: F.lit(False)))


def shingles(text: Column, of: Callable[[Column], Column] = F.xxhash64, short: tuple[int, ...] = ()) -> Column:
    """Hashes (or what of() makes) of the text's shingles, and of its runs of each of the short lengths."""
    # The one-element array binds the words once, so that they aren't cut again for each shingle.
    return F.element_at(F.transform(F.array(words(text)), lambda w: F.concat(*[runs(w, k, of) for k in (WORDS, *short)])), 1)


def item_shingles(text: Column, of: Callable[[Column], Column]) -> Column:
    """What of() makes of an item's shingles: those of WORDS words, or the whole item if it has fewer; empty without words."""
    whole = lambda w: F.filter(F.array(of(w)), lambda _: F.size(w) > 0)
    return F.element_at(F.transform(F.array(words(text)), lambda w: F.when(F.size(w) >= WORDS, runs(w, WORDS, of)).otherwise(whole(w))), 1)


def spelled(run: Column) -> Column:
    """A shingle as text."""
    return F.array_join(run, " ")


def index_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, size, shingle, hash, length (words of an item of one short shingle, else WORDS), sketched: one row for each distinct shingle of each item."""
    both = lambda w: F.struct(spelled(w).alias("shingle"), F.xxhash64(w).alias("hash"), F.least(F.size(w), F.lit(WORDS)).alias("length"))
    rows = items.select(F.col(id_col).alias("item"), F.explode(item_shingles(F.col(text_col), both)).alias("s")).select("item", "s.*").distinct()
    by_item = Window.partitionBy("item")
    rows = rows.withColumn("size", F.count(F.lit(1)).over(by_item)).withColumn("rank", F.row_number().over(by_item.orderBy("hash", "shingle")))
    upper = F.pow(F.lit(2.0), F.ceil(F.log2("size")))
    return rows.select("item", "size", "shingle", "hash", "length", (F.col("rank") <= F.floor((1 - THRESHOLD) * upper + 1e-9) + 1).alias("sketched"))


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, shared, item_shingles, containment of each document and item it contains."""
    index = cut(index_items(items, item_id, item_text), "items")
    short = tuple(r[0] for r in index.where(F.col("length") < WORDS).select("length").distinct().orderBy("length").collect())  # below WORDS
    sketch = cut(index.where("sketched").select("hash", "item", "size"), "sketch")
    least = F.ceil(F.col("size") * THRESHOLD - 1e-9)
    text = docs[text_col]
    keyed = docs.select(docs[id_col].alias("doc"), F.xxhash64(text).alias("key"), shingles(text, short=short).alias("sh"))
    probes = keyed.select("doc", "key", F.size("sh").alias("n"), F.explode("sh").alias("hash"))
    found = probes.join(bounded(sketch), "hash").where(F.col("n") >= least)
    found = cut(found.select("doc", "key", "item").distinct(), "candidates")

    texts = cut(found.select(F.col("doc").alias("d"), F.col("key").alias("k")).distinct(), "texts")
    again = docs.select(docs[id_col].alias("doc"), F.xxhash64(text).alias("key"), text.alias("text"))
    again = again.join(bounded(texts), F.col("doc").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left_semi")
    held = again.select("doc", "key", F.explode(F.array_distinct(shingles(F.col("text"), spelled, short))).alias("shingle"))
    held = held.join(bounded(index.select("shingle").distinct()), "shingle", "left_semi")  # the items' shingles alone go on
    wanted = found.select(F.col("doc").alias("d"), F.col("key").alias("k"), "item").join(bounded(index.select("item", "size", "shingle")), "item")
    wanted = wanted.withColumnRenamed("shingle", "s")
    met = held.join(wanted, F.col("doc").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")) & (F.col("shingle") == F.col("s")))
    shared = met.groupBy("doc", "key", "item", "size").agg(F.count_distinct("shingle").alias("shared")).where(F.col("shared") >= least)
    best = shared.groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).agg(F.max("shared").alias("shared"), F.max("size").alias("item_shingles"))
    return best.withColumn("containment", F.round(F.col("shared") / F.col("item_shingles"), 6))


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, unchanged, whose id holds no item."""
    leaks = bounded(cut(find_leaks(docs, items, id_col, text_col).select(F.col("doc_id").alias("leaked")).distinct(), "leaks"))
    return docs.join(leaks, docs[id_col].eqNullSafe(leaks["leaked"]), "left_anti")
