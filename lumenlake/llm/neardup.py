"""Near-duplicate join: Jaccard similarity of five-word shingles, with Bayesian pruning of candidates.

1. Texts with equal bytes are one class; its representative (smallest row) stands for them from here on.
2. Each text gets HASHES MinHash values of its shingles (words: runs of non-blanks, A-Z lower-cased; a text of
   fewer than five words is one shingle). Representatives that agree on all ROWS values of one of BANDS bands are
   candidates; a pair at the threshold is missed with probability (1 - 0.8**4)**24 < 4e-6.
3. In each bucket of a band, pairs are compared incrementally: after every few values the pair is dropped if the
   posterior probability (uniform prior) that its similarity reaches the threshold is below TOLERANCE.
   A pair is compared in the first band it agrees on only. What survives leaves a spanning forest.
4. The forest's components bring together what has to be verified: in each, surviving pairs are verified on their
   whole shingle sets. This gives each text its number of links, and a spanning forest of true links.
5. The components of true links, copies included, are the classes.

Between the steps only what takes part moves: rows of texts that repeat, of buckets of two or more, of components. Such
sides are broadcast while they are small in bytes, else joined in a shuffle.

Buckets and components of any size are cut into blocks of at most UNIT rows (or UNIT_SHINGLES shingles); each pair of blocks is a
unit of work of bounded size, so no link is capped or sampled away and no pair becomes a row.

Null texts and texts without words have no shingles and stand alone. Rows may repeat, in id, text or both; the class
id is the smallest id in the class (null only if all its ids are). Extra columns are harmless.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.llm.common import Scratch, bounded, cut, map_texts, map_units
from lumenlake.llm.components import components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
#: The lowest bits of a bucket's key hold its band.
BAND_BITS = 5
HASHES = BANDS * ROWS
TOLERANCE = 1e-7
#: Values compared at a time.
STEPS = (8, 16, 32, 64, HASHES)
UNIT, UNIT_SHINGLES = 1_024, 1_500_000


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


@functools.lru_cache(1)
def _seeds() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20_240_501)
    return random.integers(1, 1 << 63, HASHES, np.uint64) << np.uint64(1) | np.uint64(1), random.integers(0, 1 << 63, HASHES, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle sets, with the hashes of words that were met at hand, as long as the task lasts."""

    def __init__(self) -> None:
        self.word = functools.lru_cache(1 << 17)(_hash)

    def __call__(self, text: str | None) -> np.ndarray:
        return shingle_set(text, self.word)


def shingle_set(text: str | None, word: Callable[[bytes], int] = _hash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(word, words), np.uint64, len(words))
    k = min(WORDS, len(ids))
    out = np.full(len(ids) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + ids[i : len(ids) - k + 1 + i])
    return np.unique(out)


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES values of each set, none of them empty."""
    multiply, add = _seeds()
    joined, starts = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint32)
    for j in range(HASHES):
        out[:, j] = np.minimum.reduceat((joined * multiply[j] + add[j]) >> np.uint64(32), starts)
    return out


def _bands(values: np.ndarray) -> np.ndarray:
    """A 63-bit key of each band, the band's number in its lowest bits."""
    keys = np.empty((len(values), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(values), b, np.uint64)
        for r in range(ROWS):
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + values[:, b * ROWS + r])
        keys[:, b] = (key >> np.uint64(BAND_BITS + 1) << np.uint64(BAND_BITS)) | np.uint64(b)
    return keys.astype(np.int64)


SIGNED = [T.StructField("size", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("values", T.BinaryType())]


def _sign(texts: list[str | None], shingles: Callable[[str | None], np.ndarray] = shingle_set) -> list:
    sets = [shingles(t) for t in texts]
    bands: list = [None] * len(texts)
    low: list = [None] * len(texts)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):  # some texts at a time, to bound the arrays
        stop, total = at, 0
        while stop < len(full) and (stop == at or total + len(sets[full[stop]]) <= 200_000):
            total += len(sets[full[stop]])
            stop += 1
        values = minhash([sets[i] for i in full[at:stop]])
        keys = _bands(values)
        for i, key, value in zip(full[at:stop], keys, values.astype(np.uint8), strict=True):
            bands[i], low[i] = key, value.tobytes()
        at = stop
    return [[len(s) for s in sets], pa.array(bands, pa.list_(pa.int64())), low]


def _signer() -> Callable[[list[str | None]], list]:
    shingles = Shingler()
    return lambda texts: _sign(texts, shingles)


def _shingler() -> Callable[[list[str | None]], list]:
    shingles = Shingler()
    return lambda texts: [[shingles(t).tobytes() for t in texts]]


@functools.lru_cache(1)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[tuple[int, int], ...]:
    """For each number of values compared, the fewest matches with which a pair is kept.

    Values are kept as bytes, so two agree with probability J + (1 - J) / 256. The posterior of J after m of n matches,
    from a uniform prior, is a sum over a fine grid of J.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    p = grid + (1 - grid) / 256
    out = []
    for n in STEPS:
        for m in range(n + 1):
            logs = m * np.log(p) + (n - m) * np.log1p(-p)
            weight = np.exp(logs - logs.max())
            if weight[grid >= threshold].sum() / weight.sum() >= tolerance:
                out.append((n, m))
                break
    return tuple(out)


def surviving(a: np.ndarray, b: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Which of the pairs (rows of a, columns of b) Bayesian pruning keeps; a and b hold a byte for each value."""
    alive = np.arange(len(rows))
    matches, before = np.zeros(len(rows), np.int32), 0
    for n, least in least_matches():
        for lo in range(0, len(alive), 1 << 18):
            some = alive[lo : lo + (1 << 18)]
            matches[some] += (a[rows[some], before:n] == b[columns[some], before:n]).sum(1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
        before = n
    return alive


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(root, node) for each of n nodes that pairs link to a smaller root."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return list(zip(label[moved].tolist(), moved.tolist(), strict=True))


def _pairs(left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the places in left and right, once each."""
    if same:
        i, j = np.triu_indices(len(left), 1)
        return left[i], left[j]
    return np.repeat(left, len(right)), np.tile(right, len(left))


def _halves(unit: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of the rows of a unit's two blocks; whether they are the same block."""
    part = unit["part"].to_numpy()
    if unit["i"].iloc[0] == unit["j"].iloc[0]:
        return np.arange(len(unit)), np.arange(len(unit)), True
    return np.flatnonzero(part == unit["i"].iloc[0]), np.flatnonzero(part == unit["j"].iloc[0]), False


def _in_bucket(unit: pd.DataFrame) -> pd.DataFrame:
    """A forest of the pairs of a bucket's unit that survive."""
    values = np.frombuffer(b"".join(unit["values"]), np.uint8).reshape(len(unit), HASHES)
    bands = np.stack(unit["bands"].to_numpy())
    band = int(unit["bucket"].iloc[0]) & ((1 << BAND_BITS) - 1)
    left, right, same = _halves(unit)
    kept_a, kept_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]  # a block may be empty
    for lo in range(0, len(left), 256):
        if same:
            some = left[lo : lo + 256]
            a, b = np.repeat(some, len(right)), np.tile(right, len(some))
            a, b = a[a < b], b[a < b]
        else:
            a, b = _pairs(left[lo : lo + 256], right, False)
        for earlier in range(band):  # compared where they first agree
            apart = bands[a, earlier] != bands[b, earlier]
            a, b = a[apart], b[apart]
        kept = surviving(values, values, a, b)
        kept_a.append(a[kept])
        kept_b.append(b[kept])
    found = forest(len(unit), np.concatenate(kept_a), np.concatenate(kept_b))
    rep = unit["rep"].to_numpy()
    return pd.DataFrame({"a": [rep[x] for x, _ in found], "b": [rep[y] for _, y in found]}, dtype="int64")


def _in_component(unit: pd.DataFrame) -> pd.DataFrame:
    """For each text of a unit the copies that it links to, and a forest of the links."""
    values = np.frombuffer(b"".join(unit["values"]), np.uint8).reshape(len(unit), HASHES)
    sets = [np.frombuffer(s, np.uint64) for s in unit["shingles"]]
    sizes = np.array([len(s) for s in sets])
    copies, rep = unit["copies"].to_numpy(), unit["rep"].to_numpy()
    left, right, same = _halves(unit)
    columns = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum([0, *sizes])
    marked = np.zeros(int(columns.max()) + 1, bool)
    links, linked_a, linked_b = np.zeros(len(unit), np.int64), [], []
    for x in left.tolist():
        b = right[right > x] if same else right
        b = b[np.minimum(sizes[x], sizes[b]) >= THRESHOLD * np.maximum(sizes[x], sizes[b]) - 1e-9]
        b = b[surviving(values, values, np.full(len(b), x), b)]
        if not len(b):
            continue
        own = columns[starts[x] : starts[x + 1]]
        marked[own] = True
        common = np.array([np.count_nonzero(marked[columns[starts[y] : starts[y + 1]]]) for y in b.tolist()])
        marked[own] = False
        b = b[common >= THRESHOLD * (sizes[x] + sizes[b] - common) - 1e-9]
        links[x] += copies[b].sum()
        links[b] += copies[x]
        linked_a.append(np.full(len(b), x))
        linked_b.append(b)
    found = forest(len(unit), np.concatenate(linked_a), np.concatenate(linked_b)) if linked_a else []
    some = np.flatnonzero(links)
    return pd.DataFrame({"a": [*rep[some].tolist(), *(int(rep[x]) for x, _ in found)], "b": [None] * len(some) + [int(rep[y]) for _, y in found], "links": [*links[some].tolist(), *[None] * len(found)]}).astype({"a": "int64", "b": "Int64", "links": "Int64"})


def _dealt(rows: DataFrame, blocks: str, key: str) -> DataFrame:
    """Each row in all pairs of blocks that its own, part, is in: unit, i, j. A group of one block is one unit."""
    rows = rows.withColumn("blocks", F.expr(blocks)).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    rows = rows.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    return rows.withColumn("unit", F.xxhash64(key, "i", "j"))


def _classes(docs: DataFrame, id_col: str, text_col: str, cut: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """doc_id, key, row_id, comp and n_links of every row; cut writes the tables on the way."""
    text = F.coalesce(docs[text_col], F.lit(""))
    picked = docs.select(docs[id_col].alias("doc_id"), F.md5(text).alias("key"), text.alias("text"))
    signed = map_texts(picked, ["doc_id", "key"], "text", SIGNED, _signer)
    signed = cut(signed.withColumn("row_id", F.monotonically_increasing_id()), "signed")
    copied = signed.where("size > 0").groupBy("key").agg(F.min("row_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copied = bounded(cut(copied, "copied"))
    again = cut(signed.select("key", "row_id").join(copied, "key").where("row_id <> rep").select("row_id"), "again")
    reps = signed.where("size > 0").join(bounded(again), "row_id", "left_anti").withColumnRenamed("row_id", "rep")

    # Buckets of two or more; of buckets with equal members the first band's stands for all.
    banded = reps.select("rep", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("rep")).alias("mark"), F.min("rep").alias("least")).where("members > 1")
    band = F.col("bucket").bitwiseAND((1 << BAND_BITS) - 1)
    by_members = buckets.groupBy("members", "mark", "least").agg(F.min(F.struct(band.alias("band"), "bucket")).getField("bucket").alias("bucket"))
    chosen = cut(by_members.select("bucket", "members"), "buckets")
    placed = cut(banded.join(bounded(chosen), "bucket"), "placed")
    some = bounded(cut(placed.select("rep").distinct(), "some"))
    unit_rows = _dealt(placed, f"ceil(members / {UNIT})", "bucket").select("unit", "i", "j", "part", "bucket", "rep")
    unit_rows = unit_rows.join(reps.select("rep", "bands", "values").join(some, "rep", "left_semi"), "rep")
    likely = cut(map_units(unit_rows, "unit", _in_bucket, "a long, b long"), "likely")

    # Verification, with each text's shingles where its component is.
    groups = bounded(components(likely, cut=cut).withColumnRenamed("node", "rep"))
    members = reps.select("rep", "doc_id", "key", "size", "values").join(groups, "rep").join(copied.select("rep", "copies"), "rep", "left")
    members = cut(members.withColumn("copies", F.coalesce("copies", F.lit(1))), "members")
    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("texts"), F.sum("size").alias("shingle_sum"))
    units = cut(_dealt(members.join(sizes, "comp"), f"greatest(ceil(texts / {UNIT}), ceil(shingle_sum / {UNIT_SHINGLES}))", "comp").select("unit", "i", "j", "part", "rep", "key", "copies", "values"), "units")
    # One row of each text, that of its representative; equal rows are met by dropDuplicates.
    of = bounded(members.select(F.col("doc_id").alias("d"), F.col("key").alias("k")))
    wanted = picked.join(of, picked["doc_id"].eqNullSafe(of["d"]) & (picked["key"] == of["k"]), "left_semi")
    sets = map_texts(wanted, ["key"], "text", [T.StructField("shingles", T.BinaryType())], _shingler)
    sets = sets.dropDuplicates(["key"])
    verified = cut(map_units(units.join(sets, "key"), "unit", _in_component, "a long, b long, links long"), "verified")
    links = verified.where("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    groups = components(verified.where("b is not null").select("a", "b"), cut=cut).withColumnRenamed("node", "rep")

    # Back to rows: a row's class is that of its text.
    of_rep = bounded(cut(groups.join(links, "rep", "full_outer").select(F.col("rep").alias("r"), "comp", "links"), "links"))
    rows = signed.select("doc_id", "key", "row_id", "size").join(copied.select(F.col("key").alias("k"), "rep", "copies"), F.col("key") == F.col("k"), "left")
    rows = rows.withColumn("rep", F.coalesce("rep", "row_id")).join(of_rep, F.col("rep") == F.col("r"), "left")
    n_links = F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1
    return rows.select("doc_id", "key", "row_id", F.coalesce("comp", "rep").alias("comp"), n_links.alias("n_links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links (other rows at THRESHOLD or more), key (md5 of the text), class_row, row_id: one row per row."""
    with Scratch(docs.sparkSession, "neardup") as scratch:
        rows = cut(_classes(docs, id_col, text_col, scratch), "rows")
    ids = rows.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull().alias("null_last"), "doc_id", "row_id")).getField("row_id").alias("class_row"))
    return rows.join(ids, "comp").select("doc_id", "class_id", "n_links", "key", "class_row", "row_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, unchanged, without all but one of each class: the one of the smallest id.

    Of rows equal in id and text that differ elsewhere the one whose other columns have the smallest hash stays.
    """
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["key"] == b["key"])
    with Scratch(docs.sparkSession, "kept") as scratch:
        found = scratch(near_duplicates(docs, id_col, text_col), "found").select(F.col("doc_id").alias("id"), "key", (F.col("row_id") == F.col("class_row")).alias("kept"))
        gone, kept = cut(found.where("not kept").select("id", "key").distinct(), "gone"), found.where("kept")
        # Rows that are equal share id and text: some go and one stays.
        side = bounded(gone)
        equal = cut(kept.join(side, same(kept, side), "left_semi").select("id", "key").distinct(), "equal")
    keyed = docs.withColumn("__key", F.md5(F.coalesce(docs[text_col], F.lit(""))))
    match = lambda x: keyed[id_col].eqNullSafe(x["id"]) & (keyed["__key"] == x["key"])
    rest = keyed.join(side, match(side), "left_anti").drop("__key")
    if equal.isEmpty():
        return rest
    both = bounded(equal)
    others = F.xxhash64(F.to_json(F.struct(*[c for c in docs.columns if c != text_col])))
    first = F.row_number().over(Window.partitionBy(id_col, "__key").orderBy("__others"))
    once = keyed.join(both, match(both), "left_semi").withColumn("__others", others).withColumn("__first", first).where("__first = 1")
    return rest.unionByName(once.select(*docs.columns))


def expected_miss(similarity: float = THRESHOLD) -> float:
    """Probability that no band brings a pair of this similarity together."""
    return math.pow(1 - similarity**ROWS, BANDS)
