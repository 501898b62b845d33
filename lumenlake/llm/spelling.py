"""Spelling variants: words one edit apart, by an errata trie over all words, and the form that each word stands for.

All words form a trie; at each of its nodes the child with most words is heavy, the others, and a word that ends there, are light. Two words
one edit apart part at the node of their common prefix P, where one of them at least, P c S, is light. Each light word is merged into
the heavy child h of that node with its next character replaced (P h S) or skipped (P S), or h inserted before it (P h c S), as one row. Where terminals coincide,
of a merged word and a word, or of two words merged with a replaced character at one node, the two words are a pair.
A word is light at no more nodes than log2 of the number of words, so that is how often it is copied, whatever its length.

Nodes and merged words are known by 64-bit polynomial hashes of their characters, which an edit changes in constant time; very long words cost
their length. Hashes only propose: pairs are verified on the words, so equal hashes of unequal strings cost time alone.

Nodes that hold many of the words (the root and short prefixes) are joined to these words by broadcast, if their size allows it, and the others by a shuffle.
At most as many words as there are characters meet in one merged word and node. Each form has at least twice its word's
occurrences, so a chain of forms is at most as long as log2 of the greatest count, and pointers that double find its end in a few rounds.

Null texts hold no words; null ids count as empty. Repeated rows count again. Ties go to the smaller word in code-point order. An empty table gives no
words. Very long texts and words are taken whole; extra columns play no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import Scratch, bounded, cut, pieces, tidied

#: Runs of letters, as bytes of UTF-8: A-Z are lower-cased before, and U+00C0 to U+00FF are C3 and another byte.
RUN = re.compile(rb"(?:[a-z]++|\xc3[\x80-\xbf])++")
LEAST_CHARS, LEAST_COUNT, PLANTED_MOD = 5, 3, 97
#: Distinct words that a task holds before it hands them on.
HELD = 200_000
#: Nodes with this share of all words are joined by broadcast.
HOT_SHARE = 1 / 4_096
#: Characters of words in a batch of hashes.
BATCH_CHARS = 1_000_000
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
BASE_BACK = pow(BASE, -1, 1 << 64)


def varied(doc: bytes, run: bytes) -> bytes:
    """The run, or where PLANTED_MOD divides the crc32 of doc:run, the run without the code point at that number modulo its length."""
    h = zlib.crc32(run, zlib.crc32(doc + b":"))
    if h % PLANTED_MOD:
        return run
    chars = run.decode()
    at = h % len(chars)
    return (chars[:at] + chars[at + 1 :]).encode()


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n: the words of LEAST_CHARS code points and LEAST_COUNT occurrences or more, over whole texts."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            words = [w for w in total if len(w) >= LEAST_CHARS]
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([total[w] for w in words], pa.int64())], schema=schema)
            total.clear()
            return batch

        for batch in batches:
            for lo, hi in pieces(batch.column(1)):
                ids = pc.fill_null(batch.column(0).slice(lo, hi - lo).cast(pa.binary()), b"").to_pylist()
                texts = pc.fill_null(batch.column(1).slice(lo, hi - lo), b"").to_pylist()
                for doc, text in zip(ids, texts, strict=True):
                    seed = zlib.crc32(doc + b":")
                    for w, n in Counter(RUN.findall(text.lower())).items():
                        if zlib.crc32(w, seed) % PLANTED_MOD:
                            total[w] += n
                        else:
                            total[varied(doc, w)] += n
                if len(total) >= HELD:
                    yield told()
        yield told()

    texts = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].cast("binary").alias("text"))
    counted = texts.mapInArrow(tidied(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") >= LEAST_COUNT) & (F.char_length("word") >= LEAST_CHARS))


def _symbols() -> np.ndarray:
    """A random number for each code point that a word can hold."""
    return np.random.default_rng(20240601).integers(1, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(BASE))]), dtype=np.uint64)


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Some words at a time: the words, their sizes, where they start, and of all of their characters the code and its part of a hash."""
    symbol = _symbols()
    for batch in batches:
        for lo, hi in pieces(batch.column(0).cast(pa.binary()), BATCH_CHARS):
            some = batch.column(0).slice(lo, hi - lo)
            words = some.to_pylist()
            sizes = np.array([len(w) for w in words])
            codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
            starts = np.cumsum(sizes) - sizes
            yield some, sizes, starts, codes, symbol[codes] * _powers(int(sizes.max()))[np.arange(len(codes)) - np.repeat(starts, sizes)]


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word's own hash."""
    for words, _, starts, _, terms in _spelled(batches):
        yield pa.RecordBatch.from_arrays([pa.array(np.add.reduceat(terms, starts).astype(np.int64)), words], ["id", "word"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word and place: the hashes of the word and of what stands before the place, and the character there; 0 is the word's end."""
    for _, sizes, starts, codes, terms in _spelled(batches):
        upto = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
        # One row more than characters for each word.
        word = np.repeat(np.arange(len(sizes)), sizes + 1)
        place = np.arange(len(word)) - np.repeat(starts + np.arange(len(sizes)), sizes + 1)
        before = upto[starts[word] + place] - upto[starts[word]]
        full = upto[starts + sizes] - upto[starts]
        char = np.append(codes, np.uint8(0))[starts[word] + place].astype(np.int32)
        char[place == sizes[word]] = 0
        yield pa.RecordBatch.from_arrays([pa.array(full[word].astype(np.int64)), pa.array(before.astype(np.int64)), pa.array(place.astype(np.int32)), pa.array(char)], ["id", "node", "at", "char"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each light word merged into its node's heavy child: with a character replaced, skipped and inserted."""
    symbol = _symbols()
    for batch in batches:
        if not batch.num_rows:
            continue
        full, node = (batch.column(c).to_numpy().astype(np.uint64) for c in ("id", "node"))
        at, char, heavy = (batch.column(c).to_numpy() for c in ("at", "char", "heavy"))
        power = _powers(int(at.max()))[at]
        own, other = symbol[char] * power, symbol[heavy] * power
        inserted = node + other + (full - node) * np.uint64(BASE)
        ended = char == 0
        replaced = (full + other - own)[~ended]
        skipped = (node + (full - node - own) * np.uint64(BASE_BACK))[~ended]
        keys = np.concatenate([inserted, replaced, skipped]).astype(np.int64)
        where = np.concatenate([node, node[~ended], node[~ended]]).astype(np.int64)
        ids = np.concatenate([full, full[~ended], full[~ended]]).astype(np.int64)
        kind = np.repeat([False, True, False], [len(full), int((~ended).sum()), int((~ended).sum())])
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(where), pa.array(ids), pa.array(kind)], ["key", "node", "id", "replaced"])


def near_pairs(words: DataFrame, write: Callable[[DataFrame, str], DataFrame] = cut) -> DataFrame:
    """a, a_n, b and b_n: all ordered pairs of words that differ by exactly one inserted, deleted or replaced code point. words has to be a table."""
    prefixes = write(words.select("word").mapInArrow(tidied(_prefixes), "id long, node long, at int, char int"), "prefixes")
    children = prefixes.groupBy("node", "char").agg(F.count(F.lit(1)).alias("n"))
    heavy = F.max(F.struct(F.col("char") > 0, "n", "char"))["char"]
    nodes = write(children.groupBy("node").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("children"), heavy.alias("heavy")).where("children > 1").drop("children"), "nodes")
    hot = max(1_000, int(words.count() * HOT_SHARE))
    few, many = nodes.where(F.col("n") >= hot).drop("n"), nodes.where(F.col("n") < hot).drop("n")
    light = F.col("char") != F.col("heavy")
    few = bounded(few)
    at_few = prefixes.join(few, "node").where(light)
    at_many = prefixes.join(few.select("node"), "node", "left_anti").join(many, "node").where(light)
    merged = write(at_few.unionByName(at_many).mapInArrow(tidied(_merged), "key long, node long, id long, replaced boolean"), "merged")

    named = write(words.join(words.select("word").mapInArrow(tidied(_named), "id long, word string"), "word"), "named")
    met = merged.join(named.select(F.col("id").alias("other")), merged["key"] == F.col("other")).select("id", "other")
    replaced = merged.where("replaced").select("key", "node", "id")
    beside = replaced.join(replaced.withColumnRenamed("id", "other"), ["key", "node"]).where("id < other").select("id", "other")
    proposed = met.unionByName(beside).select(F.least("id", "other").alias("x"), F.greatest("id", "other").alias("y")).distinct()
    x, y = (named.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"), F.col("n").alias(f"{c}_n")) for c in ("x", "y"))
    real = proposed.join(x, "x").join(y, "y").where(F.levenshtein("x_word", "y_word", 1) == 1)
    both = F.explode(F.array(F.struct(F.col("x_word").alias("a"), F.col("x_n").alias("a_n"), F.col("y_word").alias("b"), F.col("y_n").alias("b_n")), F.struct(F.col("y_word").alias("a"), F.col("y_n").alias("a_n"), F.col("x_word").alias("b"), F.col("x_n").alias("b_n"))))
    return real.select(both.alias("p")).select("p.*")


def follow(words: DataFrame, write: Callable[[DataFrame, str], DataFrame] = cut) -> DataFrame:
    """word and root: where the chain of forms that begins at the word ends; words has word and form."""
    # Each round doubles the steps that a pointer stands for.
    reached = write(words.where("form is not null").select("word", F.col("form").alias("root")), "reached")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = write(reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "reached")
        reached = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return reached


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n and root of every word."""
    spark = docs.sparkSession
    with Scratch(spark, "spelling") as write:
        words = write(count_words(docs, id_col, text_col), "words")
        best = F.min(F.struct((-F.col("b_n")).alias("less"), "b"))
        near = near_pairs(words, write).groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
        form_n = -F.col("best.less")
        fits = form_n >= 2 * F.col("n")
        formed = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.b")).alias("form"), F.when(fits, form_n).alias("form_n"))
        formed = cut(formed, "formed")
    with Scratch(spark, "roots") as write:
        roots = cut(follow(formed, write), "roots")
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
