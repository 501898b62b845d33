"""Packing tokenised documents into sequences of a fixed capacity, by harmonic classes.

A document is its token ids and a closing id. It is cut into pieces of CAPACITY ids and a remainder. A remainder of r ids belongs to the
class k = CAPACITY // r: k such pieces fill a sequence. If k of them would leave more than SLACK of a sequence empty, the remainder is
cut at CAPACITY // (k + 1) ids, a piece that fills the next class without loss, and what is left is classed again. What is left shrinks
with the square of k, so a remainder gives five pieces at most.

A sequence of class k holds k pieces. Tasks class and number their own pieces; the numbers of pieces before each task, from sums of one row
for each task and class, turn these into numbers within the class, so that sequences are filled across tasks, and no task waits for
another. A class's last sequence may lack pieces. What would stand there, at most CAPACITY ids for each of the at most 2 * sqrt(CAPACITY) classes, at
any size of corpus, is packed by falling length, first fit. Sequences are gapless, and padded at their end only.

Null texts count as empty: their piece is the closing id alone. Null and repeated ids, repeated rows and ties are kept apart, each row has its
own pieces. An empty table gives no rows. A very long text is tokenised whole, a word at a time. Extra columns play no part.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenlake.llm.common import bounded, cut, pieces, spread, tidied

CAPACITY, END_ID = 4_096, 2
#: Share of a sequence that a class may leave empty; else the piece is cut.
SLACK = 1 / 128
#: Distinct words that a task keeps with their ids.
WORDS_KEPT = 250_000
WORD_END = "</w>"
#: Words of letters alone, in UTF-8; and signs that end a run of letters.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+")
APART = re.compile(rb"(?<=[a-z])([.,;:!?|)])")


class WordEncoder:
    """Ids of texts by a tokenizer of lower-cased words that drops white space; distinct words are encoded once.

    The tokenizer takes a run of letters, and what other signs follow it, for two words, so a blank between them changes nothing.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
        self.tokenizer = Tokenizer.from_file(path)
        # The tokenizer takes its special tokens out of a text before it looks for words.
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self._forget()

    def _forget(self) -> None:
        self.code: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _each(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        """Add the ids of new words: those of letters alone, which have one word's end each, are encoded together."""
        plain = np.array([LETTERS.fullmatch(w) is not None for w in new], bool)
        together = self._each([b" ".join(itertools.compress(new, plain))])[0]
        stops = np.flatnonzero(self.ends[together]) + 1
        if len(stops) != plain.sum():
            plain[:] = False
            together, stops = together[:0], stops[:0]
        others = self._each([w for w, p in zip(new, plain.tolist(), strict=True) if not p])
        sizes, begin = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        sizes[plain], sizes[~plain] = np.diff(stops, prepend=0), [len(x) for x in others]
        begin[plain], begin[~plain] = np.append(0, stops)[:-1], len(together) + np.cumsum(sizes[~plain]) - sizes[~plain]
        self.flat = np.concatenate([self.flat, np.concatenate([together, *others])[spread(begin, sizes)]])
        self.sizes = np.concatenate([self.sizes, sizes])

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.sizes) >= WORDS_KEPT:
            self._forget()
        lowered = [t.lower() for t in texts]
        apart = [any(s in t for s in self.special) for t in lowered]
        words = [[] if a else APART.sub(rb" \1", t).split() for t, a in zip(lowered, apart, strict=True)]
        codes = np.fromiter(map(self.code.__getitem__, itertools.chain.from_iterable(words)), np.int64)
        if len(self.code) > len(self.sizes):
            self._learn(list(itertools.islice(self.code, len(self.sizes), None)))
        sizes = self.sizes[codes]
        ids = self.flat[spread((np.cumsum(self.sizes) - self.sizes)[codes], sizes)]
        upto = np.append(0, np.cumsum(sizes))[np.cumsum([0, *map(len, words)])].tolist()
        return [self._each([t])[0] if a else ids[lo:hi] for t, a, lo, hi in zip(texts, apart, upto, upto[1:], strict=False)]


def lengths_of(total: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of total ids, in order."""
    found = [(capacity, 1)] * (total // capacity)
    rest = total % capacity
    while rest:
        k = capacity // rest
        own = rest if capacity - k * rest <= slack * capacity or k >= 1 / slack else capacity // (k + 1)
        found.append((own, capacity // own))
        rest -= own
    return found


def cut_pieces(docs: DataFrame, keep: list[str], tokenizer: str, text_col: str = "text", capacity: int = CAPACITY, slack: float = SLACK) -> DataFrame:
    """keep, start, length, ids_crc32 and doc_tokens of every piece; its class; and the task and its number there."""
    picked = docs.select(*keep, docs[text_col].cast("binary").alias("__text"))
    added = {"start": T.LongType(), "length": T.LongType(), "ids_crc32": T.LongType(), "doc_tokens": T.LongType(), "__class": T.IntegerType(), "__part": T.IntegerType(), "__rank": T.LongType()}
    schema = T.StructType([*picked.select(*keep).schema.fields, *[T.StructField(n, t) for n, t in added.items()]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = WordEncoder(tokenizer), TaskContext.get().partitionId()
        numbers = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            column = pc.fill_null(batch.column(len(keep)), b"")
            for lo, hi in pieces(column):
                rows: list[tuple] = []
                for i, ids in enumerate(encoder(column.slice(lo, hi - lo).to_pylist()), lo):
                    whole = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    start = 0
                    for length, k in lengths_of(len(whole), capacity, slack):
                        rows.append((i, start, length, zlib.crc32(whole[start : start + length].tobytes()), len(whole), k, part, int(numbers[k])))
                        numbers[k] += 1
                        start += length
                at, *columns = map(list, zip(*rows, strict=True))
                kept = [c.take(pa.array(at)) for c in batch.columns[: len(keep)]]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, f.type) for c, f in zip(columns, list(arrow)[len(keep) :], strict=True)]], schema=arrow)

    return picked.mapInArrow(tidied(run), schema)


def _first_fit(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Sequences and offsets for the pieces that no class's full sequence holds, by falling length."""
    order = np.lexsort((pdf["__rank"], pdf["__part"], pdf["__class"], -pdf["length"]))
    left: list[int] = []
    sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
    for at, length in zip(order.tolist(), pdf["length"].to_numpy()[order].tolist(), strict=True):
        own = next((i for i, room in enumerate(left) if room >= length), len(left))
        if own == len(left):
            left.append(capacity)
        sequence[at], offset[at] = own, capacity - left[own]
        left[own] -= length
    return pdf.assign(sequence_id=pdf["sequence_id"] + sequence, offset=offset)


def pack(docs: DataFrame, keep: list[str], tokenizer: str, text_col: str = "text", capacity: int = CAPACITY, slack: float = SLACK) -> DataFrame:
    """keep, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece of every document."""
    keep = [c for c in keep if c not in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    found = cut(cut_pieces(docs, keep, tokenizer, text_col, capacity, slack), "pieces")
    counts = found.groupBy("__class", "__part").agg(F.count(F.lit(1)).alias("__n"))
    # The pieces of the class in the tasks before.
    before = Window.partitionBy("__class").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(counts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))), "bases")
    # A row for each class, as few as the capacity allows: its full sequences stand before those of the next class.
    full = bases.groupBy("__class").agg(F.expr("sum(__n) div __class").alias("__full"))
    upto = Window.orderBy("__class").rowsBetween(Window.unboundedPreceding, -1)
    first = full.withColumn("__first", F.coalesce(F.sum("__full").over(upto), F.lit(0)))
    every = F.lit(full.agg(F.coalesce(F.sum("__full"), F.lit(0))).first()[0]).cast("long")
    numbered = found.join(bounded(bases).drop("__n"), ["__class", "__part"]).join(F.broadcast(first), "__class")
    place = F.expr("(__base + __rank) div __class")
    placed = numbered.withColumn("sequence_id", F.when(place < F.col("__full"), F.col("__first") + place))
    within = Window.partitionBy("sequence_id").orderBy("__part", "__rank").rowsBetween(Window.unboundedPreceding, -1)
    out = [*keep, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = placed.where("sequence_id is not null").withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)))
    rest = placed.where("sequence_id is null").withColumn("sequence_id", every).withColumn("offset", F.lit(0).cast("long"))
    rest = rest.select(*out, "__class", "__part", "__rank").groupBy().applyInPandas(lambda pdf: _first_fit(pdf, capacity), rest.select(*out, "__class", "__part", "__rank").schema)
    return whole.select(*out).unionByName(rest.select(*out))
