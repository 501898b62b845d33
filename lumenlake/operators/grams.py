"""Substring search by trigrams: posting lists of every three characters, intersected, then verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE = 3
#: Files that the rows are dealt to; each is sorted by gram, so that a search reads the parts of its grams.
FILES = 64
#: Postings, about, that a task sorts at once.
CHUNK = 1 << 21


def gram_list(text: str) -> list[str]:
    """The distinct grams of a pattern, which is taken as it stands: % and _ are characters like others."""
    low = text.lower()
    return sorted({low[i : i + SIZE] for i in range(len(low) - SIZE + 1)})


def _lists(ids: pa.Array, codes: list[np.ndarray]) -> pa.RecordBatch:
    """gram and ids of some rows, by gram; codes: each row's distinct grams as numbers."""
    row = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    code = np.concatenate(codes)
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    chars = np.stack([code[first] >> 42, (code[first] >> 21) & 0x1FFFFF, code[first] & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    grams = [chars[i : i + SIZE] for i in range(0, len(chars), SIZE)]
    offsets = pa.array(np.append(first, len(code)), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.ListArray.from_arrays(offsets, ids.take(pa.array(row)))], ["gram", "ids"])


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, codes, n = 0, [], 0
        for stop, text in enumerate(batch.column(1), 1):
            chars = np.frombuffer((text.as_py() or "").encode("utf-32-le"), "<u4").astype(np.int64)
            codes.append(np.unique(chars[:-2] << 42 | chars[1:-1] << 21 | chars[2:]))
            n += len(codes[-1])
            if n >= CHUNK or (n and stop == batch.num_rows):
                yield _lists(batch.column(0).slice(at, stop - at), codes)
                at, codes, n = stop, [], 0


def postings(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """gram and ids of the rows with it, a row for each gram of some rows: each row's distinct grams of its lower-cased text. Null and shorter texts have none."""
    known = rows.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"))
    return known.mapInArrow(_posted, T.StructType([T.StructField("gram", T.StringType()), T.StructField("ids", T.ArrayType(known.schema["id"].dataType))]))


def write_index(rows: DataFrame, id_col: str, text_col: str, folder: str, files: int = FILES) -> DataFrame:
    """The posting lists as a table whose files are sorted by gram: a search's filters pass over the pages of other grams. Rows are dealt to files before they become postings."""
    dealt = rows.select(id_col, text_col).repartition(files, F.xxhash64(id_col, text_col))
    found = postings(dealt, id_col, text_col)
    found.sortWithinPartitions("gram").write.parquet(folder)
    return rows.sparkSession.read.schema(found.schema).parquet(folder)


def _counted(index: DataFrame, wanted: list[list[str]]) -> DataFrame:
    """id, and n0, n1, ...: how many of each list's grams a row has, at least; a common gram's list is counted in the tasks that read it."""
    some = index.where(F.col("gram").isin(sorted({g for grams in wanted for g in grams})))
    has = [F.col("gram").isin(grams).cast("int").alias(f"g{i}") for i, grams in enumerate(wanted)]
    return some.select(F.explode("ids").alias("id"), *has).groupBy("id").agg(*[F.sum(f"g{i}").alias(f"n{i}") for i in range(len(wanted))])


def candidates(index: DataFrame, pattern: str) -> DataFrame:
    """id of the rows that have all of the pattern's grams; a common gram's list is counted in the tasks that read it."""
    wanted = gram_list(pattern)
    if not wanted:
        raise ValueError(f"a pattern has {SIZE} characters at least")
    return _counted(index, [wanted]).where(F.col("n0") >= len(wanted)).select("id")


def _contains(text: Column, pattern: str) -> Column:
    return F.contains(text, F.lit(pattern.lower()))


def search(rows: DataFrame, index: DataFrame, pattern: str, id_col: str, text_col: str) -> DataFrame:
    """The rows whose text contains the pattern, whatever the case. Shorter patterns have no grams, and are looked for in all rows."""
    if len(pattern.lower()) >= SIZE:
        rows = rows.join(candidates(index, pattern).withColumnRenamed("id", "__id"), F.col(id_col).eqNullSafe(F.col("__id")), "left_semi")
    return rows.where(_contains(F.lower(text_col), pattern))


def search_all(rows: DataFrame, index: DataFrame, patterns: list[str], id_col: str, text_col: str) -> DataFrame:
    """pattern and id of the rows that contain it, for each of some patterns: rows and index are read once for all."""
    long = [p for p in patterns if gram_list(p)]
    texts = rows.select(id_col, F.lower(text_col).alias("__text"))
    maybe = {}
    if long:
        wanted = [gram_list(p) for p in dict.fromkeys(long)]
        enough = [F.col(f"n{i}") >= len(grams) for i, grams in enumerate(wanted)]
        some = _counted(index, wanted).select(F.col("id").alias("__id"), *[e.alias(f"__{i}") for i, e in enumerate(enough)])
        texts = texts.join(some, F.col(id_col).eqNullSafe(F.col("__id")), "inner" if len(long) == len(patterns) else "left")
        maybe = {p: F.col(f"__{i}") for i, p in enumerate(dict.fromkeys(long))}
    told = [F.when(maybe.get(p, F.lit(True)) & _contains(F.col("__text"), p), F.lit(p)) for p in patterns]
    return texts.select(F.explode(F.array_compact(F.array(*told))).alias("pattern"), id_col)
