"""Helpers shared by the corpus operators: cutting lineage, row streams by unit, and fixed expressions."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: ASCII whitespace, as a class body for Java and Python regular expressions.
SPACE = r"\x20\x09-\x0D"
#: Bytes of values, at most, of a side that is broadcast; larger ones are shuffled.
BROADCAST_BYTES = 32_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Where spark.checkpoint.dir is unset a temporary folder is used, in local mode only.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lumenlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _folder(spark: SparkSession) -> str:
    """The shared folder's part for this application."""
    return f"{shared_dir(spark)}/lumenlake/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)  # noqa: SLF001
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001


def clean(spark: SparkSession) -> None:
    """Delete all tables of this application in the shared folder, once nothing reads them any more."""
    _delete(spark, _folder(spark))


def cut(df: DataFrame, name: str, below: str = "") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, which ends its lineage there."""
    path = f"{below or _folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder for tables that a piece of work needs until its result is written; they go when it ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder = spark, f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def __enter__(self) -> Callable[[DataFrame, str], DataFrame]:
        return lambda df, name: cut(df, name, self.folder)

    def __exit__(self, *why: object) -> None:
        _delete(self.spark, self.folder)


def bounded(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its values have BROADCAST_BYTES at most; else joins shuffle it. Sums df up, so it should be a table."""
    open_ended = [F.octet_length(f.name) for f in df.schema if isinstance(f.dataType, T.StringType | T.BinaryType)]
    open_ended += [8 * F.size(f.name) for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    width = F.lit(8 * len(df.columns)).cast("long")
    for part in open_ended:
        width += F.coalesce(part, F.lit(0))
    total = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % mod


def joined_spans(spans: Column) -> Column:
    """kind:start:end of an array of spans, comma-joined, in the array's order."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, which gives what it no longer needs back to the system at its end: Python workers outlive tasks, and stand idle beside others."""

    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidy


def pieces(column: pa.Array, most_bytes: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs of a text column with about most_bytes bytes each; a longer text stands alone."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(column):
        before = int(upto[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + most_bytes, "right")))
        yield start, stop
        start = stop


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ..., size numbers from each begin on."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


def map_texts(df: DataFrame, keep: list[str], text_col: str, fields: list[T.StructField], begin: Callable[[], Callable[[list[str | None]], list]]) -> DataFrame:
    """The keep columns of every row, untouched, and the columns of begin()(texts), typed as fields.

    A kept column with the name of a field gives way to it. Each task begins anew, so that what it builds ends with it; texts become
    Python strings a few megabytes at a time.
    """
    keep = [c for c in keep if c not in {f.name for f in fields}]
    picked = df.select(*keep, df[text_col].alias("__text"))
    schema = T.StructType([*picked.select(*keep).schema.fields, *fields])
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = begin()
        for batch in batches:
            column = batch.column(len(keep))
            for lo, hi in pieces(column):
                new = [pa.array(c, t) for c, t in zip(work(column.slice(lo, hi - lo).to_pylist()), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[: len(keep)], *new], schema.names)

    return picked.mapInArrow(tidied(run), schema)


def replace_texts(df: DataFrame, text_col: str, work: Callable[[list[str | None]], list[str | None]], length_col: str | None = None) -> DataFrame:
    """The same rows and columns with work(texts) for the texts; length_col, if there, follows the length of a text that changed."""
    place = df.columns.index(text_col)
    sized = df.columns.index(length_col) if length_col in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in pieces(batch.column(place)):
                columns = batch.slice(lo, hi - lo).columns
                old = columns[place].to_pylist()
                new = work(old)
                columns[place] = pa.array(new, columns[place].type)
                if sized is not None:
                    sizes = [n if a == b else len(b) for n, a, b in zip(columns[sized].to_pylist(), old, new, strict=True)]
                    columns[sized] = pa.array(sizes, columns[sized].type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return df.mapInArrow(tidied(run), df.schema)


def filter_texts(df: DataFrame, text_col: str, begin: Callable[[], Callable[[list[str | None]], list[bool]]]) -> DataFrame:
    """The rows, unchanged, for which begin()(texts) is true; each task begins anew."""
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = begin()
        for batch in batches:
            for lo, hi in pieces(batch.column(place)):
                some = batch.slice(lo, hi - lo)
                yield some.filter(pa.array(work(some.column(place).to_pylist()), pa.bool_()))

    return df.mapInArrow(tidied(run), df.schema)


def map_units(df: DataFrame, key: str, solve: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """solve() for all rows of each key at a time; keys must have bounded numbers of rows.

    Rows are dealt by key and sorted, so that many small units share a task and an Arrow batch.
    """

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for pdf in batches:
            while len(pdf):
                last = pdf[key].iloc[-1]
                if rest and rest[0][key].iloc[0] == last and pdf[key].iloc[0] == last:
                    rest.append(pdf)
                    break
                cut_at = int((pdf[key] != last).to_numpy().nonzero()[0][-1]) + 1 if pdf[key].iloc[0] != last else 0
                whole = pd.concat([*rest, pdf.iloc[:cut_at]]) if rest else pdf.iloc[:cut_at]
                if len(whole):
                    out = [solve(unit) for _, unit in whole.groupby(key, sort=False)]
                    if out := [x for x in out if len(x)]:
                        yield pd.concat(out)
                rest = [pdf.iloc[cut_at:]]
                break
        if rest:
            whole = pd.concat(rest)
            if out := [x for _, unit in whole.groupby(key, sort=False) if len(x := solve(unit))]:
                yield pd.concat(out)

    dealt = df.repartition(F.col(key)).sortWithinPartitions(key)
    return dealt.mapInPandas(tidied(stream), schema)
