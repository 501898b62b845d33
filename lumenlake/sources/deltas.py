"""A table that takes upserts and deletions without being rewritten: a bucketed base, deltas by version, and their merge on reading.

The base is bucketed and sorted by the key; a delta is a small table of one version's rows. Reading folds each key's deltas in the order of their versions and
joins them to the base: only deltas move, as the base already stands in the join's buckets. Compaction writes the merge as the next base.
A version's table is written first and noted in the log after it, so one that was cut short is unseen, and one that is written again, as
after a crash, takes the place of itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "version long, kind string"
#: How long a stream gathers rows before it hands them on.
FLUSH_EVERY = "500 milliseconds"


class UpsertTable:
    """Rows by key. An upsert sets the update columns; those of protect only where it has a value; any others keep what the base has.

    Keys are not null: rows without one are left out. Of a version's rows of one key the one of the greatest values counts, and a deletion before
    all of them. Deleted rows are gone with all they had: a later upsert of the key begins anew. An empty version changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str, key: str, update: list[str], protect: tuple[str, ...] = (), buckets: int = 16) -> None:
        self.spark, self.folder, self.name, self.key, self.buckets = spark, folder.rstrip("/"), name, key, buckets
        self.update, self.protect = list(update), list(protect)

    def _note(self, kind: str, version: int) -> None:
        self.spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(kind).alias("kind")).coalesce(1).write.mode("overwrite").json(f"{self.folder}/log/{kind}-{version:012d}")

    def versions(self) -> tuple[int, list[int]]:
        """The version of the latest base, and those of the deltas after it: a row for each in the log."""
        noted = [(r["version"], r["kind"]) for r in self.spark.read.schema(LOG).json(f"{self.folder}/log/*").collect()]
        base = max(v for v, kind in noted if kind == "base")
        return base, sorted(v for v, kind in noted if kind == "delta" and v > base)

    def _write_base(self, rows: DataFrame, version: int) -> None:
        name = f"{self.name}_{version}"
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # external: its files stay
        dealt = rows.where(F.col(self.key).isNotNull()).repartition(self.buckets, self.key)
        dealt.write.mode("overwrite").option("path", f"{self.folder}/base-{version}").bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(name)
        self._note("base", version)

    def _read_base(self, version: int) -> DataFrame:
        name = f"{self.name}_{version}"
        if not self.spark.catalog.tableExists(name):  # another session wrote it
            path = f"{self.folder}/base-{version}"
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(path).schema)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def create(self, rows: DataFrame) -> None:
        """The first base; keys are distinct."""
        self._write_base(rows, 0)

    def upsert(self, rows: DataFrame, version: int, deleted: str | None = None) -> bool:
        """Take rows, deletions where the column deleted is true, as a version; False if a base has it already."""
        base, _ = self.versions()
        if version <= base:
            return False
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        values = F.struct(*[F.col(c) for c in [*self.update, *self.protect]])
        # Of equal versions a deletion comes first, and the greatest values come last.
        one = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max(F.when(~gone, values)).alias("row"), F.max(gone).alias("deleted"))
        one.write.mode("overwrite").parquet(f"{self.folder}/delta-{version}")
        self._note("delta", version)
        return True

    def delete(self, keys: DataFrame, version: int) -> bool:
        """Take away the keys' rows, as a version."""
        columns = self.spark.table(f"{self.name}_{self.versions()[0]}").schema
        empty = [F.lit(None).cast(columns[c].dataType).alias(c) for c in [*self.update, *self.protect]]
        return self.upsert(keys.select(self.key, *empty, F.lit(True).alias("__gone")), version, "__gone")

    def read(self) -> DataFrame:
        """The rows as of the latest version."""
        base, later = self.versions()
        rows = self._read_base(base)
        if not later:
            return rows
        parts = [self.spark.read.parquet(f"{self.folder}/delta-{v}").withColumn("version", F.lit(v)) for v in later]
        # As many rows of a key meet as there are versions since the base.
        dealt = reduce(DataFrame.unionByName, parts).repartition(self.buckets, self.key)
        events = F.array_sort(F.collect_list(F.struct("version", "deleted", "row")))
        shape = dealt.schema["row"].dataType
        none = F.struct(F.lit(None).cast(shape).alias("row"), F.lit(False).alias("wiped"))

        def step(known, event):  # noqa: ANN001, ANN202
            before = F.when(~event["deleted"], known["row"])
            merged = F.struct(*[F.coalesce(event["row"][c], before[c]).alias(c) if c in self.protect else event["row"][c].alias(c) for c in shape.names])
            return F.struct(F.when(event["row"].isNull(), before).otherwise(merged).alias("row"), (known["wiped"] | event["deleted"]).alias("wiped"))

        folded = dealt.groupBy(self.key).agg(F.aggregate(events, none, step).alias("d")).select(self.key, F.col("d.row").alias("__row"), F.col("d.wiped").alias("__wiped"))
        both = rows.withColumn("__old", F.lit(True)).join(folded, self.key, "full_outer")
        fresh, wiped, old = F.col("__row"), F.coalesce("__wiped", F.lit(False)), F.col("__old").isNotNull()
        columns = []
        for c in rows.columns:
            mine = F.when(~wiped, F.col(c))
            if c in self.protect:
                mine = F.coalesce(fresh[c], mine)
            elif c in self.update:
                mine = F.when(fresh.isNotNull(), fresh[c]).otherwise(mine)
            columns.append(F.col(c) if c == self.key else mine.alias(c))
        return both.where(fresh.isNotNull() | (old & ~wiped)).select(*columns)

    def compact(self) -> None:
        """The merge as the next base; deltas that it has are not read any more."""
        _, later = self.versions()
        if later:
            self._write_base(self.read(), later[-1])

    def take_stream(self, rows: DataFrame, checkpoint: str, deleted: str | None = None, every: str | None = FLUSH_EVERY):  # noqa: ANN201
        """Upserts of a stream, a version for each of its batches: a batch that is done again after a crash writes the same version.

        Rows are gathered for every; without it, all at hand are taken and the stream ends. The checkpoint belongs to the table.
        """
        writer = rows.writeStream.foreachBatch(lambda some, batch: self._take(some, batch, deleted)).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

    def _take(self, rows: DataFrame, batch: int, deleted: str | None) -> None:
        self.upsert(rows, batch + 1, deleted)
