"""Places of rows in one order over a whole table, for deep pages and neighbours, without a task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where a row's number within its partition stands in a monotonic id.
_WITHIN = (1 << 33) - 1


class Ranked:
    """The rows in a total order, with their places from 1, as a table in folder.

    Rows are dealt by ranges of the order, sorted within them, and written once, so that partitions stay what they are; the sizes of the partitions before
    each turn numbers within them into places. Order is total: ties may fall either way. The driver sees a row for each partition.
    """

    def __init__(self, rows: DataFrame, order: list[Column], folder: str, partitions: int | None = None) -> None:
        dealt = rows.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
        numbered = dealt.withColumns({"__part": F.spark_partition_id(), "__nth": F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN))})
        numbered.write.parquet(folder)
        table = rows.sparkSession.read.schema(numbered.schema).parquet(folder)
        sizes = sorted((r["__part"], r["n"]) for r in table.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
        before, total = {}, 0
        for part, n in sizes:
            before[part], total = total, total + n
        self.table, self.before, self.total = table, before, total

    def places(self) -> DataFrame:
        """All rows with their place; no shuffle."""
        if not self.before:
            return self.table.withColumn("place", F.lit(0).cast("long")).drop("__part", "__nth")
        known = F.array(*[F.lit(self.before.get(i, 0)).cast("long") for i in range(max(self.before) + 1)])
        return self.table.withColumn("place", F.get(known, F.col("__part")) + F.col("__nth") + 1).drop("__part", "__nth")

    def page(self, number: int, size: int) -> DataFrame:
        """The rows of a page, however deep: only the partitions that hold it are read, and filters reach their files."""
        first = (max(number, 1) - 1) * size
        parts = [p for p, start in self.before.items() if start < first + size and start + self._size(p) > first]
        some = self.table.where(F.col("__part").isin(parts)) if parts else self.table.limit(0)
        for p in parts[:1]:
            some = some.where((F.col("__part") > p) | (F.col("__nth") >= first - self.before[p]))
        for p in parts[-1:]:
            some = some.where((F.col("__part") < p) | (F.col("__nth") < first + size - self.before[p]))
        start = F.array(*[F.lit(self.before.get(i, 0)).cast("long") for i in range(max(parts, default=0) + 1)])
        return some.withColumn("place", F.get(start, F.col("__part")) + F.col("__nth") + 1).drop("__part", "__nth")

    def _size(self, part: int) -> int:
        later = [s for p, s in self.before.items() if p > part]
        return min(later, default=self.total) - self.before[part]

    def neighbours(self, id_col: str) -> DataFrame:
        """id, prev_id and next_id of every row: within partitions by a window, across them by the rows at their edges, one or two for each."""
        by = Window.partitionBy("__part").orderBy("__nth")
        near = self.table.select("__part", "__nth", id_col, F.lag(id_col).over(by).alias("prev_id"), F.lead(id_col).over(by).alias("next_id"))
        ends = self.table.groupBy("__part").agg(F.min_by(id_col, "__nth").alias("first"), F.max_by(id_col, "__nth").alias("last"))
        own = {r["__part"]: (r["first"], r["last"]) for r in ends.collect()}
        parts, rows = sorted(own), []
        for i, p in enumerate(parts):
            rows.append((p, self._size(p) - 1, own[parts[i - 1]][1] if i else None, own[parts[i + 1]][0] if i + 1 < len(parts) else None))
        kind = dict(self.table.dtypes)[id_col]
        edges = F.broadcast(self.table.sparkSession.createDataFrame(rows, f"__part int, __end long, __before {kind}, __after {kind}"))  # a row for each partition
        both = near.join(edges, "__part")
        return both.select(id_col, F.when(F.col("__nth") == 0, F.col("__before")).otherwise(F.col("prev_id")).alias("prev_id"), F.when(F.col("__nth") == F.col("__end"), F.col("__after")).otherwise(F.col("next_id")).alias("next_id"))
