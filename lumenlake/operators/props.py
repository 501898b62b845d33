"""JSON that rows carry, such as the properties of events or the summaries of jobs, as VARIANT: parsed once, bad text tolerated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(rows: DataFrame, column: str, into: str = "props") -> DataFrame:
    """The rows with the column's JSON as a VARIANT; text that is none becomes null."""
    return rows.withColumn(into, F.try_parse_json(column))


def prop(variant: str, path: str, kind: str = "string") -> Column:
    """What stands at a path such as $.a.b[0], as kind; null where it is missing or of another kind."""
    return F.try_variant_get(variant, path, kind)


def entries(rows: DataFrame, variant: str) -> DataFrame:
    """A row for each member of an object or element of an array: pos, key and value (a VARIANT) beside the row's columns; none for other values."""
    members = rows.sparkSession.tvf.variant_explode(F.col(variant).outer())
    return rows.lateralJoin(members)


def counted(rows: DataFrame, by: str, column: str, path: str) -> DataFrame:
    """Per value of by: rows, rows whose JSON is bad, and of the number at path how many there are, their sum and how many differ."""
    known = parsed(rows, column, "__v")
    value = prop("__v", path, "long")
    return known.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(column).isNotNull() & F.col("__v").isNull()).alias("bad"),
        F.count(value).alias("known"),
        F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("total"),
        F.count_distinct(value).alias("different"),
    )
