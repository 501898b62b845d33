"""Related items: shared collections, the same day or place, neighbours in time, best rows per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions.exprs import slashed


def same_collection(bridge: DataFrame, item: int, collection: str, member: str, n: int = 12) -> DataFrame:
    """Other members of the item's collections, the first n of each, by member.

    The item's collections are found first and meet the bridge in a semi join.
    """
    mine = bridge.where(F.col(member) == item).select(collection).distinct()
    others = bridge.join(mine, collection, "left_semi").where(F.col(member) != item).select(collection, member).distinct()
    return others.withColumn("place", F.row_number().over(Window.partitionBy(collection).orderBy(member))).where(F.col("place") <= n)


def best_per_group(rows: DataFrame, group: str, score: str, id_col: str) -> DataFrame:
    """The row of the best score of each group, ties to the smaller id."""
    by = Window.partitionBy(group).orderBy(F.desc_nulls_last(score), id_col)
    return rows.withColumn("rn", F.row_number().over(by)).where("rn = 1").drop("rn")


def neighbours(items: DataFrame, when: str, id_col: str, key: str) -> DataFrame:
    """For each row the ids before and after it in strictly earlier and later time within its key.

    Rows of one time share their neighbours: the largest id of the latest earlier time, the smallest of the earliest
    later one. Times are aggregated first, so the window runs over distinct times.
    """
    times = items.groupBy(key, when).agg(F.min(id_col).alias("lo"), F.max(id_col).alias("hi"))
    by = Window.partitionBy(key).orderBy(when)
    near = times.select(key, when, F.lag("hi").over(by).alias("prev_id"), F.lead("lo").over(by).alias("next_id"))
    return items.join(near, [key, when]).select(id_col, "prev_id", "next_id")


def neighbour_of(items: DataFrame, when: str, id_col: str, moment: Column) -> DataFrame:
    """The rows just before and just after a moment, as two point look-ups."""
    before = items.where(F.col(when) < moment).orderBy(F.desc(when), F.desc(id_col)).limit(1).select(F.lit("prev").alias("side"), id_col)
    after = items.where(F.col(when) > moment).orderBy(when, id_col).limit(1).select(F.lit("next").alias("side"), id_col)
    return before.unionByName(after)


def near_place(places: DataFrame, lat: float, lon: float, degrees: float = 0.05) -> DataFrame:
    """Places within a box around a point."""
    within = lambda c, x: F.abs(F.col(c) - F.lit(str(x)).cast("decimal(12,6)")) < F.lit(str(degrees)).cast("decimal(12,6)")
    return places.where(within("lat", lat) & within("lon", lon))


def near_counts(places: DataFrame, degrees: str = "0.05") -> DataFrame:
    """Per place, how many other places stand in the box around it: less than degrees away in latitude and in longitude.

    Places of one point are counted together. Points lie in cells of a box's size, so that what is near lies in the cell or one of the eight
    around it: an equi-join of cells, then the exact test; unlike a comparison of all with all, it costs what is near. Places without a point have none.
    """
    step = F.lit(degrees).cast("decimal(12,6)")
    known = places.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    points = known.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n")).withColumns({"x": F.floor(F.col("lat") / step), "y": F.floor(F.col("lon") / step)})
    shifts = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    around = points.select("lat", "lon", "x", "y", shifts.alias("s")).select("lat", "lon", (F.col("x") + F.col("s.i")).alias("x"), (F.col("y") + F.col("s.j")).alias("y"))
    other = points.select(F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "n", "x", "y")
    near = around.join(other, ["x", "y"]).where((F.abs(F.col("lat") - F.col("lat2")) < step) & (F.abs(F.col("lon") - F.col("lon2")) < step))
    sums = near.groupBy("lat", "lon").agg((F.sum("n") - 1).alias("near"))
    return places.join(sums, ["lat", "lon"], "left").withColumn("near", F.coalesce("near", F.lit(0)).cast("long"))


def pending(files: DataFrame, done: DataFrame, key: str, version: str, least: int) -> DataFrame:
    """Files without a result of the version or a later one."""
    return files.join(done.where(F.col(version) >= least).select(key), key, "left_anti")


def people_counts(faces: DataFrame, person: str, item: str) -> DataFrame:
    """Distinct items per person."""
    return faces.groupBy(person).agg(F.count_distinct(item).alias("items"), F.count(F.lit(1)).alias("faces"))


def threads(messages: DataFrame, key: str = "conv_id", place: str = "turn") -> DataFrame:
    """Per conversation: messages, roles and the first and last turn."""
    return messages.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "user").alias("user_turns"), F.min(place).alias("first_turn"), F.max(place).alias("last_turn"), F.sum(F.length("text")).cast("long").alias("chars"))


def ordered_messages(headers: DataFrame, messages: DataFrame, key: str, place: str) -> DataFrame:
    """Each header's messages in their order: header columns, then the message's; nth counts from 1."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(place))
    return headers.join(messages.withColumn("nth", nth), key).orderBy(key, "nth")


def with_people(files: DataFrame, people: list[str], but: int | None = None, column: str = "people") -> DataFrame:
    """Files on which any of the people is tagged, ignoring case, the latest taken first; but: a file to leave out."""
    wanted = [p.lower() for p in people]
    tagged = F.exists(column, lambda p: F.lower(p).isin(*wanted))
    return files.where(tagged & (F.col("id") != but if but is not None else F.lit(True))).orderBy(F.desc_nulls_last("date_taken"), "id")


def named_faces(faces: DataFrame, people: DataFrame, person: str = "person_id") -> DataFrame:
    """Every face with its person's name, if it has one."""
    names = people.select(F.col("id").alias(person), F.col("name").alias("person_name"))
    return faces.join(names, person, "left")


def by_path(media: DataFrame, indexed: DataFrame, own: Column, path: Column, how: str = "inner") -> DataFrame:
    """The join of two tables of files by their full paths, whichever slashes either side has.

    Both keys are worked out first, so that the join is an equi-join that Spark may sort or broadcast.
    """
    left, right = media.withColumn("__path", slashed(own)), indexed.withColumn("__path", slashed(path))
    return left.join(right, "__path", how).drop("__path")
