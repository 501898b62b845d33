"""Duplicate detection: exact and fingerprint groups, waste, reports, keep-one policies, cleanup queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions.exprs import half_up, slashed

KEEP = ("oldest", "newest", "highest_res", "shortest_path")


def exact_groups(files: DataFrame, key: str = "content_hash") -> DataFrame:
    """Hashes of two or more files, with count, bytes, and waste in both forms: all but the largest, and all but the mean."""
    by = files.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("size_bytes").alias("largest"), F.sum("size_bytes").cast("long").alias("total"))
    mean_waste = half_up((F.col("n") - 1) * (F.col("total") / F.col("n"))).cast("long")
    return by.where("n > 1").withColumn("wasted", ((F.col("n") - 1) * F.col("largest")).cast("long")).withColumn("mean_wasted", mean_waste)


def summary(files: DataFrame) -> DataFrame:
    """Number of exact groups and what they waste."""
    return exact_groups(files).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("wasted"), F.lit(0)).cast("long").alias("wasted"))


def fingerprint_groups(files: DataFrame, fingerprint: str = "quick_fingerprint", content: str = "content_hash") -> DataFrame:
    """Fingerprints of two or more files that are no single exact group: one hash and no other is left to exact_groups.

    A missing hash counts for nothing, so a group of one hash and nulls is left out too; empty fingerprints are none. files may be a join
    in which a file stands more than once: n counts it once, total adds up every row.
    """
    by = files.where(F.col(fingerprint) != "").groupBy(fingerprint).agg(F.count_distinct("id").alias("n"), F.count_distinct(content).alias("hashes"), F.min(content).alias("first_hash"), F.sum("size_bytes").cast("long").alias("total"))
    one = (F.col("hashes") == 1) & F.col("first_hash").isNotNull()
    return by.where((F.col("n") > 1) & ~one).withColumn("mean_wasted", half_up((F.col("n") - 1) * (F.col("total") / F.col("n"))).cast("long")).drop("first_hash")


def report(files: DataFrame, number: int = 1, size: int = 20, members: int = 10) -> DataFrame:
    """Exact and fingerprint groups ranked by waste, a page of them, each with its first members by path.

    Groups are aggregates; only the page's groups meet the files again, and members are ranked in a window per
    group, which Spark limits before the shuffle.
    """
    exact = exact_groups(files).select(F.lit("EXACT").alias("kind"), F.lit(5).alias("confidence"), F.col("content_hash").alias("group_key"), "n", F.col("mean_wasted").alias("wasted"))
    alike = fingerprint_groups(files).select(F.lit("FINGERPRINT").alias("kind"), F.lit(4).alias("confidence"), F.col("quick_fingerprint").alias("group_key"), "n", F.col("mean_wasted").alias("wasted"))
    ranked = exact.unionByName(alike).orderBy(F.desc("wasted"), "kind", "group_key").offset((number - 1) * size).limit(size)
    keyed = files.select("id", "relative_path", F.explode(F.array(F.struct(F.lit("EXACT").alias("kind"), F.col("content_hash").alias("group_key")), F.struct(F.lit("FINGERPRINT").alias("kind"), F.col("quick_fingerprint").alias("group_key")))).alias("of")).select("id", "relative_path", "of.*")
    held = keyed.join(F.broadcast(ranked), ["kind", "group_key"])  # a page of rows
    held = held.withColumn("place", F.row_number().over(Window.partitionBy("kind", "group_key").orderBy("relative_path", "id"))).where(F.col("place") <= members)
    by = held.groupBy("kind", "group_key", "confidence", "n", "wasted").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("m"))
    return by.withColumn("members", F.array_join(F.transform("m", lambda x: x["id"].cast("string")), ",")).drop("m")


def report_joined(indexed: DataFrame, media: DataFrame, number: int = 1, size: int = 20, members: int = 10) -> DataFrame:
    """A page of the groups of two tables, ranked by waste, as rows: a member each, with what either table knows of it.

    Exact groups come from indexed alone and its members may lack media; fingerprint groups come from the join of both by path, in which an
    indexed file may stand more than once. Both have the columns path; media has id and a fingerprint. Paths are joined once.
    """
    at = lambda df, name: df.withColumn(name, slashed(F.col("path"))).drop("path")
    facts = ["width", "height", "date_taken", "date_created", "camera_make", "camera_model"]
    known = at(media, "__at").select("__at", F.col("id").alias("media_id"), "quick_fingerprint", *facts)
    both = at(indexed, "__at").select("__at", F.col("id").alias("file_id"), "size_bytes", "content_hash").join(known, "__at", "left").withColumnRenamed("__at", "path")
    exact = exact_groups(indexed).select(F.lit("EXACT").alias("kind"), F.lit(5).alias("confidence"), F.col("content_hash").alias("group_key"), "n", F.col("mean_wasted").alias("wasted"))
    joined = both.where(F.col("media_id").isNotNull()).select(F.col("media_id").alias("id"), "quick_fingerprint", "content_hash", "size_bytes")
    alike = fingerprint_groups(joined).select(F.lit("FINGERPRINT").alias("kind"), F.lit(4).alias("confidence"), F.col("quick_fingerprint").alias("group_key"), "n", F.col("mean_wasted").alias("wasted"))
    ranked = exact.unionByName(alike).orderBy(F.desc("wasted"), "kind", "group_key").offset((number - 1) * size).limit(size)
    keys = F.array(F.struct(F.lit("EXACT").alias("kind"), F.col("content_hash").alias("group_key")), F.struct(F.lit("FINGERPRINT").alias("kind"), F.col("quick_fingerprint").alias("group_key")))
    held = both.withColumn("of", F.explode(keys)).select("of.*", "file_id", "path", "size_bytes", "media_id", *facts).join(F.broadcast(ranked), ["kind", "group_key"])  # a page of rows
    place = F.row_number().over(Window.partitionBy("kind", "group_key").orderBy("path", "file_id", "media_id"))
    return held.withColumn("place", place).where(F.col("place") <= members)


def members(files: DataFrame) -> DataFrame:
    """The files of exact groups, by a semi join."""
    return files.join(exact_groups(files).select("content_hash"), "content_hash", "left_semi")


def keep_rank(preset: str) -> Column:
    """What a preset prefers least of: the earliest date taken, created or modified; the latest modified or created; the most pixels; the fewest parts of a path."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    if preset == "oldest":
        return micros(F.coalesce("date_taken", "date_created", "modified_at"))
    if preset == "newest":
        return -micros(F.coalesce("modified_at", "date_created"))
    if preset == "highest_res":
        pixels = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
        return -(pixels("width") * pixels("height"))
    if preset == "shortest_path":
        return F.size(F.split("relative_path", r"[/\\]")).cast("long")
    raise ValueError(f"preset must be one of {', '.join(KEEP)}")


def keep_one(files: DataFrame, preset: str, key: str = "content_hash") -> DataFrame:
    """Every file of a group of two or more, with the file to keep: unknown values last, ties to the smaller id.

    The keeper is a minimum, so that it is combined before the shuffle.
    """
    rank = keep_rank(preset)
    best = files.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(rank.isNull().alias("unknown"), rank.alias("rank"), F.col("id").alias("keep_id"))).alias("best")).where("n > 1")
    return files.join(best.select(key, "n", F.col("best.keep_id").alias("keep_id")), key).withColumn("keep", F.col("id") == F.col("keep_id"))


def grouped(files: DataFrame, where: Column | None = None) -> DataFrame:
    """Exact groups as rows: each file of a group with the group's hash, largest size and number of files; where narrows both.

    Rows instead of lists, so that a group of any number of files is whole and no task holds it.
    """
    some = files if where is None else files.where(where)
    groups = exact_groups(some).select("content_hash", F.col("largest").alias("group_size"), "n")
    return some.join(groups, "content_hash")


def two_stage(files: DataFrame, full_hash: Column) -> DataFrame:
    """Groups confirmed by a full hash; only files that share size and fingerprint are hashed."""
    suspects = files.groupBy("size_bytes", "quick_fingerprint").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("size_bytes", "quick_fingerprint")
    hashed = files.join(suspects, ["size_bytes", "quick_fingerprint"], "left_semi").withColumn("full_hash", full_hash)
    return hashed.groupBy("full_hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


def cleanup_summary(files: DataFrame, dated: DataFrame, cutoff: Column, large: int) -> DataFrame:
    """One row: duplicate groups, waste, large files and old items."""
    dups = summary(files)
    big = files.agg(F.count_if(F.col("size_bytes") >= large).alias("large_files"), F.coalesce(F.sum(F.when(F.col("size_bytes") >= large, F.col("size_bytes"))), F.lit(0)).cast("long").alias("large_size"))
    old = dated.agg(F.count_if(F.col("dated") < cutoff).alias("old_items"))
    return dups.join(F.broadcast(big), F.lit(True)).join(F.broadcast(old), F.lit(True))


def queue(entries: DataFrame, removed: DataFrame | None = None, key: str = "group_hash", newest: str = "added_at") -> DataFrame:
    """The cleanup queue: the latest entry of each group (of equal times, the one of the largest values), without the groups removed."""
    values = F.struct(newest, *[c for c in entries.columns if c not in (key, newest)])
    latest = entries.groupBy(key).agg(F.max(values).alias("last")).select(key, "last.*").select(*entries.columns)
    return latest if removed is None else latest.join(removed.select(key), key, "left_anti")


def queue_savings(entries: DataFrame, saved: str = "saved") -> DataFrame:
    """Groups in the queue and what they save together."""
    return entries.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(saved), F.lit(0)).cast("long").alias("saved"))


def expired(trash: DataFrame, now: Column) -> DataFrame:
    """Trash rows, newest first, with the flag whether they are past their date; a row without a date never is."""
    return trash.withColumn("expired", F.coalesce(F.col("expires_at") < now, F.lit(False)))


def restorable(trash: DataFrame, wanted: DataFrame, present: DataFrame, now: Column, key: str = "trash_path") -> DataFrame:
    """For each path to restore: ok, or why not (unknown, expired, occupied: a file stands at its old place)."""
    known = expired(trash, now).select(key, "original_path", "expired")
    there = present.select(F.col("path").alias("original_path"), F.lit(True).alias("there")).distinct()
    both = wanted.select(key).distinct().join(known, key, "left").join(there, "original_path", "left")
    return both.select(key, F.when(F.col("expired").isNull(), "unknown").when(F.col("expired"), "expired").when(F.col("there"), "occupied").otherwise("ok").alias("state"))
