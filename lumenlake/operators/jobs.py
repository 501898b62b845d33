"""The job log: what can be resumed, what a scan touched, throughput, and the orders of work and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.exprs import media_type

# The order of media types in a listing, and in a queue of work.
INDEX_RANK = ("photo", "video", "document", "audio", "other")
QUEUE_RANK = ("photo", "document", "audio", "video", "other")
ACTIONS = ("NEW", "MODIFIED", "MOVED", "DELETED", "UNCHANGED")
MOST_QUEUED = 999_999_999_999
MOST_TOUCHED, MOST_RESUMABLE, RECENT = 500, 50, 5
SORT_KEYS = ("date", "files", "duration", "filesPerSec", "mbPerSec", "peakWorkers", "dirCache")


def _rank(kind: Column, order: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in order]), kind) - 1


def index_order(extension: Column, modified: Column, path: Column) -> list[Column]:
    """Photos first and others last, then the latest change, then the path."""
    return [_rank(media_type(extension), INDEX_RANK), modified.desc_nulls_last(), path]


def queue_score(extension: Column, size: Column) -> Column:
    """The type's rank times 10**12 and the size below that: smaller is sooner."""
    return (_rank(media_type(extension), QUEUE_RANK) * 10**12 + F.least(size, F.lit(MOST_QUEUED))).cast("long")


def folders_first(is_folder: Column, name: Column) -> list[Column]:
    """Folders before files, each by name as people sort: letters with their accents together, then lower before upper case (root locale)."""
    return [is_folder.desc(), F.collate(name, "UNICODE"), name]


def people_order(name: Column, faces: Column, id_col: Column) -> list[Column]:
    """The named before the unnamed, then by number of faces, then by id."""
    return [name.isNull(), faces.desc(), id_col]


def resumable(jobs: DataFrame, status: str = "status", stage: str = "last_stage", newest: str = "created_at", id_col: str = "id") -> DataFrame:
    """Jobs that were executing, or failed in a known stage; the newest MOST_RESUMABLE."""
    some = jobs.where((F.col(status) == "executing") | ((F.col(status) == "failed") & F.col(stage).isNotNull()))
    return some.orderBy(F.desc_nulls_last(newest), F.desc(id_col)).limit(MOST_RESUMABLE)


def touched(files: DataFrame, action: str, anchor: Column, limit: int = 100, done: str = "last_scan_action", at: str = "last_scanned_at", newest: str = "modified_at") -> DataFrame:
    """The files on which a job that began at anchor did an action, the latest changed first."""
    if action.upper() not in ACTIONS:
        raise ValueError(f"action must be one of {', '.join(ACTIONS)}")
    return files.where((F.col(done) == action.upper()) & (F.col(at) >= anchor)).orderBy(F.desc_nulls_last(newest), "id").limit(min(max(limit, 1), MOST_TOUCHED))


def throughput(jobs: DataFrame, files: str = "processed_files", size: str = "processed_bytes", begin: str = "started_at", end: str = "finished_at") -> DataFrame:
    """The jobs with duration in seconds, files and MiB a second; null without an end or a duration."""
    seconds = F.col(end).cast("timestamp").cast("double") - F.col(begin).cast("timestamp").cast("double")
    timed = jobs.withColumn("duration", F.when(seconds > 0, seconds))
    return timed.withColumn("files_per_sec", F.col(files) / F.col("duration")).withColumn("mb_per_sec", F.col(size) / F.lit(1 << 20) / F.col("duration"))


def hit_rate(hits: Column, misses: Column) -> Column:
    """Cache hits in percent of all look-ups; 0 for none."""
    total = hits + misses
    return F.when(total > 0, F.floor(hits / total * 100 + 0.5)).otherwise(0)


def typical(jobs: DataFrame, rate: str = "files_per_sec", duration: str = "duration", newest: str = "started_at") -> DataFrame:
    """Mean rate and duration of the newest RECENT jobs that are done at a known rate."""
    done = jobs.where((F.col("status") == "DONE") & (F.col(rate) > 0)).orderBy(F.desc_nulls_last(newest), F.desc("id")).limit(RECENT)
    return done.agg(F.avg(rate).alias("files_per_sec"), F.avg(duration).alias("duration"))


def sorted_scans(scans: DataFrame, key: str, descending: bool = True) -> DataFrame:
    """Scans by one of SORT_KEYS, unknown values as 0, ties by id."""
    columns = dict(zip(SORT_KEYS, (F.col("started_at").cast("timestamp").cast("double"), *map(F.col, ("processed_files", "duration", "files_per_sec", "mb_per_sec", "peak_workers", "dir_cache"))), strict=True))
    value = F.coalesce(columns[key].cast("double"), F.lit(0.0))
    return scans.orderBy(value.desc() if descending else value.asc(), "id")


def outdated(files: DataFrame, version: int, column: str = "scanner_version") -> DataFrame:
    """Files of an older scanner, which a refresh takes up."""
    return files.where(F.coalesce(column, F.lit(0)) < version)


def refreshed(files: DataFrame, metadata: DataFrame, version: int, key: str = "id", column: str = "scanner_version") -> DataFrame:
    """Old files with their new metadata where it was found; the version rises even where a file is gone."""
    old = F.coalesce(F.col(f"f.{column}"), F.lit(0)) < version
    fresh = [c for c in metadata.columns if c != key and c in files.columns]
    both = files.alias("f").join(metadata.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in fresh]), F.col(f"f.{key}") == F.col("__k"), "left")
    value = lambda c: F.when(old, F.lit(version)).otherwise(F.col(f"f.{c}")) if c == column else F.when(old & F.col("__k").isNotNull(), F.col(f"__{c}")).otherwise(F.col(f"f.{c}")) if c in fresh else F.col(f"f.{c}")
    return both.select(*[value(c).alias(c) for c in files.columns])


def orphans(files: DataFrame, listing: DataFrame, pointer: str = "thumbnail_path", path: str = "full_path") -> DataFrame:
    """Files whose pointer names nothing in the listing."""
    return files.where(F.col(pointer).isNotNull()).join(listing.select(F.col(path).alias(pointer)).distinct(), pointer, "left_anti")
