"""Sources and sinks: file listings, archives, text, JSON lines, versioned snapshots."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions.exprs import extension_of, media_type, slashed, under
from lumenlake.sources.archives import LISTED_ARCHIVES, OTHER_ARCHIVES, ArchiveSource

TEXT_CHARS = 6_000
TEXT_EXTENSIONS = ("txt", "md", "csv", "log", "json")
# Folders and files that a listing leaves out.
SYSTEM_DIRS = ("$RECYCLE.BIN", "System Volume Information", "RECYCLER", "Recycle Bin", "@eaDir", "@Recycle", "@SynoEAStream", "@SynoThumbs", "#recycle", "#snapshot", ".Spotlight-V100", ".Trashes", ".fseventsd", "lost+found", "__pycache__")
SYSTEM_FILES = ("thumbs.db", "thumbs.db:encryptable", "ehthumbs.db", "ehthumbs_vista.db", "desktop.ini", "autorun.inf", ".ds_store", ".localized", ".appledouble", ".appledesktop")
SIDECARS = ("thm", "xmp", "aae")
TEMPORARY = ("tmp", "temp")
SKIP_REASONS = ("system_file", "hidden_file", "user_ignored_folder", "user_ignored_extension", "system_directory", "other_type_excluded")


@dataclass(frozen=True)
class ScanSettings:
    """What a listing leaves out besides its own folders."""

    hidden: bool = True
    system: bool = True
    sidecars: bool = True
    temporary: bool = True
    others: bool = False
    ignored_folders: tuple[str, ...] = ()
    ignored_extensions: tuple[str, ...] = ()
    own_folders: tuple[str, ...] = (".lumenlake",)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """full_path, relative_path, name, extension, media_type, size_bytes, modified_at of every file below root; contents stay unread."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    plain = F.regexp_replace("path", "^[a-z]+:/+", "/")
    base = "/" + root.split(":", 1)[-1].strip("/")
    relative = F.substring(plain, len(base) + 2, 1_000_000)
    name = F.substring_index("relative_path", "/", -1)
    return found.select(plain.alias("full_path"), relative.alias("relative_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at")).withColumns({"name": name, "extension": extension_of(name), "media_type": media_type(extension_of(name))})


def skip_reason(settings: ScanSettings = ScanSettings(), name: str = "name", path: str = "relative_path") -> Column:
    """Why a listing leaves a file out; null to keep it.

    Folders are judged before files. Of the rules for files the first that fits a name decides: if its setting is
    off the file stays, whatever later rules say. Excluding a type of its own comes last.
    """
    plain, n = slashed(F.col(path)), F.col(name)
    low, ext = F.lower(n), extension_of(n)
    above = F.filter(F.slice(F.split(plain, "/"), 1, F.greatest(F.size(F.split(plain, "/")) - 1, F.lit(0))), lambda d: d != "")
    system_dir = F.exists(above, lambda d: d.isin(*settings.own_folders))
    if settings.hidden:
        system_dir |= F.exists(above, lambda d: d.startswith("."))
    if settings.system:
        system_dir |= F.exists(above, lambda d: d.startswith("@") | d.startswith("#") | d.isin(*SYSTEM_DIRS))
    out = F.when(system_dir, "system_directory")
    for folder in settings.ignored_folders:
        out = out.when(under(plain, folder.replace("\\", "/").removesuffix("/")), "user_ignored_folder")
    said = lambda on, reason: F.lit(reason if on else None).cast("string")
    other = F.when(media_type(ext) == "other", said(not settings.others, "other_type_excluded"))
    out = out.when(n.startswith("._") | ext.isin(*SIDECARS), F.coalesce(said(settings.sidecars, "system_file"), other))
    out = out.when(low.isin(*SYSTEM_FILES), F.coalesce(said(settings.system, "system_file"), other))
    out = out.when(n.startswith("."), F.coalesce(said(settings.hidden, "hidden_file"), other))
    out = out.when(n.startswith("~$") | ext.isin(*TEMPORARY), F.coalesce(said(settings.temporary, "system_file"), other))
    if settings.ignored_extensions:
        out = out.when(ext.isin(*[e.lower().removeprefix(".") for e in settings.ignored_extensions]), "user_ignored_extension")
    return out.otherwise(other)


def archive_entries(spark: SparkSession, root: str) -> DataFrame:
    """A row for each entry of the ZIP and TAR files and packed files below root; one with a status for a file that cannot be read, or is of another kind of archive."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(ArchiveSource.name()).load(root)


def read_texts(spark: SparkSession, root: str, chars: int = TEXT_CHARS) -> DataFrame:
    """path and the first chars characters of every text file below root."""
    found = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(root).select(F.col("_metadata.file_path").alias("path"), F.left("value", F.lit(chars)).alias("text"))
    return found.where(extension_of(F.col("path")).isin(*TEXT_EXTENSIONS))


def read_lines(spark: SparkSession, path: str, schema: str, newest: str) -> DataFrame:
    """JSON lines, newest first; lines that cannot be read are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).orderBy(F.desc(newest))


def append_lines(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)


def roll(df: DataFrame, folder: str, newest: str, keep: int) -> str:
    """A rolling file: the rows of before and these, the newest keep of them, as the folder's next snapshot."""
    before = read_snapshot(df.sparkSession, folder)
    rows = df if before is None else before.unionByName(df)
    return write_snapshot(rows.orderBy(F.desc(newest)).limit(keep), folder)


def write_snapshot(df: DataFrame, folder: str, version: int = 1) -> str:
    """A snapshot in a folder of its own, and its row in the folder's index once it is complete."""
    name = uuid.uuid4().hex
    df.write.parquet(f"{folder}/data/{name}")
    spark = df.sparkSession
    spark.createDataFrame([(name, version, time.time())], "name string, version int, at double").coalesce(1).write.mode("append").parquet(f"{folder}/index")
    return name


def read_snapshot(spark: SparkSession, folder: str, version: int = 1, most_age: float | None = None) -> DataFrame | None:
    """The latest snapshot of the version, or None if there is none or it is older than most_age seconds."""
    schema = "name string, version int, at double"
    try:
        index = spark.read.schema(schema).parquet(f"{folder}/index")
    except AnalysisException:  # nothing was written there yet
        return None
    index = index.where(F.col("version") == version)
    last = index.orderBy(F.desc("at"), F.desc("name")).first()
    if last is None or (most_age is not None and last["at"] < time.time() - most_age):
        return None
    return spark.read.parquet(f"{folder}/data/{last['name']}")


def discard(df: DataFrame) -> None:
    """Run a plan in full and keep nothing, to measure it."""
    df.write.format("noop").mode("overwrite").save()


def peek_counts(entries: DataFrame) -> DataFrame:
    """Per archive: files by type, bytes, and whether another archive is inside."""
    kind = media_type(extension_of(F.col("name")))
    rows = entries.where(~F.col("is_directory")).withColumn("kind", kind)
    n = lambda k: F.count_if(F.col("kind") == k)
    return rows.groupBy("archive").agg(n("photo").alias("photos"), n("video").alias("videos"), n("document").alias("documents"), F.sum("size_bytes").alias("size"), F.bool_or(extension_of(F.col("name")).isin(*LISTED_ARCHIVES, *OTHER_ARCHIVES)).alias("nested"))


def parse_props(column: str, schema: str) -> Column:
    """A JSON column by schema; what cannot be read is null."""
    return F.from_json(column, schema)


def manifest(rows: list[dict]) -> str:
    """Rows as JSON lines."""
    return "".join(json.dumps(r) + "\n" for r in rows)
