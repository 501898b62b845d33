"""Planning: routing files to destinations, conflicts, and savings by conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlake.functions.exprs import half_up

# Fixed values: (status, category, target, share of bytes saved) of extensions, whatever the profile.
FORMATS = {
    ("protected", "image", None, None): "3fr fff iiq psd ai xcf",
    ("protected", "video", None, None): "mxf mov",
    ("optimal", "image", None, None): "webp avif heic heif jxl",
    ("optimal", "video", None, None): "mp4 webm m4v",
    ("optimal", "audio", None, None): "mp3 aac flac ogg opus m4a",
    ("optimal", "document", None, None): "pdf docx",
    ("skip", "audio", None, None): "wav aiff wma",
    ("skip", "document", None, None): "doc",
    ("convert", "image", "png", 0.70): "bmp",
    ("convert", "image", "png", 0.55): "tiff tif",
    ("convert", "image", "png", 0.25): "gif",
    ("convert", "video", "mp4", 0.62): "avi",
    ("convert", "video", "mp4", 0.65): "wmv",
    ("convert", "video", "mp4", 0.60): "flv asf",
    ("convert", "video", "mp4", 0.72): "mpeg mpg",
    ("convert", "video", "mp4", 0.55): "m2ts rmvb",
    ("convert", "video", "mp4", 0.52): "ts",
    ("convert", "video", "mp4", 0.40): "mkv",
}
# Raw pictures are protected unless their conversion is asked for.
RAW = "cr2 cr3 nef nrw arw srf sr2 dng raf orf rw2 pef x3f rwl raw mrw"
RAW_CONVERTED = ("convert", "image", "jpg", 0.80)
# Pictures whose target depends on the profile.
PROFILES = {
    "ARCHIVE": {"jpg jpeg": ("protected", "image", "jpg", 0.0), "png": ("convert", "image", "png", 0.15)},
    "BALANCED": {"jpg jpeg": ("convert", "image", "jpg", 0.18), "png": ("convert", "image", "png", 0.15)},
    "MAXIMUM": {"jpg jpeg": ("convert", "image", "webp", 0.27), "png": ("convert", "image", "webp", 0.30)},
}
STATUS_RANK = ("convert", "protected", "optimal", "skip")
# Video codecs that override a container's rule.
LOSSLESS_CODECS = ("prores", "prores_ks", "dnxhd", "dnxhr", "huffyuv", "utvideo", "v210", "v410")
MODERN_CODECS = ("h264", "hevc", "av1", "vp9", "vp8")
LEGACY_CODECS = ("mjpeg", "mpeg4", "msmpeg4v3", "wmv1", "wmv2", "wmv3", "rv30", "rv40", "h263", "svq3", "indeo3", "cinepak")
LEGACY_RATIO, LEGACY_TARGET = 0.68, "mp4"
#: Extensions of files whose codec is looked at.
CONTAINERS = ("mov", "mkv", "mp4", "m4v")


def routed(files: DataFrame, destinations: dict[str, str], default: str = "Other", override: Column | None = None) -> DataFrame:
    """Each file's destination: its override, else that of its type, else the default; and the path there."""
    by_type = F.lit(default)
    for kind, folder in destinations.items():
        by_type = F.when(F.col("media_type") == kind, folder).otherwise(by_type)
    chosen = F.coalesce(F.nullif(F.trim(override), F.lit("")), by_type) if override is not None else by_type
    return files.withColumn("destination", chosen).withColumn("dest_path", F.concat("destination", F.lit("/"), "name"))


def plan_summary(routes: DataFrame) -> DataFrame:
    """Files and bytes per destination."""
    return routes.groupBy("destination").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").cast("long").alias("size"))


def collisions(routes: DataFrame) -> DataFrame:
    """Destination paths that two or more files want."""
    return routes.groupBy("dest_path").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


def excluded(routes: DataFrame, categories: tuple[str, ...] = (), paths: DataFrame | None = None, category: str = "media_type", path: str = "relative_path") -> DataFrame:
    """The routes without those of a category or a path that the user left out."""
    kept = routes.where(~F.coalesce(F.col(category).isin(*categories), F.lit(False))) if categories else routes
    return kept if paths is None else kept.join(paths.select(path).distinct(), path, "left_anti")


def same_plan(plan: DataFrame, staged: DataFrame) -> DataFrame:
    """One row: how many moves were planned and staged, and whether they are as many."""
    counts = plan.agg(F.count(F.lit(1)).alias("planned")).join(F.broadcast(staged.agg(F.count(F.lit(1)).alias("staged"))), F.lit(True))  # a row each
    return counts.withColumn("equal", F.col("planned") == F.col("staged"))


def dry_run(routes: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """The routes with their conflict: disk if the path exists, intra_job for all but the first of a path, else null.

    The first of a path is a minimum, combined before the shuffle, so that a path which many files want is no long window.
    """
    first = routes.groupBy("dest_path").agg(F.min(F.struct(*order)).alias("first"))
    there = existing.select("dest_path").distinct().withColumn("on_disk", F.lit(True))
    placed = routes.join(first.join(there, "dest_path", "left"), "dest_path", "left")
    conflict = F.when(F.struct(*order) > F.col("first"), "intra_job").when(F.col("on_disk"), "disk")
    return placed.withColumn("conflict", conflict).drop("on_disk", "first")


def outcome(policy: str, conflict: Column) -> Column:
    """What a policy does with a conflict: move, replace, rename, keep_existing or skip."""
    return F.when(conflict.isNull(), "move").otherwise(policy)


def renamed(routes: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """dest_path made unique by _n before the extension; the n-th file of a path takes its n-th free name.

    Names of one stem and extension are one family: its members are numbered, and the numbers that names on disk or first choices of other
    files take are left out: a running count of these in each family, no rounds.
    """
    stem, ext = F.regexp_replace("dest_path", r"(\.[^./]*)?$", ""), F.regexp_extract("dest_path", r"(\.[^./]*)$", 1)
    own = Window.partitionBy("dest_path").orderBy(*order)
    # A name on disk is as good as a file before all others.
    there = existing.select("dest_path").distinct().withColumn("__there", F.lit(1))
    wanted = routes.join(there, "dest_path", "left").withColumn("__nth", F.row_number().over(own) - 1 + F.coalesce("__there", F.lit(0)))
    firsts = wanted.where("__nth = 0").select("dest_path")
    taken = firsts.unionByName(existing.select("dest_path")).distinct()
    number = F.regexp_extract(F.col("__stem"), r"_([1-9][0-9]{0,8})$", 1)
    taken = taken.withColumn("__stem", stem).withColumn("ext", ext).withColumn("number", number).where("number <> ''")
    family = F.concat(F.regexp_replace("__stem", r"_[1-9][0-9]{0,8}$", ""), "ext")
    used = taken.select(family.alias("dest_path"), F.col("number").cast("long").alias("n")).distinct()
    # A used number n of rank r moves each number from n - r + 1 on by one: the free number is the wanted one and how many do so.
    moving = used.select("dest_path", (F.col("n") - F.row_number().over(Window.partitionBy("dest_path").orderBy("n")) + 1).alias("__at"))
    asked = wanted.where("__nth > 0").select("dest_path", F.col("__nth").cast("long").alias("__at")).distinct()
    both = moving.withColumn("__asks", F.lit(False)).unionByName(asked.withColumn("__asks", F.lit(True)))
    upto = Window.partitionBy("dest_path").orderBy("__at", "__asks").rowsBetween(Window.unboundedPreceding, 0)
    moved = both.withColumn("__moved", F.count_if(~F.col("__asks")).over(upto)).where("__asks").select("dest_path", F.col("__at").alias("__nth"), "__moved")
    free = F.col("__nth") + F.coalesce("__moved", F.lit(0))
    named = F.when(F.col("__nth") == 0, F.col("dest_path")).otherwise(F.concat(stem, F.lit("_"), free.cast("string"), ext))
    out = wanted.withColumn("__nth", F.col("__nth").cast("long")).join(moved, ["dest_path", "__nth"], "left").withColumn("__name", named).drop("dest_path").withColumnRenamed("__name", "dest_path")
    return out.select(*routes.columns)


def rules(spark: SparkSession, profile: str = "BALANCED", raw: bool = False) -> DataFrame:
    """extension, status, category, target and ratio (the share of bytes saved) of the known formats: a small table."""
    told = {tuple(names.split()): rule for rule, names in FORMATS.items()}
    told |= {tuple(names.split()): rule for names, rule in PROFILES[profile].items()}
    told[tuple(RAW.split())] = RAW_CONVERTED if raw else ("protected", "image", None, None)
    rows = [(e, *rule) for names, rule in told.items() for e in names]
    return spark.createDataFrame(rows, "extension string, status string, category string, target string, ratio double")


def savings(files: DataFrame, rule_rows: DataFrame, samples: int = 3, codec: str | None = None) -> DataFrame:
    """Per extension: count, bytes, expected saving, and the largest files with their sizes after it, with the status's rank; unknown extensions are skipped.

    With codec, a column of files, the known codec of a container's largest file overrides its rule. Rules are broadcast: a row per extension.
    The samples are ranked in a window that Spark limits before its shuffle.
    """
    largest = F.struct(F.col("size_bytes").isNull(), -F.coalesce("size_bytes", F.lit(0)), "id")
    found = F.min_by(codec, F.when(F.col(codec).isNotNull(), largest)) if codec else F.lit(None).cast("string")
    by = files.groupBy("extension").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("size"), found.alias("found"))
    by = by.join(F.broadcast(rule_rows), "extension", "left")
    by = by.withColumn("codec", F.when(F.col("extension").isin(*CONTAINERS), F.col("found"))).withColumn("status", F.coalesce("status", F.lit("skip")))
    status, ratio = codec_override(F.col("codec"), F.col("status"), F.col("ratio"))
    target = F.when(F.col("codec").isin(*LEGACY_CODECS), LEGACY_TARGET).otherwise(F.col("target"))
    by = by.withColumns({"status": status, "ratio": ratio, "target": target, "category": F.coalesce("category", F.lit("other"))})
    by = by.withColumn("saving", half_up(F.col("size") * F.coalesce("ratio", F.lit(0.0))).cast("long"))
    rank = F.row_number().over(Window.partitionBy("extension").orderBy(F.desc_nulls_last("size_bytes"), "id"))
    top = files.select("extension", "id", "size_bytes", rank.alias("r")).where(F.col("r") <= samples).groupBy("extension").agg(F.array_sort(F.collect_list(F.struct("r", "id", "size_bytes"))).alias("top"))
    place = (F.array_position(F.array(*[F.lit(s) for s in STATUS_RANK]), F.col("status")) - 1).cast("int")
    after = F.transform("top", lambda s: half_up(s["size_bytes"] * (1 - F.coalesce("ratio", F.lit(0.0)))).cast("long").cast("string"))
    listed = {"samples": F.array_join(F.transform("top", lambda s: s["id"].cast("string")), ","), "samples_after": F.array_join(after, ",")}
    return by.join(top, "extension").withColumns(listed).select("extension", "category", "status", "target", "n", "size", "saving", "samples", "samples_after", "codec", place.alias("status_rank"))


def total_savings(by_extension: DataFrame) -> DataFrame:
    """One row: files, bytes, and what converting saves."""
    saved = F.sum(F.when(F.col("status") == "convert", F.col("saving")).otherwise(0))
    return by_extension.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(n) for c, n in ((F.sum("n"), "files"), (F.sum("size"), "size"), (saved, "saving"))])


def codec_override(codec: Column, status: Column, ratio: Column | None = None) -> tuple[Column, Column]:
    """(status, share saved) of a video by its codec: lossless is protected, modern is optimal, legacy is converted; others keep the rule's."""
    ratio = F.lit(None).cast("double") if ratio is None else ratio
    by_codec = F.when(codec.isin(*LOSSLESS_CODECS), "protected").when(codec.isin(*MODERN_CODECS), "optimal").when(codec.isin(*LEGACY_CODECS), "convert")
    return F.coalesce(by_codec, status), F.when(by_codec == "convert", LEGACY_RATIO).otherwise(ratio)


def jpeg_issues(progressive: Column, exif_bytes: Column, size: Column, chroma: Column) -> Column:
    """List of what makes a JPEG larger than it has to be; what is unknown is no issue."""
    plain = F.when(~progressive, "progressive encoding disabled")
    heavy = F.when((size > 0) & (F.coalesce(exif_bytes, F.lit(0)) / size > 0.05), "excessive metadata overhead (EXIF > 5% of file size)")
    full = F.when((chroma != "") & ~chroma.isin("4:2:0", "4:2:2"), F.concat(F.lit("suboptimal chroma subsampling ("), chroma, F.lit(")")))
    return F.array_compact(F.array(plain, heavy, full))
