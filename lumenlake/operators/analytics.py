"""Library analytics: totals, breakdowns, roll-ups, timelines, histograms, paging, faceted filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions.exprs import all_of, percentage, plain_extension, top_folder, under


def totals(files: DataFrame) -> DataFrame:
    """Number of files and their bytes; 0 for none."""
    return files.agg(F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("total_size"))


def type_breakdown(files: DataFrame, key: str = "media_type") -> DataFrame:
    """Per type: count, bytes, share of all bytes. The total is a window over the aggregate, a row per type."""
    by = files.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("size"))
    total = by.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total"))
    return by.join(F.broadcast(total), F.lit(True)).select(key, "n", "size", percentage(F.col("size"), F.col("total")).alias("percentage"))


def top_folders(files: DataFrame, n: int = 20, path: str = "relative_path") -> DataFrame:
    """First path parts with count and bytes, the largest n."""
    by = files.groupBy(top_folder(F.col(path)).alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").cast("long").alias("size"))
    return by.orderBy(F.desc("size"), "folder").limit(n)


def folder_tree(paths: DataFrame, path: str) -> DataFrame:
    """Every ancestor folder of every path, with its parent, depth, and number of files below."""
    parts = F.split(F.col(path), "/")
    ancestors = F.when(F.size("parts") > 1, F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.array_join(F.slice("parts", 1, i), "/")))
    up = paths.select(parts.alias("parts")).select(F.explode(ancestors).alias("folder"))
    by = up.groupBy("folder").agg(F.count(F.lit(1)).alias("n_files"))
    depth = F.size(F.split("folder", "/"))
    return by.select("folder", depth.alias("depth"), F.when(depth > 1, F.regexp_replace("folder", r"/[^/]*$", "")).alias("parent"), "n_files")


def top_files(files: DataFrame, n: int = 20, *columns: str) -> DataFrame:
    """The n largest files, ties to the smaller id."""
    return files.orderBy(F.desc("size_bytes"), "id").select(*columns or files.columns).limit(n)


def timeline_months(items: DataFrame, when: Column, id_col: str) -> DataFrame:
    """Per month: count and the largest id as cover; a null month holds the undated."""
    return items.groupBy(F.date_format(when, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.max(id_col).alias("cover_id"))


def page(items: DataFrame, order: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    """A page of the items in a total order; numbers from 1, sizes from 1 to 200."""
    size = min(max(size, 1), 200)
    return items.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def with_total(items: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n items, each with the number of all; the count is an aggregate, not a window of one partition."""
    total = items.agg(F.count(F.lit(1)).alias("total"))
    return items.orderBy(*order).limit(n).join(F.broadcast(total), F.lit(True))


def keyset_page(items: DataFrame, key: str, after: int, n: int) -> DataFrame:
    """The n items that follow a key."""
    return items.where(F.col(key) > after).orderBy(key).limit(n)


def histogram(items: DataFrame, key: str) -> DataFrame:
    """Count per value."""
    return items.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def zero_filled(counts: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """The counts of given keys, 0 where there is none."""
    spark = counts.sparkSession
    return spark.createDataFrame([(k,) for k in keys], f"{key} string").join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def facet(name_like: str | None = None, types: list[str] | None = None, extensions: list[str] | None = None, least: int | None = None, most: int | None = None, folder: str | None = None, name: str = "name", path: str = "relative_path") -> Column:
    """A predicate of the parameters that are given; the name pattern ignores case and its wildcards count."""
    return all_of(
        F.col(name).ilike(f"%{name_like}%") if name_like else None,
        F.col("media_type").isin(*types) if types else None,
        plain_extension(F.col("extension")).isin(*[e.lower().lstrip(".") for e in extensions]) if extensions else None,
        F.col("size_bytes") >= least if least is not None else None,
        F.col("size_bytes") <= most if most is not None else None,
        under(F.col(path), folder) if folder else None,
    )


def retention(feed: DataFrame, n: int, newest: list[Column], key: str | None = None) -> DataFrame:
    """The newest n rows of all, or of each key."""
    if key is None:
        return feed.orderBy(*newest).limit(n)
    return feed.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*newest))).where(F.col("rank") <= n)


ARCHIVE_KINDS = ("image", "video", "document", "archive", "software", "other")
# Categories by the share of one kind, tested in this order; the least share of the commonest kind for a general archive.
ARCHIVE_SHARES = (("archive", 0.25, "Nested Archives"), ("image", 0.55, "Photo Archive"), ("video", 0.45, "Video Archive"), ("document", 0.45, "Document Backup"), ("software", 0.35, "Software"))
LEAST_COMMONEST = 0.4


def archive_category(locked: Column, counts: dict[str, Column]) -> Column:
    """An archive's category: locked, empty, by the first share that is exceeded, else mixed or general by the commonest kind."""
    n = sum(counts.values(), F.lit(0))
    out = F.when(locked, "Password Protected").when(n == 0, "Unknown")
    for kind, share, name in ARCHIVE_SHARES:
        out = out.when(counts[kind] / n > share, name)
    return out.when(F.greatest(*counts.values()) / n < LEAST_COMMONEST, "Mixed").otherwise("General")


def archive_mix(entries: DataFrame, key: str, kind: str, size: str, folder: str | None = None, locked: str | None = None) -> DataFrame:
    """Per archive: files, counts by kind, bytes of all entries, whether an archive is nested, and its category.

    Kinds beyond ARCHIVE_KINDS count as other; entries that are folders count in the bytes only.
    """
    file = ~F.col(folder) if folder else F.lit(True)
    of = F.when(F.col(kind).isin(*ARCHIVE_KINDS), F.col(kind)).otherwise("other")
    counts = [F.count_if(file & (of == k)).alias(k) for k in ARCHIVE_KINDS]
    shut = F.coalesce(F.bool_or(F.col(locked)), F.lit(False)) if locked else F.lit(False)
    by = entries.groupBy(key).agg(F.count_if(file).alias("n"), *counts, F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("size"), shut.alias("locked"))
    by = by.withColumn("nested", F.col("archive") > 0)
    return by.withColumn("category", archive_category(F.col("locked"), {k: F.col(k) for k in ARCHIVE_KINDS})).drop("locked")


def archive_clusters(archives: DataFrame, samples: int = 5) -> DataFrame:
    """Archives by category (general where it is missing): number, bytes, and the first few, largest first."""
    known = archives.withColumn("category", F.coalesce("category", F.lit("general")))
    by = known.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("size"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc_nulls_last("size"), "id"))
    top = known.select("category", "id", "size", rank.alias("r")).where(F.col("r") <= samples)
    top = top.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"].cast("string")), ",").alias("samples"))
    return by.join(top, "category")


SORT_COLUMNS = {"name": "name", "size": "size_bytes", "modified": "modified_at"}


def sort_order(sort: str | None, id_col: str = "id") -> list[Column]:
    """The order for a sort key (name, size or modified, with _asc or _desc); any other means the latest indexed first."""
    name, _, direction = (sort or "").rpartition("_")
    if name not in SORT_COLUMNS or direction not in ("asc", "desc"):
        return [F.desc_nulls_first("indexed_at"), F.col(id_col)]
    c = F.col(SORT_COLUMNS[name])
    return [c.asc_nulls_last() if direction == "asc" else c.desc_nulls_first(), F.col(id_col)]


def eligible(types: tuple[str, ...] = ("photo", "video"), extensions: tuple[str, ...] = ("pdf",)) -> Column:
    """Files of one of the types, or with one of the extensions: those that can have a thumbnail."""
    return F.col("media_type").isin(*types) | F.col("extension").isin(*extensions)


def folder_sizes(files: DataFrame, inside: str = "", path: str = "relative_path", size: str = "size_bytes") -> DataFrame:
    """The listing of a folder: its entries with whether they are folders, bytes (all below), and number of direct children.

    One aggregate over the files below the folder; a folder's children are the distinct next parts of its paths.
    """
    rest = F.col(path) if not inside else F.substr(F.col(path), F.lit(len(inside) + 2))
    below = files if not inside else files.where(F.col(path).startswith(f"{inside}/"))
    parts = F.split(rest, "/")
    rows = below.select(parts[0].alias("name"), F.when(F.size(parts) > 1, parts[1]).alias("child"), F.col(size).alias("size"))
    by = rows.groupBy("name", "child").agg(F.sum("size").alias("size"))
    by = by.groupBy("name").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("size"), F.count("child").alias("children"))
    return by.select("name", (F.col("children") > 0).alias("is_folder"), "size", F.nullif("children", F.lit(0)).alias("children"))


def empty_folders(folders: DataFrame, files: DataFrame, path: str = "relative_path") -> DataFrame:
    """Folders with no file in or below them."""
    held = folder_tree(files.select(path), path).select("folder")
    return folders.join(held, "folder", "left_anti")


def consecutive_failures(checks: DataFrame, key: str, order: list[str], failed: Column, least: int = 2) -> DataFrame:
    """Rows at which a run of failures reaches its least-th: one report for each run that is long enough."""
    by = Window.partitionBy(key).orderBy(*order)
    marked = checks.withColumn("failed", failed).withColumn("run", F.sum(F.when(failed, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy(key, "run").orderBy(*order)
    return marked.where("failed").withColumn("nth", F.row_number().over(in_run)).where(F.col("nth") == least)


def recent_averages(jobs: DataFrame, newest: list[Column], n: int, *measures: str) -> DataFrame:
    """Averages of the measures over the newest n jobs."""
    return jobs.orderBy(*newest).limit(n).agg(*[F.avg(m).alias(m) for m in measures])
