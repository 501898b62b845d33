"""Snapshots: reconciliation of a listing with what is stored, moves, merges, and updates by join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions.exprs import slashed, under

KEY = "relative_path"


#: Characters of a path that split a long run of files with one mark; they keep the order of paths.
PREFIX = 12


def _numbered(df: DataFrame, mark: str, name: str) -> DataFrame:
    """mark, nth (from 1, by path) and the path as name.

    A mark that very many files share, such as that of empty ones, is numbered by parts of one prefix, from their sizes on, so that no window has all its rows.
    """
    rows = df.where(F.col(mark).isNotNull()).select(mark, F.col(KEY).alias(name), F.left(KEY, F.lit(PREFIX)).alias("part"))
    sizes = rows.groupBy(mark, "part").agg(F.count(F.lit(1)).alias("c"))
    before = sizes.select(mark, "part", (F.sum("c").over(Window.partitionBy(mark).orderBy("part")) - F.col("c")).alias("before"))
    placed = rows.withColumn("nth", F.row_number().over(Window.partitionBy(mark, "part").orderBy(name)))
    return placed.join(before, [mark, "part"]).select(mark, (F.col("nth") + F.col("before")).alias("nth"), name)


def _pairs(new: DataFrame, old: DataFrame, mark: str) -> DataFrame:
    """from_path, to_path and mark: the n-th new path of a mark takes its n-th old one, each once."""
    return _numbered(old, mark, "from_path").join(_numbered(new, mark, "to_path"), [mark, "nth"]).select("from_path", "to_path", mark)


def moves(only_listed: DataFrame, old: DataFrame, fingerprint: str = "quick_fingerprint", full_hash: str | None = None) -> DataFrame:
    """Pairs (from_path, to_path, quick_fingerprint) of files that moved.

    A new path takes a stored one of its fingerprint, each stored one once. Stored rows without a fingerprint, which older scans left, are
    met by the full hash, if full_hash names the column: only by files of their size, so that few are hashed.
    """
    found = _pairs(only_listed, old.where(F.col(fingerprint).isNotNull()), fingerprint)
    if full_hash is None:
        return found
    legacy = old.where(F.col(fingerprint).isNull() & F.col(full_hash).isNotNull())
    rest = only_listed.join(found.select(F.col("to_path").alias(KEY)), KEY, "left_anti").join(legacy.select("size_bytes").distinct(), "size_bytes", "left_semi")
    by_hash = _pairs(rest, legacy, full_hash).select("from_path", "to_path", F.lit(None).cast("string").alias(fingerprint))
    return found.unionByName(by_hash)


def reconcile(listed: DataFrame, stored: DataFrame, root: str | None = None, full: bool = False, full_hash: str | None = None, all_stored: bool = False) -> DataFrame:
    """relative_path, from_path and action (NEW, MODIFIED, MOVED, UNCHANGED, DELETED) of every path in either snapshot.

    A known file is unchanged if its size and its time of change (where a snapshot lacks that: its fingerprint) agree. With a root,
    stored rows outside it are left alone.
    A full run calls every known file modified. Moves pair new paths with lost ones; with all_stored, also with paths that are still there.
    The lost path of a move is not deleted. Nothing is matched if nothing is stored: a first scan needs no fingerprints.
    """
    if root is not None:
        stored = stored.where(under(F.col(KEY), root))
    timed = "modified_at" in listed.columns and "modified_at" in stored.columns
    marks = ("size_bytes", "modified_at" if timed else "quick_fingerprint")
    carried = list(dict.fromkeys(["size_bytes", "quick_fingerprint", *([full_hash] if full_hash else []), *marks]))
    one = listed.select(KEY, F.struct(*carried).alias("l"))
    two = stored.select(KEY, F.struct(*carried).alias("s"))
    both = one.join(two, KEY, "full_outer")
    new = both.where("s is null").select(KEY, "l.*")
    old = both.where("s is not null" if all_stored else "l is null").select(KEY, "s.*")
    pairs = moves(new, old, full_hash=full_hash)
    same = F.lit(not full)
    for c in marks:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"s.{c}"))
    known = F.col("l").isNotNull() & F.col("s").isNotNull()
    action = F.when(known, F.when(same, "UNCHANGED").otherwise("MODIFIED")).when(F.col("s").isNull(), F.when(F.col("from_path").isNotNull(), "MOVED").otherwise("NEW")).otherwise("DELETED")
    out = both.join(pairs.select(F.col("to_path").alias(KEY), "from_path"), KEY, "left").withColumn("action", action)
    lost = pairs.select(F.col("from_path").alias(KEY), F.lit("DELETED").alias("action"))
    return out.join(lost, [KEY, "action"], "left_anti").select(KEY, "from_path", "action")


def merge(new: DataFrame, old: DataFrame, key: list[str], update: list[str], protect: list[str] = ()) -> DataFrame:
    """An upsert as a new snapshot: new values win, protected columns only where the new value is not null; other rows stay.

    One full outer join on the key; columns that are not updated keep the old value.
    """
    a, b = new.withColumn("__new", F.lit(True)).alias("a"), old.withColumn("__old", F.lit(True)).alias("b")
    both = a.join(b, key, "full_outer")
    columns = [F.col(k) for k in key]
    for c in [c for c in old.columns if c not in key]:
        mine, theirs = (F.col(f"a.{c}") if c in new.columns else F.lit(None)), F.col(f"b.{c}")
        if c in protect:
            value = F.coalesce(mine, theirs)
        elif c in update:
            value = F.when(F.col("__new"), mine).otherwise(theirs)
        else:
            value = F.when(F.col("__old"), theirs).otherwise(mine)
        columns.append(value.alias(c))
    return both.select(*columns)


def update_where_distinct(rows: DataFrame, names: DataFrame, key: list[str], column: str, new: str) -> DataFrame:
    """Rows whose column would change to the joined value, null-safe; the count of rows is the count of changes."""
    return rows.join(names, key).where(F.col(new).isNotNull() & ~F.col(column).eqNullSafe(F.col(new)))


def set_where(rows: DataFrame, ids: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """The rows with a column set where their key is listed."""
    hit = ids.select(F.col(key).alias("__k")).distinct().withColumn("__hit", F.lit(True))
    return rows.join(hit, F.col(key) == F.col("__k"), "left").withColumn(column, F.when(F.col("__hit"), value).otherwise(F.col(column))).drop("__k", "__hit")


def with_fingerprints(listing: DataFrame, stored: DataFrame, fingerprint: Column, column: str = "quick_fingerprint") -> DataFrame:
    """The listing with fingerprints, or with nulls if nothing is stored: a first scan has no moves to find, and need not read any file."""
    return listing.withColumn(column, F.lit(None).cast("string") if stored.isEmpty() else fingerprint)


def set_where_path(rows: DataFrame, paths: DataFrame, own: Column, column: str, value: Column, path: str = "path") -> DataFrame:
    """The rows with a column set where their path is listed, whichever slashes either side has."""
    hit = paths.select(slashed(F.col(path)).alias("__k")).distinct().withColumn("__hit", F.lit(True))
    keyed = rows.withColumn("__own", slashed(own))
    return keyed.join(hit, F.col("__own") == F.col("__k"), "left").withColumn(column, F.when(F.col("__hit"), value).otherwise(F.col(column))).drop("__k", "__hit", "__own")


def record_error(rows: DataFrame, failures: DataFrame, key: str, columns: tuple[str, ...] = ("error",)) -> DataFrame:
    """An upsert of failures: their columns are set, all that was derived before stays, and keys that are new begin with nulls."""
    return merge(failures.select(key, *columns), rows, [key], list(columns))


def insert_missing(bridge: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    """Union without a second row for a key."""
    return bridge.select(*key).unionByName(more.select(*key)).dropDuplicates(key)


def inserted(rows: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """The new rows with the ids that follow the largest one, in the order of their columns: what an insert returns.

    Numbers come from a window over the new rows alone, which are few: a job, a saved search, a person.
    """
    columns = new.columns
    numbered = new.withColumn("__n", F.row_number().over(Window.orderBy(*columns)))
    last = rows.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__last"))
    return numbered.join(F.broadcast(last), F.lit(True)).select((F.col("__last") + F.col("__n")).cast("long").alias(id_col), *columns)


def recover_jobs(jobs: DataFrame, status: str = "status") -> DataFrame:
    """After a restart: running jobs failed, paused ones were interrupted."""
    new = F.when(F.col(status) == "RUNNING", "FAILED").when(F.col(status) == "PAUSED", "INTERRUPTED_BY_RESTART").otherwise(F.col(status))
    return jobs.withColumn(status, new)


def directory_state(listing: DataFrame, path: str = KEY, changed: str = "modified_at") -> DataFrame:
    """Per folder: the latest change and the number of entries, to compare with an earlier listing."""
    folder = F.when(F.col(path).contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("/")
    return listing.groupBy(folder.alias("folder")).agg(F.max(changed).alias("changed"), F.count(F.lit(1)).alias("entries"))


def changed_folders(now: DataFrame, before: DataFrame) -> DataFrame:
    """Folders that are new, gone or different, by their states."""
    a = now.select("folder", F.struct("changed", "entries").alias("now"))
    b = before.select("folder", F.struct("changed", "entries").alias("before"))
    return a.join(b, "folder", "full_outer").where(~F.col("now").eqNullSafe(F.col("before")))


def folder_of(path: str = KEY) -> Column:
    """The folder that a path stands in; "" for the root."""
    return F.when(F.col(path).contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def folder_digests(files: DataFrame, marks: tuple[str, ...] = ("size_bytes", "modified_at"), path: str = KEY) -> DataFrame:
    """folder, files and digest: a sum of hashes of the folder's own files, by path and marks. Sums are combined before the shuffle, in any order."""
    own = F.xxhash64(path, *marks).cast("decimal(38,0)")
    return files.groupBy(folder_of(path).alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum(own).alias("digest"))


def tree_digests(folders: DataFrame) -> DataFrame:
    """The same of whole trees, for each folder and all above it, with the tree's depth, from the folders' own digests: equal trees need no walk."""
    parts = F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.split("folder", "/"))
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder"), n.alias("depth")))
    rows = folders.select("files", "digest", F.explode(above).alias("a"))
    return rows.groupBy(F.col("a.folder").alias("folder"), F.col("a.depth").alias("depth")).agg(F.sum("files").alias("files"), F.sum("digest").alias("digest"))


def differing(now: DataFrame, before: DataFrame) -> DataFrame:
    """folder of the digests that are new, gone or different."""
    a = now.select("folder", F.struct("files", "digest").alias("a"))
    return a.join(before.select("folder", F.struct("files", "digest").alias("b")), "folder", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("folder")


def equal_trees(now: DataFrame, before: DataFrame) -> DataFrame:
    """The highest folders whose trees are equal, from tree digests: what a walk may pass over. "" if nothing changed at all."""
    same = now.join(before, ["folder", "depth", "files", "digest"], "left_semi").select("folder")
    parent = F.when(F.col("folder") == "", F.lit(None).cast("string")).otherwise(folder_of("folder"))
    return same.withColumn("__parent", parent).join(same.select(F.col("folder").alias("__parent")), "__parent", "left_anti").select("folder")


def reconcile_changed(listed: DataFrame, stored: DataFrame, before: DataFrame | None = None, **options: object) -> DataFrame:
    """reconcile() of the files in folders whose digests differ; all other listed files are unchanged, and meet nothing.

    before: the digests kept with the stored snapshot, else worked out. Both snapshots have modified_at. A move joins two folders that both
    differ, so moves are found as ever; a full run and all_stored look at every folder and are not for this.
    """
    if options.get("full") or options.get("all_stored"):
        raise ValueError("a full run has no folder to pass over")
    root = options.get("root")
    if root is not None:
        stored = stored.where(under(F.col(KEY), root))
    changed = differing(folder_digests(listed), folder_digests(stored) if before is None else before)
    place = lambda df: df.withColumn("folder", folder_of())
    some = reconcile(place(listed).join(changed, "folder", "left_semi").drop("folder"), place(stored).join(changed, "folder", "left_semi").drop("folder"), **options)
    rest = place(listed).join(changed, "folder", "left_anti")
    return some.unionByName(rest.select(KEY, F.lit(None).cast("string").alias("from_path"), F.lit("UNCHANGED").alias("action")))


MOST_CHECKED = 20_000


def integrity(indexed: DataFrame, listing: DataFrame, key: str = KEY, most: int | None = MOST_CHECKED) -> DataFrame:
    """Indexed files that are missing, and those that are empty though indexed with a size; nulls (unknown) if more than most are indexed.

    The limit is a feature of the report, which is asked for often; None checks any number.
    """
    found = listing.select(key, F.col("size_bytes").alias("found_size"))
    both = indexed.join(found, key, "left")
    counts = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("found_size").isNull()).alias("missing"), F.count_if((F.col("found_size") == 0) & (F.col("size_bytes") > 0)).alias("corrupt"))
    known = F.lit(True) if most is None else F.col("n") <= most
    return counts.select(F.when(known, F.col("missing")).alias("missing"), F.when(known, F.col("corrupt")).alias("corrupt"))
