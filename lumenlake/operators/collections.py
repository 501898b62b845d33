"""Collections: smart rules, automatic groups, the difference to what exists, counts, covers, places."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.exprs import all_of, geo_cell, plain_extension

# Document categories by words (tested in this order), then by extension; names and descriptions of groups; least numbers of items.
DOC_WORDS = (
    ("receipts", r"receipt|invoice|rechnung|quittung|bill\b|billing"),
    ("manuals", "manual|handbook|handbuch|guide|instructions|anleitung"),
    ("finance", "statement|bank|tax|steuer|w-?2|1099"),
)
DOC_EXTENSIONS = (("pdf", ("pdf",)), ("spreadsheets", ("xls", "xlsx", "csv", "ods", "numbers")), ("presentations", ("ppt", "pptx", "key", "odp")))
DOC_NAMES = {
    "receipts": ("Receipts & Invoices", "Documents that look like receipts, invoices, or bills"),
    "manuals": ("Manuals & Guides", "Instruction manuals, handbooks, and guides"),
    "finance": ("Financial Documents", "Statements, tax, and banking documents"),
    "pdf": ("PDFs", "All PDF documents"),
    "spreadsheets": ("Spreadsheets", "Spreadsheets and tabular data"),
    "presentations": ("Presentations", "Slide decks and presentations"),
    "other": ("Other Documents", "Text files, notes, and other documents"),
}
LEAST = {"event": 3, "place": 3, "doc": 1}
AROUND = "Around "


@dataclass(frozen=True)
class SmartRule:
    """A stored rule; parts that are None or empty ask for nothing."""

    media_types: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    name_contains: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    min_size: int | None = None
    max_size: int | None = None
    min_seconds: float | None = None
    max_seconds: float | None = None
    favorites_only: bool = False

    @classmethod
    def salvage(cls, raw: dict) -> SmartRule:
        """A rule from loose fields; each field of the wrong kind is dropped on its own."""
        texts = lambda k: tuple(x for x in raw.get(k) if isinstance(x, str)) if isinstance(raw.get(k), list) else ()
        text = lambda k: raw[k] if isinstance(raw.get(k), str) and raw[k] else None
        number = lambda k: raw[k] if isinstance(raw.get(k), int | float) and not isinstance(raw[k], bool) else None
        return cls(texts("mediaTypes"), texts("extensions"), text("nameContains"), text("dateFrom"), text("dateTo"), number("minSizeBytes"), number("maxSizeBytes"), number("minDurationSeconds"), number("maxDurationSeconds"), raw.get("favoritesOnly") is True)

    def predicate(self, when: Column | None = None) -> Column:
        """The rule as a condition on the columns of files; Catalyst pushes it down to the scan. Dates are moments: a day means its beginning."""
        return all_of(
            F.col("media_type").isin(*self.media_types) if self.media_types else None,
            plain_extension(F.col("extension")).isin(*[e.lower().lstrip(".") for e in self.extensions]) if self.extensions else None,
            F.col("name").ilike(f"%{self.name_contains}%") if self.name_contains else None,
            (when >= F.lit(self.date_from).cast("timestamp_ntz")) if self.date_from else None,
            (when <= F.lit(self.date_to).cast("timestamp_ntz")) if self.date_to else None,
            F.col("size_bytes") >= self.min_size if self.min_size is not None else None,
            F.col("size_bytes") <= self.max_size if self.max_size is not None else None,
            F.col("duration_seconds") >= self.min_seconds if self.min_seconds is not None else None,
            F.col("duration_seconds") <= self.max_seconds if self.max_seconds is not None else None,
            F.col("favorite") if self.favorites_only else None,
        )


def best_date() -> Column:
    """When a file was taken, else created, else modified."""
    return F.coalesce("date_taken", "date_created", "modified_at")


def _group(key: Column, name: Column | str, description: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(key.alias("auto_key"), lit(name).alias("name"), lit(description).alias("description"))


def month_group(when: Column) -> Column:
    """event:YYYY-MM with its name and description; null without a date."""
    month = F.date_format(when, "MMMM yyyy")
    return F.when(when.isNotNull(), _group(F.concat(F.lit("event:"), F.date_format(when, "yyyy-MM")), month, F.concat(F.lit("Photos & videos from "), month)))


def _degrees(cell: Column, sides: tuple[str, str]) -> Column:
    return F.concat(F.format_number(F.abs(cell) / 10, 1), F.lit("°"), F.when(cell >= 0, sides[0]).otherwise(sides[1]))


def _tenths(cell: Column) -> Column:
    """A tenth of a cell's number, without a fraction of zero."""
    return F.regexp_replace((cell / 10).cast("decimal(9,1)").cast("string"), r"\.0$", "")


def place_group(lat: Column, lon: Column, place_name: Column) -> Column:
    """place:lat,lon in tenths of a degree, named after the cell if that has a name; null without a position."""
    lat10, lon10 = geo_cell(lat), geo_cell(lon)
    key = F.concat(F.lit("place:"), _tenths(lat10), F.lit(","), _tenths(lon10))
    around = F.concat(F.lit(AROUND), _degrees(lat10, ("N", "S")), F.lit(", "), _degrees(lon10, ("E", "W")))
    described = F.coalesce(F.concat(F.lit("Media taken in and around "), place_name), F.lit("Media taken near this location"))
    return F.when(lat.isNotNull() & lon.isNotNull(), _group(key, F.coalesce(place_name, around), described))


def doc_category(name: Column, extension: Column, keywords: Column | None = None, title: Column | None = None) -> Column:
    """A document's category by words in its name, keywords and title, else by its extension."""
    none = F.lit("")
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(c, none) for c in (name, keywords if keywords is not None else none, title if title is not None else none)]))
    low, out = F.lower(F.coalesce(extension, none)), F.lit("other")
    for category, extensions in reversed(DOC_EXTENSIONS):
        out = F.when(low.isin(*extensions), category).otherwise(out)
    for category, pattern in reversed(DOC_WORDS):
        out = F.when(hay.rlike(pattern), category).otherwise(out)
    return out


def doc_group(category: Column) -> Column:
    """doc:category with its name and description."""
    name, description = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c, (n, d) in DOC_NAMES.items():
        name, description = F.when(category == c, n).otherwise(name), F.when(category == c, d).otherwise(description)
    return _group(F.concat(F.lit("doc:"), category), name, description)


def keyed_items(files: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """auto_key, name, description and id of every group that a media file belongs to: its month, its place, its kind of document.

    cells: lat10, lon10 and name of places that are known; one row each, broadcast by Spark if they are few. A file is read once.
    """
    picked = files.select("id", "media_type", "name", "extension", best_date().alias("when"), "lat", "lon")
    if cells is not None:
        known = cells.select("lat10", "lon10", F.col("name").alias("cell_name"))
        picked = picked.withColumn("lat10", geo_cell(F.col("lat"))).withColumn("lon10", geo_cell(F.col("lon"))).join(known, ["lat10", "lon10"], "left")
    else:
        picked = picked.withColumn("cell_name", F.lit(None).cast("string"))
    month = F.when(F.col("media_type").isin("photo", "video"), month_group(F.col("when")))
    document = F.when(F.col("media_type") == "document", doc_group(doc_category(F.col("name"), F.col("extension"))))
    all_groups = F.array_compact(F.array(month, place_group(F.col("lat"), F.col("lon"), F.col("cell_name")), document))
    return picked.select("id", F.explode(all_groups).alias("g")).select("g.*", "id")


def auto_groups(keyed: DataFrame, least: dict[str, int] = LEAST, key: str = "auto_key", id_col: str = "id") -> DataFrame:
    """Groups that reach their family's least number of items, with name, description, count and last item as cover."""
    by = keyed.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("name").alias("name"), F.min("description").alias("description"), F.count(F.lit(1)).alias("n"), F.max(id_col).alias("cover_id"))
    family = F.split_part(F.col(key), F.lit(":"), F.lit(1))
    need = F.lit(1)
    for name, n in least.items():
        need = F.when(family == name, n).otherwise(need)
    return by.where(F.col("n") >= need)


def rebuilt_members(keyed: DataFrame, groups: DataFrame, existing: DataFrame) -> DataFrame:
    """auto_key and id of every member after a rebuild: all of the present groups, without those whose collection was removed by a user."""
    alive = groups.select("auto_key").join(existing.where("removed").select("auto_key"), "auto_key", "left_anti")
    return keyed.select("auto_key", "id").join(alive, "auto_key", "left_semi").distinct()


def difference(existing: DataFrame, groups: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """What a rebuild does with each key: create, keep, rename, delete or skip.

    existing: auto_key, name, removed (a tombstone), cover_id; groups: auto_key, name, cover_id; members: auto_key and id of all
    items. A tombstone is skipped; a user's name stays, but one that begins "Around " gives way to another; a vanished group is
    deleted; a cover that is missing, or no member any more, becomes the group's.
    """
    e = existing.select("auto_key", F.col("name").alias("old_name"), "removed", F.col("cover_id").alias("old_cover"), F.lit(True).alias("e"))
    if members is not None:
        held = members.select("auto_key", F.col("id").alias("old_cover"), F.lit(True).alias("held")).distinct()
        e = e.join(held, ["auto_key", "old_cover"], "left").withColumn("old_cover", F.when(F.col("held"), F.col("old_cover"))).drop("held")
    g = groups.select("auto_key", F.col("name").alias("new_name"), F.col("cover_id").alias("new_cover"), F.lit(True).alias("g"))
    both = e.join(g, "auto_key", "full_outer")
    rename = F.col("old_name").startswith(AROUND) & (F.col("old_name") != F.col("new_name"))
    action = F.when(F.col("removed"), "skip").when(F.col("e").isNull(), "create").when(F.col("g").isNull(), "delete").when(rename, "rename").otherwise("keep")
    both = both.withColumn("action", action)
    name = F.when(F.col("action").isin("create", "rename"), F.col("new_name")).otherwise(F.col("old_name"))
    return both.select("auto_key", "action", name.alias("name"), F.coalesce("old_cover", "new_cover").alias("cover_id"))


def counts(bridge: DataFrame, collection: str, item: str) -> DataFrame:
    """Distinct items and the last of them, per collection."""
    return bridge.groupBy(collection).agg(F.count_distinct(item).alias("items"), F.max(item).alias("cover_id"))


def smart_counts(files: DataFrame, rules: dict[str, SmartRule]) -> DataFrame:
    """collection, items, cover_id (the last item) of each stored rule, evaluated over the files as they are, in one pass."""
    best, names = best_date(), list(rules)
    held = [F.when(F.coalesce(rules[n].predicate(best), F.lit(False)), F.col("id")) for n in names]
    both = [x for h, n in zip(held, range(len(names))) for x in (F.count(h).alias(f"items{n}"), F.max(h).alias(f"cover{n}"))]
    rows = F.array(*[F.struct(F.lit(n).alias("collection"), F.col(f"items{i}").alias("items"), F.col(f"cover{i}").alias("cover_id")) for i, n in enumerate(names)])
    return files.agg(*both).select(F.explode(rows).alias("r")).select("r.*")


def uncached_cells(places: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct cells of the places that the cache lacks."""
    cells = places.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(geo_cell(F.col("lat")).alias("lat10"), geo_cell(F.col("lon")).alias("lon10")).distinct()
    return cells.join(cache.select("lat10", "lon10"), ["lat10", "lon10"], "left_anti")


def place_changes(places: DataFrame, cache: DataFrame, column: str = "name") -> DataFrame:
    """Places whose name differs from their cell's."""
    celled = places.withColumn("lat10", geo_cell(F.col("lat"))).withColumn("lon10", geo_cell(F.col("lon")))
    named = cache.select("lat10", "lon10", F.col("name").alias("cell_name"))
    return celled.join(named, ["lat10", "lon10"]).where(F.col("cell_name").isNotNull() & ~F.col(column).eqNullSafe(F.col("cell_name")))
