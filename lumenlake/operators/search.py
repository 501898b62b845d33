"""Hybrid retrieval: intents, candidates, scoring with reasons, similar items, suggestions."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.functions.exprs import all_of, cosine, half_up

MOST, MOST_KEYWORDS, MOST_HINTS, MOST_REASONS, MOST_CANDIDATES = 10, 8, 4, 5, 400
# The types that an intent may name ("image" also stands for photos), and what to offer before anything is typed.
TYPES = ("image", "video", "document", "audio", "archive", "other")
STARTERS = ("Vacation photos", "Pictures from last summer", "Receipts", "Recently added videos", "Favorites", "Documents about the house", "Sunset photos", "Screenshots")
ISO_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")


@dataclass(frozen=True)
class Intent:
    """What a search asks for; empty parts ask for nothing."""

    keywords: tuple[str, ...] = ()
    objects: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    media_types: tuple[str, ...] = ()
    doc_types: tuple[str, ...] = ()
    location: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    favorite_only: bool = False
    semantic_query: str | None = None


def parse_words(query: str) -> Intent:
    """The plain reading of a query: itself as the meaning, and its first words of three letters or more, in lower case."""
    return Intent(keywords=tuple([w for w in query.lower().split() if len(w) > 2][:MOST_KEYWORDS]), semantic_query=query)


def validated(raw: dict) -> Intent:
    """An intent from loose fields: lists of up to MOST texts in lower case, known types, ISO dates; other values are dropped."""
    texts = lambda k: tuple([t for x in raw.get(k) if (t := str(x).lower().strip())][:MOST]) if isinstance(raw.get(k), list) else ()
    text = lambda k: raw[k].strip() if isinstance(raw.get(k), str) and raw[k].strip() else None
    return Intent(texts("keywords"), texts("objects"), texts("exclude"), tuple(t for t in texts("mediaTypes") if t in TYPES), texts("docTypes"), text("location"), _iso(raw.get("dateFrom")), _iso(raw.get("dateTo")), raw.get("favoriteOnly") is True, text("semanticQuery"))


def _iso(value: object) -> str | None:
    return value if isinstance(value, str) and ISO_DATE.fullmatch(value) else None


def with_filters(intent: Intent, filters: dict) -> Intent:
    """The intent with a user's explicit filters, which win over what was read from words."""
    types = filters.get("mediaTypes")
    return replace(
        intent,
        media_types=tuple(map(str, types[:6])) if isinstance(types, list) and types else intent.media_types,
        favorite_only=intent.favorite_only or filters.get("favoriteOnly") is True,
        date_from=_iso(filters.get("dateFrom")) or intent.date_from,
        date_to=_iso(filters.get("dateTo")) or intent.date_to,
    )


def hints(intent: Intent) -> list[str]:
    """What to loosen when nothing was found, MOST_HINTS at most."""
    out = []
    if intent.date_from or intent.date_to:
        out.append("Remove the date filter — try searching all time")
    if len(intent.media_types) == 1:
        out.append(f"Search all media instead of just {intent.media_types[0]}s")
    if intent.exclude:
        out.append(f'Stop excluding "{intent.exclude[0]}"')
    if len(intent.objects) > 1:
        out.append(f'Try just "{intent.objects[0]}" on its own')
    if intent.location:
        out.append(f'Drop the location "{intent.location}" — many files have no GPS data')
    if intent.favorite_only:
        out.append("Include non-favorites too")
    return out[:MOST_HINTS] or ["Try fewer or more general words", "Browse your collections instead"]


def stored_types(types: tuple[str, ...]) -> list[str]:
    """The library's types for an intent's."""
    return sorted({x for t in types for x in (("image", "photo") if t == "image" else (t,))})


def intent_filter(intent: Intent) -> Column:
    """The intent's hard conditions; dates are those taken, else modified, and an upper date reaches to 23:59:59."""
    when = F.coalesce("date_taken", "modified_at")
    return all_of(
        F.col("media_type").isin(stored_types(intent.media_types)) if intent.media_types else None,
        F.col("favorite") if intent.favorite_only else None,
        (when >= F.lit(intent.date_from).cast("timestamp_ntz")) if intent.date_from else None,
        (when <= F.lit(f"{intent.date_to} 23:59:59").cast("timestamp_ntz")) if intent.date_to else None,
        F.col("doc_type").isin(*intent.doc_types) if intent.doc_types else None,
    )


def candidates(files: DataFrame, vectors: DataFrame, query: list[float] | None, where: Column, limit: int = 60) -> DataFrame:
    """Files that meet the conditions, with the similarity of their vectors to the query's: the best min(4 limit, MOST_CANDIDATES).

    Without a query's vector there is no similarity, and the latest taken come first.
    """
    if query is None:
        found = files.where(where).withColumn("sim", F.lit(None).cast("double")).orderBy(F.desc_nulls_last("date_taken"), "id")
        return found.limit(min(limit * 4, MOST_CANDIDATES))
    q = F.array(*[F.lit(float(x)) for x in query])
    near = files.where(where).join(vectors.select("id", "embedding"), "id", "left")
    sim = F.round(cosine(F.col("embedding"), q), 6)
    return near.withColumn("sim", sim).drop("embedding").orderBy(F.desc_nulls_last("sim"), "id").limit(min(limit * 4, MOST_CANDIDATES))


def _low(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def _low_all(tags: Column) -> Column:
    return F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(t))


def haystack(tags: Column, objects: Column) -> Column:
    """All that is known of a row in one lower-case text: its fields and lists that are not empty, a blank between them."""
    fields = [F.nullif(c, F.lit("")) for c in (F.col("name"), F.col("relative_path"), F.coalesce("user_description", "description"), *map(F.col, ("notes", "ocr_text", "doc_type", "scene", "place_name")))]
    lists = [F.filter(x, lambda t: t != "") for x in (tags, objects, _low_all(F.col("people")))]
    return F.lower(F.concat_ws(" ", *fields, *lists))


def score_terms(intent: Intent) -> list[tuple[Column, Column]]:
    """(points, reason or null) of each condition, in order; a condition scores in the first place that holds it."""
    hay, none = F.col("__hay"), F.lit(None).cast("string")
    held = lambda names, x: F.exists(names, lambda t: t.contains(x))

    def first(*cases: tuple[Column, float, Column | str | None]) -> tuple[Column, Column]:
        points, reason = F.lit(0.0), none
        for condition, n, why in reversed(cases):
            points = F.when(condition, float(n)).otherwise(points)
            reason = F.when(condition, none if why is None else F.lit(why) if isinstance(why, str) else why).otherwise(reason)
        return points, reason

    sim = F.coalesce("sim", F.lit(0.0))
    terms = [(F.greatest(F.lit(0.0), sim) * 3, F.when(sim >= 0.45, "Strong content match").when(sim >= 0.30, "Related content"))]
    for o in intent.objects:
        terms.append(first((held(F.col("__objects"), o) | held(F.col("__tags"), o), 1.5, f"{o[:1].upper()}{o[1:]} detected"), (hay.contains(o), 0.7, f'Mentions "{o}"')))
    for k in intent.keywords:
        terms.append(first((_low("name").contains(k), 1, f'Name contains "{k}"'), (_low("notes").contains(k), 1, f'Your note mentions "{k}"'), (_low("ocr_text").contains(k), 0.9, f'Text mentions "{k}"'), (hay.contains(k), 0.4, None)))
    if intent.location:
        low = intent.location.lower()
        terms.append(first((_low("place_name").contains(low), 1.5, F.concat(F.lit("Taken in "), "place_name")), (hay.contains(low), 1, f"Location matches {intent.location}"), (F.col("lat").isNotNull(), 0.1, "Has GPS data")))
    if intent.date_from or intent.date_to:
        terms.append((F.lit(0.0), F.when(F.col("date_taken").isNotNull(), F.concat(F.lit("Taken "), F.date_format("date_taken", "MMM yyyy")))))
    if intent.doc_types:
        terms.append(first((F.col("doc_type").isin(*intent.doc_types), 1.5, F.concat(F.lit("Classified as "), "doc_type"))))
    if intent.favorite_only:
        terms.append((F.lit(0.0), F.when(F.col("favorite"), "Favorite")))
    return terms


def scored(rows: DataFrame, intent: Intent, limit: int = 60) -> DataFrame:
    """Rows by score, with confidence and up to MOST_REASONS reasons; excluded and pointless rows go.

    rows: media files with sim. Points are unrolled into one expression, so the whole scorer is one projection.
    """
    tags = effective_tags(_low_all(F.col("tags")), _low_all(F.col("hidden_tags")), _low_all(F.col("user_tags")))
    known = rows.withColumn("__tags", tags).withColumn("__objects", _low_all(F.col("objects")))
    known = known.withColumn("__hay", haystack(F.col("__tags"), F.col("__objects")))
    terms = score_terms(intent)
    total = reduce(lambda a, b: a + b, [p for p, _ in terms])
    excluded = reduce(lambda a, b: a | b, [F.col("__hay").contains(x) for x in intent.exclude], F.lit(False))
    out = known.where(~excluded).withColumn("raw", total)
    if intent.objects or intent.keywords or intent.location or intent.doc_types or intent.semantic_query:
        out = out.where("raw > 0.05")
    if intent.semantic_query:
        out = out.where(~((F.coalesce("sim", F.lit(1.0)) < 0.15) & (F.col("raw") < 1)))
    reasons = F.array_join(F.slice(F.array_compact(F.array(*[r for _, r in terms])), 1, MOST_REASONS), "; ")
    confidence = F.when(F.col("raw") >= 2.2, "very_likely").when(F.col("raw") >= 1.1, "likely").otherwise("possible")
    out = out.withColumns({"score": half_up(F.col("raw") * 100) / 100, "confidence": confidence, "reasons": reasons})
    return out.drop("__tags", "__objects", "__hay").orderBy(F.desc("score"), F.desc_nulls_last("sim"), "id").limit(limit)


def similar(files: DataFrame, vectors: DataFrame, item: int, k: int = 24, where: Column | None = None) -> DataFrame:
    """The k files of the item's type most like it, without itself and its copies, with score and confidence; an unknown hash is no copy.

    where narrows the files that are offered, as to live ones; the item itself may be any.
    The item's row is broadcast: one row, whatever the table's size.
    """
    both = vectors.where(F.col("embedding").isNotNull()).join(files.select("id", "media_type", "content_hash"), "id")
    one = both.where(F.col("id") == item).limit(1).select(F.col("embedding").alias("q"), F.col("media_type").alias("q_type"), F.col("content_hash").alias("q_hash"))
    other = (F.col("id") != item) & (F.col("media_type") == F.col("q_type")) & (F.col("content_hash").isNull() | F.col("q_hash").isNull() | (F.col("content_hash") != F.col("q_hash")))
    offered = both if where is None else both.join(files.where(where).select("id"), "id", "left_semi")
    found = offered.join(F.broadcast(one), other).withColumn("sim", F.round(cosine(F.col("embedding"), F.col("q")), 6))
    sim = F.coalesce("sim", F.lit(0.0))
    confidence = F.when(sim >= 0.6, "very_likely").when(sim >= 0.45, "likely").otherwise("possible")
    found = found.orderBy(F.desc_nulls_first("sim"), "id").limit(k)
    return found.select("id", "sim", (half_up(sim * 100) / 100).alias("score"), confidence.alias("confidence"), F.concat(half_up(sim * 100).cast("string"), F.lit("% similar content")).alias("reason"))


def suggest(branches: list[Column], rows: list[DataFrame], prefix: str | None, n: int = 8, starters: tuple[str, ...] = STARTERS) -> DataFrame:
    """Distinct terms of all branches that contain the trimmed prefix, ignoring case; the starters for a prefix under two characters.

    A branch that is an array lends each of its elements.
    """
    spark, wanted = rows[0].sparkSession, (prefix or "").strip().lower()
    if len(wanted) < 2:
        return spark.createDataFrame([(s,) for s in starters], "term string")
    parts = []
    for b, r in zip(branches, rows, strict=True):
        several = isinstance(r.select(b).schema[0].dataType, T.ArrayType)
        parts.append(r.select((F.explode(b) if several else b).alias("term")).select(F.lower("term").alias("term")))
    matching = reduce(lambda a, b: a.unionByName(b), [p.where(F.col("term").like(f"%{wanted}%")) for p in parts])
    return matching.distinct().orderBy("term").limit(n)


def embedding_text(parts: list[Column], cut: int = 2_000, cut_at: tuple[int, ...] = ()) -> Column:
    """The parts that are not empty, on lines of their own; those at the places cut_at are cut to their first characters."""
    short = [F.left(p, F.lit(cut)) if i in cut_at else p for i, p in enumerate(parts)]
    return F.concat_ws("\n", *[F.nullif(p, F.lit("")) for p in short])


def media_embedding_text() -> Column:
    """What a media file's vector is made of; texts read and notes count with their first 2,000 characters."""
    joined = lambda c: F.array_join(F.col(c), " ")
    folders = F.translate(F.regexp_extract("relative_path", "^(.*)/[^/]*$", 1), "/", " ")
    parts = [F.col("name"), folders, F.col("description"), joined("tags"), joined("objects"), joined("people"), F.col("scene"), F.col("doc_type"), F.col("ocr_text"), F.col("camera_make"), F.col("camera_model"), F.date_format("date_taken", "yyyy-MM-dd"), F.col("user_description"), joined("user_tags"), F.col("notes")]
    return embedding_text(parts, cut_at=(8, 14))


def save_search(saved: DataFrame, name: str, query: str, intent: Intent | None, at: Column) -> DataFrame:
    """The saved searches (id, name, query, intent as JSON, created_at, last_used_at) with one more, its id the next."""
    name, query = name.strip(), query.strip()
    if not name or not query:
        raise ValueError("name and query are required")
    row = saved.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("long").alias("id"))
    text = json.dumps(asdict(intent)) if intent else None
    return saved.unionByName(row.select("id", F.lit(name[:100]).alias("name"), F.lit(query[:500]).alias("query"), F.lit(text).cast("string").alias("intent"), at.alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("last_used_at")))


def rerun_search(saved: DataFrame, search_id: int) -> Intent:
    """The intent of a saved search: the stored one, else the plain reading of its words."""
    row = saved.where(F.col("id") == search_id).select("query", "intent").first()
    if row is None:
        raise LookupError("saved search not found")
    if row["intent"] is None:
        return parse_words(row["query"])
    return Intent(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(row["intent"]).items()})


def log_search(history: DataFrame, query: str, results: int, at: Column, keep: int = 50) -> DataFrame:
    """The history (id, query, results, created_at) with one more search, its newest keep rows."""
    row = history.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("long").alias("id"))
    more = row.select("id", F.lit(query).alias("query"), F.lit(results).cast("long").alias("results"), at.alias("created_at"))
    return history.unionByName(more).orderBy(F.desc("created_at"), F.desc("id")).limit(keep)


def effective_tags(ai: Column, hidden: Column, user: Column) -> Column:
    """The found tags that are not hidden, ignoring case, then the user's; order and repeats stay."""
    none = F.array().cast("array<string>")
    low = F.transform(F.coalesce(hidden, none), lambda h: F.lower(h))
    return F.concat(F.filter(F.coalesce(ai, none), lambda t: ~F.array_contains(low, F.lower(t))), F.coalesce(user, none))


def edit_tags(ai: Column, hidden: Column, user: Column, add: str | None = None, remove: str | None = None) -> tuple[Column, Column]:
    """(hidden, user) after an edit: a removed tag leaves the user's and hides a found one; an added one is shown, and the user's if not found."""
    is_low = lambda word: lambda t: F.lower(t) == word.lower()
    if remove is not None:
        user = F.filter(user, lambda t: F.lower(t) != remove.lower())
        hidden = F.when(F.exists(ai, is_low(remove)) & ~F.exists(hidden, is_low(remove)), F.concat(hidden, F.array(F.lit(remove)))).otherwise(hidden)
    if add is not None:
        hidden = F.filter(hidden, lambda t: F.lower(t) != add.lower())
        user = F.when(F.exists(ai, is_low(add)) | F.exists(user, is_low(add)), user).otherwise(F.concat(user, F.array(F.lit(add))))
    return hidden, user
