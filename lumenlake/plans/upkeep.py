"""Queries over what a library keeps up: jobs, upserts, tags, folders, the cleanup queue and the trash; each beside its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.operators import analytics, dedupe, jobs, planning, reconcile, search
from lumenlake.plans.registry import query
from lumenlake.sources.adapters import MEDIA_SQL, day, media, table
from lumenlake.sources.listing import skip_reason
from lumenlake.streaming import events as streams

WITH = f"WITH {MEDIA_SQL}"

# Jobs

JOBS_SQL = """jobs AS (SELECT o_orderkey AS id, o_orderdate AS started_at, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate + to_seconds((o_orderkey % 50)::INTEGER) END AS finished_at, o_orderkey * 7 % 1000 AS processed_files, o_orderkey * 131072 AS processed_bytes,
    CASE o_orderstatus WHEN 'O' THEN 'executing' WHEN 'F' THEN 'failed' ELSE 'DONE' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'hash' END AS last_stage FROM orders),
t AS (SELECT *, CASE WHEN finished_at > started_at THEN epoch(finished_at) - epoch(started_at) END::DOUBLE AS duration FROM jobs),
r AS (SELECT *, processed_files / duration AS files_per_sec, processed_bytes / 1048576 / duration AS mb_per_sec FROM t)"""


def _jobs(spark, d):
    k, start = F.col("o_orderkey"), F.col("o_orderdate")
    status = F.when(F.col("o_orderstatus") == "O", "executing").when(F.col("o_orderstatus") == "F", "failed").otherwise("DONE")
    end = F.when(k % 6 != 0, start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k % 50).cast("decimal(18,6)")))
    rows = table(spark, d, "orders").select(k.alias("id"), start.alias("started_at"), end.alias("finished_at"), (k * 7 % 1000).alias("processed_files"), (k * 131072).alias("processed_bytes"), status.alias("status"), F.when(k % 3 == 0, "hash").alias("last_stage"))
    return jobs.throughput(rows)


@query(f"WITH {JOBS_SQL} SELECT id, duration, round(files_per_sec, 6) AS files_per_sec, round(mb_per_sec, 6) AS mb_per_sec FROM r")
def job_throughput(spark, d):
    return _jobs(spark, d).select("id", "duration", F.round("files_per_sec", 6).alias("files_per_sec"), F.round("mb_per_sec", 6).alias("mb_per_sec"))


@query(f"WITH {JOBS_SQL} SELECT round(avg(files_per_sec), 6) AS files_per_sec, round(avg(duration), 6) AS duration FROM (SELECT * FROM r WHERE status = 'DONE' AND files_per_sec > 0 ORDER BY started_at DESC NULLS LAST, id DESC LIMIT 5)")
def job_typical(spark, d):
    return jobs.typical(_jobs(spark, d)).select(F.round("files_per_sec", 6).alias("files_per_sec"), F.round("duration", 6).alias("duration"))


@query(f"WITH {JOBS_SQL} SELECT id, status FROM r WHERE status = 'executing' OR (status = 'failed' AND last_stage IS NOT NULL) ORDER BY started_at DESC NULLS LAST, id DESC LIMIT 50")
def jobs_resumable(spark, d):
    return jobs.resumable(_jobs(spark, d), newest="started_at").select("id", "status")


SCAN_ORDERS = {"date": "epoch(started_at)", "files": "processed_files", "duration": "duration", "filesPerSec": "files_per_sec", "mbPerSec": "mb_per_sec", "peakWorkers": "id * 11 % 64", "dirCache": "floor(CASE WHEN id % 90 > 0 THEN (id % 37)::DOUBLE / (id % 37 + id % 90) * 100 ELSE 100 * sign(id % 37) END + 0.5)"}


@query(f"WITH {JOBS_SQL} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS sort, id FROM r ORDER BY coalesce({c}::DOUBLE, 0) DESC, id LIMIT 15)" for k, c in SCAN_ORDERS.items()))
def scans_sorted(spark, d):
    k = F.col("id")
    rows = _jobs(spark, d).withColumns({"peak_workers": k * 11 % 64, "dir_cache": jobs.hit_rate(k % 37, k % 90)})
    pages = [jobs.sorted_scans(rows, k).limit(15).select(F.lit(k).alias("sort"), "id") for k in SCAN_ORDERS]
    return reduce(DataFrame.unionByName, pages)


# Upserts and updates


@query(f"""{WITH}, n AS (SELECT id, 'new ' || id AS description FROM media WHERE id % 3 = 0 UNION ALL SELECT -1 - id, 'first' FROM media WHERE id % 50 = 0)
SELECT coalesce(n.id, m.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.description ELSE m.description END AS description, m.notes FROM media m FULL JOIN n ON n.id = m.id""")
def upsert_columns(spark, d):
    old = media(spark, d).select("id", "description", "notes")
    new = old.where("id % 3 = 0").select("id", F.concat(F.lit("new "), F.col("id").cast("string")).alias("description"))
    first = old.where("id % 50 = 0").select((-1 - F.col("id")).alias("id"), F.lit("first").alias("description"))
    return reconcile.merge(new.unionByName(first), old, ["id"], ["description"]).select("id", "description", "notes")


@query(f"{WITH} SELECT id, CASE WHEN id % 7 = 3 THEN 'timeout' END AS error, description FROM media")
def upsert_errors(spark, d):
    rows = media(spark, d).select("id", "description", F.lit(None).cast("string").alias("error"))
    failed = rows.where("id % 7 = 3").select("id", F.lit("timeout").alias("error"))
    return reconcile.record_error(rows, failed, "id").select("id", "error", "description")


@query(f"{WITH} SELECT id, favorite OR id % 9 = 4 AS favorite FROM media")
def set_by_ids(spark, d):
    rows = media(spark, d).select("id", "favorite")
    return reconcile.set_where(rows, rows.where("id % 9 = 4").select("id"), "id", "favorite", F.lit(True))


@query("SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY r_name) AS id, r_name FROM region")
def inserted_ids(spark, d):
    return reconcile.inserted(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), table(spark, d, "region").select("r_name"))


# Tags

EMPTY = "coalesce({c}, [])"
REMOVED = "list_filter({u}, lambda t: lower(t) <> 'sunset')".format(u=EMPTY.format(c="user_tags"))
HIDES = "len(list_filter({a}, lambda t: lower(t) = 'sunset')) > 0 AND len(list_filter({h}, lambda t: lower(t) = 'sunset')) = 0".format(a=EMPTY.format(c="tags"), h=EMPTY.format(c="hidden_tags"))
SHOWN = "list_filter({h}, lambda t: lower(t) <> 'src1')".format(h=EMPTY.format(c="hidden_tags"))
KNOWN = "len(list_filter(list_concat({a}, {u}), lambda t: lower(t) = 'src1')) > 0".format(a=EMPTY.format(c="tags"), u=EMPTY.format(c="user_tags"))


@query(f"""{WITH} SELECT id, array_to_string(CASE WHEN {HIDES} THEN list_append({EMPTY.format(c='hidden_tags')}, 'sunset') ELSE {EMPTY.format(c='hidden_tags')} END, ',') AS hidden_after_removal, array_to_string({REMOVED}, ',') AS own_after_removal,
    array_to_string({SHOWN}, ',') AS hidden_after_adding, array_to_string(CASE WHEN {KNOWN} THEN {EMPTY.format(c='user_tags')} ELSE list_append({EMPTY.format(c='user_tags')}, 'SRC1') END, ',') AS own_after_adding FROM media""")
def tag_edits(spark, d):
    known = [F.coalesce(c, F.array().cast("array<string>")) for c in ("tags", "hidden_tags", "user_tags")]
    removed, added = search.edit_tags(*known, remove="sunset"), search.edit_tags(*known, add="SRC1")
    names = ("hidden_after_removal", "own_after_removal", "hidden_after_adding", "own_after_adding")
    return media(spark, d).select("id", *[F.array_join(c, ",").alias(n) for c, n in zip((*removed, *added), names, strict=True)])


# Folders and files


@query(f"{WITH} SELECT k.media_type, count(m.id) AS n FROM (VALUES ('photo'), ('archive'), ('audio')) k(media_type) LEFT JOIN media m USING (media_type) GROUP BY 1")
def types_zero_filled(spark, d):
    return analytics.zero_filled(analytics.histogram(media(spark, d), "media_type"), "media_type", ["photo", "archive", "audio"])


LISTING_SQL = "listing AS (SELECT relative_path, CASE WHEN id % 11 = 0 THEN 0 ELSE size_bytes END AS size_bytes, modified_at FROM media WHERE id % 13 <> 0)"


def _listing(spark, d):
    rows = media(spark, d).where("id % 13 <> 0")
    return rows.select("relative_path", F.when(F.col("id") % 11 == 0, 0).otherwise(F.col("size_bytes")).alias("size_bytes"), "modified_at")


@query(f"""{WITH}, {LISTING_SQL}, b AS (SELECT m.size_bytes AS known, l.size_bytes AS found FROM media m LEFT JOIN listing l USING (relative_path))
SELECT count(*) FILTER (WHERE found IS NULL) AS missing, count(*) FILTER (WHERE found = 0 AND known > 0) AS corrupt FROM b""")
def integrity_counts(spark, d):
    return reconcile.integrity(media(spark, d).select("relative_path", "size_bytes"), _listing(spark, d), most=None)


FOLDER = "CASE WHEN relative_path LIKE '%/%' THEN regexp_replace(relative_path, '/[^/]*$', '') ELSE '/' END"


@query(f"""{WITH}, {LISTING_SQL}, a AS (SELECT {FOLDER} AS folder, max(modified_at) AS changed, count(*) AS entries FROM listing GROUP BY 1), b AS (SELECT {FOLDER} AS folder, max(modified_at) AS changed, count(*) AS entries FROM media WHERE id % 4 <> 1 GROUP BY 1)
SELECT coalesce(a.folder, b.folder) AS folder FROM a FULL JOIN b ON a.folder = b.folder WHERE a.folder IS NULL OR b.folder IS NULL OR a.changed IS DISTINCT FROM b.changed OR a.entries <> b.entries""")
def folders_changed(spark, d):
    before = reconcile.directory_state(media(spark, d).where("id % 4 <> 1"))
    return reconcile.changed_folders(reconcile.directory_state(_listing(spark, d)), before).select("folder")


@query(f"""{WITH}, f AS (SELECT DISTINCT folder || '/' || x AS folder FROM media, (VALUES ('en'), ('de'), ('none')) v(x) UNION SELECT DISTINCT folder FROM media UNION SELECT 'bare')
SELECT folder FROM f WHERE NOT EXISTS (SELECT 1 FROM media m WHERE starts_with(m.relative_path, f.folder || '/'))""")
def folders_empty(spark, d):
    files = media(spark, d)
    below = files.select(F.explode(F.array(*[F.concat("folder", F.lit(f"/{x}")) for x in ("en", "de", "none")])).alias("folder"))
    bare = spark.createDataFrame([("bare",)], "folder string")
    return analytics.empty_folders(below.unionByName(files.select("folder")).unionByName(bare).distinct(), files)


@query(f"{WITH} SELECT id, 'thumbs/' || id AS thumbnail_path FROM media WHERE id % 3 <> 0 AND id % 5 = 0")
def thumbnail_orphans(spark, d):
    path = F.concat(F.lit("thumbs/"), F.col("id").cast("string"))
    files = media(spark, d).select("id", F.when(F.col("id") % 3 != 0, path).alias("thumbnail_path"))
    return jobs.orphans(files, media(spark, d).where("id % 5 <> 0").select(path.alias("full_path"))).select("id", "thumbnail_path")


@query(f"""{WITH} SELECT id, CASE WHEN coalesce(scanner_version, 0) < 3 THEN 3 ELSE scanner_version END AS scanner_version, CASE WHEN coalesce(scanner_version, 0) < 3 AND id % 2 = 0 THEN 1000 + id % 10 ELSE width END AS width FROM media""")
def metadata_refreshed(spark, d):
    files = media(spark, d).select("id", "scanner_version", F.col("width").cast("long").alias("width"))
    fresh = media(spark, d).where("id % 2 = 0").select("id", (1000 + F.col("id") % 10).alias("width"))
    return jobs.refreshed(files, fresh, 3)


SKIPPED = [
    ("@eaDir/x.jpg", "system_directory"), (".git/config.txt", "system_directory"), ("a/lost+found/x.png", "system_directory"), ("a/._b.jpg", "system_file"), ("a/Thumbs.DB", "system_file"), ("a/b.xmp", "system_file"),
    ("a/b.tmp", "system_file"), ("a/~$x.docx", "system_file"), ("a/.hidden.pdf", "hidden_file"), ("a/b.bin", "other_type_excluded"), ("a/b", "other_type_excluded"), ("a/b.mts", None), ("plain/b.key", None), ("p/b.opus", None),
]


@query("WITH k(i, path, reason) AS (VALUES " + ", ".join(f"({i}, '{p}', {repr(r) if r else 'NULL'})" for i, (p, r) in enumerate(SKIPPED)) + f") SELECT doc_id AS id, doc_id || '/' || path AS relative_path, reason FROM documents JOIN k ON i = doc_id % {len(SKIPPED)}")
def listing_skips(spark, d):
    path = F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.get(F.array(*[F.lit(p) for p, _ in SKIPPED]), (F.col("doc_id") % len(SKIPPED)).cast("int")))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), path.alias("relative_path")).withColumn("name", F.substring_index("relative_path", "/", -1))
    return rows.select("id", "relative_path", skip_reason().alias("reason"))


# Cleanup

QUEUE_SQL = "e AS (SELECT user_id % 60 AS group_hash, ts AS added_at, event_id, (value * 100)::BIGINT AS saved FROM events), q AS (SELECT * FROM e WHERE group_hash NOT IN (SELECT user_id % 60 FROM events WHERE event_id % 97 = 5) QUALIFY row_number() OVER (PARTITION BY group_hash ORDER BY added_at DESC, event_id DESC) = 1)"


def _queue(spark, d):
    events = table(spark, d, "events")
    entries = events.select((F.col("user_id") % 60).alias("group_hash"), F.col("ts").alias("added_at"), "event_id", F.rint(F.col("value") * 100).cast("long").alias("saved"))
    return dedupe.queue(entries, events.where("event_id % 97 = 5").select((F.col("user_id") % 60).alias("group_hash")).distinct())


@query(f"WITH {QUEUE_SQL} SELECT group_hash, event_id, saved FROM q")
def cleanup_queue(spark, d):
    return _queue(spark, d).select("group_hash", "event_id", "saved")


@query(f"WITH {QUEUE_SQL} SELECT count(*) AS groups, coalesce(sum(saved), 0)::BIGINT AS saved FROM q")
def cleanup_savings(spark, d):
    return dedupe.queue_savings(_queue(spark, d))


@query(f"""{WITH}, t AS (SELECT 'trash/' || id AS trash_path, relative_path AS original_path, CASE WHEN id % 5 <> 0 THEN TIMESTAMP '2024-01-01' + to_days((id % 60)::INTEGER) END AS expires_at FROM media WHERE id % 3 <> 0)
SELECT 'trash/' || m.id AS trash_path, CASE WHEN t.trash_path IS NULL THEN 'unknown' WHEN coalesce(expires_at < TIMESTAMP '2024-01-20', false) THEN 'expired' WHEN m.id % 4 = 1 THEN 'occupied' ELSE 'ok' END AS state FROM media m LEFT JOIN t ON t.trash_path = 'trash/' || m.id""")
def trash_restorable(spark, d):
    files = media(spark, d).withColumn("trash_path", F.concat(F.lit("trash/"), F.col("id").cast("string")))
    trash = files.where("id % 3 <> 0").select("trash_path", F.col("relative_path").alias("original_path"), F.when(F.col("id") % 5 != 0, day(F.col("id") % 60, "2024-01-01")).alias("expires_at"))
    there = files.where("id % 4 = 1").select(F.col("relative_path").alias("path"))
    return dedupe.restorable(trash, files.select("trash_path"), there, F.lit("2024-01-20").cast("timestamp_ntz"))


# Plans and events


@query(f"{WITH} SELECT count(*) AS planned, count(*) FILTER (WHERE id % 21 <> 0) AS staged, count(*) = count(*) FILTER (WHERE id % 21 <> 0) AS equal FROM media")
def plan_staged(spark, d):
    return planning.same_plan(media(spark, d), media(spark, d).where("id % 21 <> 0"))


# A family holds all names of one stem and extension: each file after the first of its name (all, if the name is on disk) takes the next number that no
# name on disk or first choice has. Here names are 0.txt to 39.txt and 0_2.txt, on disk are 0_1.txt and every fifth name.
NAMES_SQL = """n AS (SELECT doc_id AS id, CASE WHEN doc_id % 41 = 40 THEN '0_2' ELSE (doc_id % 41)::VARCHAR END AS stem FROM documents), disk AS (SELECT '0_1' AS stem UNION SELECT DISTINCT stem FROM n WHERE stem NOT LIKE '%_2' AND stem::INTEGER % 5 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY id) - CASE WHEN stem IN (SELECT stem FROM disk) THEN 0 ELSE 1 END AS nth FROM n WHERE stem <> '0_2' UNION ALL SELECT *, row_number() OVER (ORDER BY id) - 1 FROM n WHERE stem = '0_2')"""


@query(f"WITH {NAMES_SQL.replace(chr(39) + '%_2' + chr(39), chr(39) + '0~_2' + chr(39) + ' ESCAPE ' + chr(39) + '~' + chr(39))} SELECT id, 'd/' || stem || CASE WHEN nth = 0 THEN '' ELSE '_' || (nth + CASE WHEN stem = '0' THEN CASE WHEN EXISTS (SELECT 1 FROM n WHERE stem = '0_2') THEN 2 ELSE 1 END ELSE 0 END) END || '.txt' AS dest_path FROM o")
def names_made_unique(spark, d):
    k = F.col("doc_id")
    stem = F.when(k % 41 == 40, "0_2").otherwise((k % 41).cast("string"))
    routes = table(spark, d, "documents").select(k.alias("id"), stem.alias("stem"))
    named = F.concat(F.lit("d/"), "stem", F.lit(".txt"))
    disk = routes.where((F.col("stem") != "0_2") & (F.col("stem").try_cast("int") % 5 == 0)).select(named.alias("dest_path")).unionByName(spark.createDataFrame([("d/0_1.txt",)], "dest_path string"))
    return planning.renamed(routes.select("id", named.alias("dest_path")), disk, ["id"])


@query("SELECT page_id FROM pages WHERE NOT (regexp_replace(url, '^[a-z]+://', '') = 'therha.example.org' OR starts_with(regexp_replace(url, '^[a-z]+://', ''), 'therha.example.org/'))")
def changes_of_others(spark, d):
    return streams.without_own(table(spark, d, "pages"), F.regexp_replace("url", "^[a-z]+://", ""), "therha.example.org").select("page_id")
