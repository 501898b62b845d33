"""Queries over what changes: tables of deltas, folders that differ, JSON properties, places near each other, names as people sort them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlake.operators import grams, jobs, observed, props, ranked, reconcile, related
from lumenlake.plans.registry import query
from lumenlake.sources.adapters import PLACES_SQL, SNAPSHOT_SQL, day, listed, places, stored, table
from lumenlake.sources.deltas import UpsertTable
from lumenlake.sources.scratch import working_folder

UPDATED = ["size_bytes", "quick_fingerprint", "modified_at"]


@query(f"""WITH {SNAPSHOT_SQL}, k AS (SELECT relative_path FROM stored UNION SELECT relative_path FROM listed WHERE size_bytes % 2 = 0 OR size_bytes % 3 = 0),
j AS (SELECT k.relative_path, s.id, s.relative_path IS NOT NULL AS known, coalesce(s.size_bytes % 5 = 0, FALSE) AS gone, l.size_bytes % 2 = 0 AS first, coalesce(l.size_bytes % 3 = 0, FALSE) AS second, s.size_bytes AS s_size, s.quick_fingerprint AS s_mark, s.modified_at AS s_at, s.thumbnail, l.size_bytes AS l_size, l.quick_fingerprint AS l_mark, l.modified_at AS l_at
    FROM k LEFT JOIN stored s USING (relative_path) LEFT JOIN listed l USING (relative_path))
SELECT relative_path, CASE WHEN NOT gone THEN id END AS id, CASE WHEN second OR (first AND NOT gone) THEN l_size ELSE s_size END AS size_bytes, CASE WHEN second OR (first AND NOT gone) THEN l_mark ELSE s_mark END AS quick_fingerprint,
    CASE WHEN NOT gone THEN thumbnail END AS thumbnail, CASE WHEN second OR (first AND NOT gone) THEN l_at ELSE s_at END AS modified_at FROM j WHERE second OR (NOT gone AND (first OR known))""")
def merge_upsert_deltas(spark, d):
    """The stored snapshot as a bucketed table; two parts of a listing as upserts, and deletions between them; read without rewriting the base."""
    folder = working_folder(spark, "deltas")
    found = UpsertTable(spark, folder, f"deltas_{folder[-32:]}", "relative_path", UPDATED, ("thumbnail",))
    old, new = stored(spark, d), listed(spark, d)
    found.create(old)
    found.upsert(new.where("size_bytes % 2 = 0"), 1)
    found.delete(old.where("size_bytes % 5 = 0"), 2)
    found.upsert(new.where("size_bytes % 3 = 0"), 3)
    return found.read()


FOLDERS_SQL = """s AS (SELECT source || '/' || doc_id % 9 || '/' || doc_id AS relative_path, n_chars AS size_bytes, text AS mark, TIMESTAMP '2024-01-01' + to_days((doc_id % 50)::INTEGER) AS modified_at FROM documents WHERE doc_id % 40 <> 3),
l AS (SELECT CASE WHEN doc_id % 36 = 10 THEN source || '/moved/' || doc_id ELSE source || '/' || doc_id % 9 || '/' || doc_id END AS relative_path, n_chars AS size_bytes, text AS mark, TIMESTAMP '2024-01-01' + to_days((doc_id % 50 + CASE WHEN doc_id % 45 = 2 THEN 1 ELSE 0 END)::INTEGER) AS modified_at FROM documents)"""


def _snapshots(spark, d):
    """Two snapshots that differ in few folders: files added, files touched, files moved."""
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    doc, home = k.cast("string"), F.concat("source", F.lit("/"), (k % 9).cast("string"), F.lit("/"), k.cast("string"))
    rows = lambda path, shift: docs.select(path.alias("relative_path"), F.col("n_chars").alias("size_bytes"), F.sha2("text", 256).alias("quick_fingerprint"), day(k % 50 + shift, "2024-01-01").alias("modified_at"), k.alias("id"))
    before = rows(home, F.lit(0)).where("id % 40 <> 3").drop("id")
    moved = F.when(k % 36 == 10, F.concat("source", F.lit("/moved/"), doc)).otherwise(home)
    return rows(moved, F.when(k % 45 == 2, 1).otherwise(0)).drop("id"), before


@query(f"""WITH {FOLDERS_SQL}, n AS (SELECT * FROM l WHERE relative_path NOT IN (SELECT relative_path FROM s)), o AS (SELECT * FROM s WHERE relative_path NOT IN (SELECT relative_path FROM l)),
m AS (SELECT a.relative_path AS from_path, b.relative_path AS to_path FROM (SELECT *, row_number() OVER (PARTITION BY mark ORDER BY relative_path) AS nth FROM o WHERE mark IS NOT NULL) a JOIN (SELECT *, row_number() OVER (PARTITION BY mark ORDER BY relative_path) AS nth FROM n) b USING (mark, nth))
SELECT coalesce(l.relative_path, s.relative_path) AS relative_path, m.from_path,
    CASE WHEN l.relative_path IS NULL THEN 'DELETED' WHEN s.relative_path IS NOT NULL THEN CASE WHEN l.size_bytes = s.size_bytes AND l.modified_at = s.modified_at THEN 'UNCHANGED' ELSE 'MODIFIED' END WHEN m.from_path IS NOT NULL THEN 'MOVED' ELSE 'NEW' END AS action
FROM l FULL JOIN s ON l.relative_path = s.relative_path LEFT JOIN m ON m.to_path = l.relative_path WHERE l.relative_path IS NOT NULL OR s.relative_path NOT IN (SELECT from_path FROM m)""")
def reconcile_by_folders(spark, d):
    """Only files of folders whose digests differ are joined."""
    return reconcile.reconcile_changed(*_snapshots(spark, d))


@query(f"""WITH {FOLDERS_SQL}, c AS (SELECT (SELECT count(*) FROM s) AS live_before, (SELECT count(*) FROM l) AS disk_files, (SELECT count(*) FROM l JOIN s USING (relative_path) WHERE l.size_bytes = s.size_bytes AND l.modified_at = s.modified_at) AS unchanged,
    (SELECT count(*) FROM l JOIN s USING (relative_path) WHERE l.size_bytes IS DISTINCT FROM s.size_bytes OR l.modified_at IS DISTINCT FROM s.modified_at) AS modified)
SELECT disk_files, live_before, disk_files AS live_after, unchanged, modified FROM c""")
def job_numbers(spark, d):
    """What a reconcile's write tells of its rows, with its invariants held."""
    now, before = _snapshots(spark, d)
    folder = working_folder(spark, "actions")
    told = observed.write_actions(reconcile.reconcile_changed(now, before), lambda df: df.write.parquet(folder), before.count())
    columns = ("disk_files", "live_before", "live_after", "unchanged", "modified")
    return spark.range(1).select(*[F.lit(told[c]).cast("long").alias(c) for c in columns])


@query(f"""WITH {FOLDERS_SQL}, f AS (SELECT regexp_replace(relative_path, '/[^/]*$', '') AS folder, sum(hash(relative_path, size_bytes, modified_at)) AS h, count(*) AS n FROM s GROUP BY 1),
g AS (SELECT regexp_replace(relative_path, '/[^/]*$', '') AS folder, sum(hash(relative_path, size_bytes, modified_at)) AS h, count(*) AS n FROM l GROUP BY 1),
changed AS (SELECT coalesce(f.folder, g.folder) AS folder FROM f FULL JOIN g USING (folder) WHERE f.h IS DISTINCT FROM g.h OR f.n IS DISTINCT FROM g.n),
trees AS (SELECT folder FROM g UNION SELECT split_part(folder, '/', 1) FROM g UNION SELECT '' FROM g), same AS (SELECT folder FROM trees t WHERE NOT EXISTS (SELECT 1 FROM changed c WHERE t.folder = '' OR c.folder = t.folder OR starts_with(c.folder, t.folder || '/')))
SELECT folder FROM same WHERE folder <> '' AND NOT (folder LIKE '%/%' AND split_part(folder, '/', 1) IN (SELECT folder FROM same)) AND NOT EXISTS (SELECT 1 FROM same WHERE folder = '') UNION ALL SELECT folder FROM same WHERE folder = ''""")
def folders_passed_over(spark, d):
    """The highest folders whose whole trees are as before."""
    now, before = (reconcile.tree_digests(reconcile.folder_digests(x)) for x in _snapshots(spark, d))
    return reconcile.equal_trees(now, before)


@query("""WITH p AS (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN left(props, length(props) - 1) WHEN event_id % 11 = 0 THEN '{"other": [1]}' WHEN event_id % 13 = 0 THEN NULL ELSE props END AS props FROM events),
v AS (SELECT event_type, props, CASE WHEN json_valid(props) THEN try_cast(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM p)
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE props IS NOT NULL AND NOT json_valid(props)) AS bad, count(k) AS known, coalesce(sum(k), 0)::BIGINT AS total, count(DISTINCT k) AS different FROM v GROUP BY 1""")
def props_by_type(spark, d):
    """The number in each event's properties, by type of event; some are broken, missing, or have another member."""
    k, text = F.col("event_id"), F.col("props")
    broken = F.when(k % 7 == 0, F.expr("left(props, length(props) - 1)")).when(k % 11 == 0, '{"other": [1]}').when(k % 13 == 0, F.lit(None).cast("string")).otherwise(text)
    return props.counted(table(spark, d, "events").withColumn("props", broken), "event_type", "props", "$.k")


@query("""WITH p AS (SELECT event_id, '{"kind": "' || event_type || '", "value": ' || event_id % 50 || '}' AS props FROM events)
SELECT event_id, 0 AS pos, 'kind' AS key, json_extract_string(props, '$.kind') AS value FROM p UNION ALL SELECT event_id, 1, 'value', json_extract_string(props, '$.value') FROM p""")
def props_members(spark, d):
    """A row for each member of each event's properties, made of its type and number."""
    text = F.concat(F.lit('{"kind": "'), "event_type", F.lit('", "value": '), (F.col("event_id") % 50).cast("string"), F.lit("}"))
    found = props.parsed(table(spark, d, "events").select("event_id", text.alias("text")), "text", "v")
    return props.entries(found, "v").select("event_id", "pos", "key", props.prop("value", "$").alias("value"))


@query(f"WITH {PLACES_SQL} SELECT a.id, count(b.id) AS near FROM places a LEFT JOIN places b ON a.id <> b.id AND abs(a.lat - b.lat) < 0.5 AND abs(a.lon - b.lon) < 0.5 GROUP BY 1")
def near_places(spark, d):
    return related.near_counts(places(spark, d), "0.5").select("id", "near")


NAMES = ("Ärger", "arger", "Zoo", "zebra", "éclair", "Eclair", "öde", "Oder", "ODER", "straße")
_NAMED = f"list_extract([{', '.join(repr(n) for n in NAMES)}], (doc_id % {len(NAMES)} + 1)::INTEGER) || ' ' || doc_id % 3"


@query(f"""WITH f AS (SELECT DISTINCT {_NAMED} AS name, doc_id % 4 = 0 AS is_folder FROM documents)
SELECT row_number() OVER (ORDER BY is_folder DESC, name COLLATE de, name) AS place, name, is_folder FROM f""")
def names_in_order(spark, d):
    """Names with accents and of either case, folders first, in the order of people."""
    k = F.col("doc_id")
    named = F.concat(F.get(F.array(*map(F.lit, NAMES)), (k % len(NAMES)).cast("int")), F.lit(" "), (k % 3).cast("string"))
    rows = table(spark, d, "documents").select(named.alias("name"), (k % 4 == 0).alias("is_folder")).distinct()  # as many as there are names here
    ordered = rows.orderBy(*jobs.folders_first(F.col("is_folder"), F.col("name"))).agg(F.collect_list(F.struct("name", "is_folder")).alias("l"))
    return ordered.select(F.posexplode("l").alias("at", "x")).select((F.col("at") + 1).cast("long").alias("place"), "x.name", "x.is_folder")


PATTERNS = ("the ", "Licen", "%", "a", "@exam", "ion. ", "éa", "zzzzz")


@query(" UNION ALL ".join(f"SELECT {p!r} AS pattern, doc_id FROM documents WHERE contains(lower(text), lower({p!r}))" for p in PATTERNS))
def substrings(spark, d):
    """Documents by what their texts contain, through one index of trigrams."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = grams.write_index(docs, "doc_id", "text", working_folder(spark, "grams"))
    return grams.search_all(docs, index, list(PATTERNS), "doc_id", "text")


LINES = "l_shipdate DESC NULLS LAST, l_orderkey, l_linenumber"


def _lines(spark, d):
    lines = table(spark, d, "lineitem").withColumn("id", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    order = [F.desc_nulls_last("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")]
    return ranked.Ranked(lines.select("id", "l_orderkey", "l_linenumber", "l_shipdate"), order, working_folder(spark, "ranked"))


@query(f"SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY {LINES}) AS place FROM lineitem QUALIFY place BETWEEN 2951 AND 3000 OR place BETWEEN 51 AND 100")
def deep_pages(spark, d):
    """Two pages of fifty over all lines by date, one of them deep."""
    found = _lines(spark, d)
    return found.page(60, 50).unionByName(found.page(2, 50)).select("l_orderkey", "l_linenumber", "place")


@query(f"WITH i AS (SELECT *, l_orderkey || '-' || l_linenumber AS id FROM lineitem) SELECT id, lag(id) OVER (ORDER BY {LINES}) AS prev_id, lead(id) OVER (ORDER BY {LINES}) AS next_id FROM i")
def all_neighbours(spark, d):
    """The line before and after each line, by date, over the whole table as one sequence."""
    return _lines(spark, d).neighbours("id")
