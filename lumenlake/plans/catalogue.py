"""All library queries by name, with the SQL that each has to agree with.

Parameters are fixed, so that results are; every order before a limit is total.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlake.functions.exprs import all_of, geo_cell, live, percentage, under
from lumenlake.operators import analytics, cluster, collections, dedupe, planning, reconcile, related, search
from lumenlake.plans.registry import query
from lumenlake.sources.adapters import FILES_SQL, PLACES_SQL, SNAPSHOT_SQL, files, listed, places, stored, table
from lumenlake.streaming import events as streams

WITH = f"WITH {FILES_SQL} "
EXACT_SQL = "exact AS (SELECT content_hash, count(*) AS n, max(size_bytes) AS largest, sum(size_bytes) AS total FROM files GROUP BY 1 HAVING count(*) > 1)"

# Duplicates


@query(f"WITH {FILES_SQL}, {EXACT_SQL} SELECT count(*) AS groups, coalesce(sum((n - 1) * largest), 0)::BIGINT AS wasted FROM exact")
def dup_summary(spark, d):
    return dedupe.summary(files(spark, d))


@query(f"""WITH {FILES_SQL}, {EXACT_SQL},
alike AS (SELECT quick_fingerprint, count(DISTINCT id) AS n, sum(size_bytes) AS total FROM files GROUP BY 1
    HAVING count(DISTINCT id) > 1 AND NOT (count(DISTINCT content_hash) = 1 AND min(content_hash) IS NOT NULL)),
ranked AS (SELECT * FROM (
    SELECT 'EXACT' AS kind, 5 AS confidence, content_hash AS group_key, n, floor((n - 1) * (total / n) + 0.5)::BIGINT AS wasted FROM exact
    UNION ALL SELECT 'FINGERPRINT', 4, quick_fingerprint, n, floor((n - 1) * (total / n) + 0.5)::BIGINT FROM alike) ORDER BY wasted DESC, kind, group_key LIMIT 20),
held AS (SELECT r.*, f.id, row_number() OVER (PARTITION BY kind, group_key ORDER BY relative_path, id) AS place
    FROM ranked r JOIN files f ON CASE kind WHEN 'EXACT' THEN content_hash ELSE quick_fingerprint END = group_key)
SELECT kind, confidence::INTEGER AS confidence, group_key, n, wasted, string_agg(id::VARCHAR, ',' ORDER BY place) AS members
FROM held WHERE place <= 10 GROUP BY ALL""")
def dup_report(spark, d):
    return dedupe.report(files(spark, d)).select("kind", "confidence", "group_key", "n", "wasted", "members")


@query(f"WITH {FILES_SQL}, {EXACT_SQL} SELECT content_hash, id, size_bytes FROM files WHERE content_hash IN (SELECT content_hash FROM exact)")
def dup_members(spark, d):
    return dedupe.members(files(spark, d)).select("content_hash", "id", "size_bytes")


@query(f"""WITH {FILES_SQL}, s AS (SELECT size_bytes, quick_fingerprint FROM files GROUP BY ALL HAVING count(*) > 1)
SELECT sha256(ocr_text) AS full_hash, count(*) AS n, min(id) AS first_id FROM files JOIN s USING (size_bytes, quick_fingerprint) GROUP BY 1 HAVING count(*) > 1""")
def dup_two_stage(spark, d):
    return dedupe.two_stage(files(spark, d), F.sha2("ocr_text", 256))


@query(f"""WITH {FILES_SQL}, {EXACT_SQL} SELECT (SELECT count(*) FROM exact) AS groups, (SELECT coalesce(sum((n - 1) * largest), 0)::BIGINT FROM exact) AS wasted,
(SELECT count(*) FROM files WHERE size_bytes >= 5000) AS large_files, (SELECT coalesce(sum(size_bytes), 0)::BIGINT FROM files WHERE size_bytes >= 5000) AS large_size,
(SELECT count(*) FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01') AS old_items""")
def cleanup_summary(spark, d):
    dated = table(spark, d, "orders").select(F.col("o_orderdate").alias("dated"))
    return dedupe.cleanup_summary(files(spark, d), dated, F.lit("1996-01-01").cast("timestamp_ntz"), 5000)


# Library analytics


@query(WITH + "SELECT count(*) AS total_files, coalesce(sum(size_bytes), 0)::BIGINT AS total_size FROM files")
def lib_totals(spark, d):
    return analytics.totals(files(spark, d))


@query(WITH + ", t AS (SELECT media_type, count(*) AS n, sum(size_bytes)::BIGINT AS size FROM files GROUP BY 1) SELECT *, floor(size / (SELECT CASE WHEN sum(size) = 0 THEN 1 ELSE sum(size) END FROM t) * 1000 + 0.5) / 10 AS percentage FROM t")
def type_breakdown(spark, d):
    return analytics.type_breakdown(files(spark, d))


@query(WITH + "SELECT CASE WHEN relative_path LIKE '%/%' THEN split_part(relative_path, '/', 1) ELSE '/' END AS folder, count(*) AS n, sum(size_bytes)::BIGINT AS size FROM files GROUP BY 1 ORDER BY size DESC, folder LIMIT 20")
def top_folders(spark, d):
    return analytics.top_folders(files(spark, d))


PATH_SQL = "p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)"


def _paths(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))


@query(f"""WITH {PATH_SQL}, s AS (SELECT string_split(path, '/') AS parts FROM p), u AS (SELECT parts, unnest(generate_series(1, len(parts) - 1)) AS i FROM s WHERE len(parts) > 1),
f AS (SELECT array_to_string(parts[1:i], '/') AS folder, i FROM u)
SELECT folder, i::INTEGER AS depth, CASE WHEN i > 1 THEN regexp_replace(folder, '/[^/]*$', '') END AS parent, count(*) AS n_files FROM f GROUP BY ALL""")
def folder_tree(spark, d):
    return analytics.folder_tree(_paths(spark, d), "path")


@query(f"""WITH {PATH_SQL}, k AS (SELECT DISTINCT split_part(path, '/', 1) AS folder, CASE WHEN len(string_split(path, '/')) > 2 THEN split_part(path, '/', 2) END AS child FROM p)
SELECT folder, count(child) AS children FROM k GROUP BY 1""")
def folder_children(spark, d):
    parts = F.split("path", "/")
    child = F.when(F.size(parts) > 2, parts[1])
    return _paths(spark, d).select(parts[0].alias("folder"), child.alias("child")).distinct().groupBy("folder").agg(F.count("child").alias("children"))


@query(WITH + "SELECT id, name, size_bytes FROM files ORDER BY size_bytes DESC, id LIMIT 20")
def top_files(spark, d):
    return analytics.top_files(files(spark, d), 20, "id", "name", "size_bytes")


ORDER_DATE = "CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate END"


def _orders(spark, d):
    return table(spark, d, "orders").withColumn("dated", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate")))


@query(f"SELECT strftime({ORDER_DATE}, '%Y-%m') AS month, count(*) AS n, max(o_orderkey) AS cover_id FROM orders GROUP BY 1")
def timeline_months(spark, d):
    return analytics.timeline_months(_orders(spark, d), F.col("dated"), "o_orderkey")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1996-03' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 50")
def timeline_page(spark, d):
    month = table(spark, d, "orders").where((F.col("o_orderdate") >= F.lit("1996-03-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1996-04-01").cast("timestamp_ntz")))
    return analytics.page(month.select("o_orderkey", "o_orderdate"), [F.desc_nulls_last("o_orderdate"), F.col("o_orderkey")], 2, 50)


@query("SELECT o_orderstatus AS status, count(*) AS n, max(o_orderdate) AS latest, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_id FROM orders GROUP BY 1")
def status_histogram(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("latest"), F.max(F.struct("o_orderdate", "o_orderkey")).getField("o_orderkey").alias("latest_id"))


@query("SELECT CASE o_orderstatus WHEN 'O' THEN 'FAILED' WHEN 'P' THEN 'INTERRUPTED_BY_RESTART' ELSE 'DONE' END AS status, count(*) AS n FROM orders GROUP BY 1")
def job_recovery(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "RUNNING").when(F.col("o_orderstatus") == "P", "PAUSED").otherwise("DONE")
    return analytics.histogram(reconcile.recover_jobs(table(spark, d, "orders").withColumn("status", status)), "status")


@query("SELECT count(*) AS total, count(l.doc_id) AS analysed, count(*) FILTER (WHERE l.toxic = 1) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def filtered_counts(spark, d):
    both = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return both.agg(F.count(F.lit(1)).alias("total"), F.count("quality").alias("analysed"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query(WITH + "SELECT id, name, size_bytes FROM files WHERE name ILIKE '%1%' AND media_type IN ('en', 'fr') AND size_bytes >= 500 AND size_bytes <= 5000 AND (relative_path = 'src1' OR starts_with(relative_path, 'src1/'))")
def facet_search(spark, d):
    return files(spark, d).where(analytics.facet("1", ["en", "fr"], None, 500, 5000, "src1")).select("id", "name", "size_bytes")


@query(WITH + "SELECT id, relative_path FROM files WHERE (relative_path = 'src3/en' OR starts_with(relative_path, 'src3/en/')) AND name LIKE '%2%'")
def folder_prefix(spark, d):
    return files(spark, d).where(all_of(under(F.col("relative_path"), "src3/en"), F.col("name").like("%2%"))).select("id", "relative_path")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey > 1000 ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 250")
def keyset_page(spark, d):
    rows = table(spark, d, "lineitem").where(F.col("l_orderkey") > 1000).select("l_orderkey", "l_linenumber", "l_partkey")
    return rows.orderBy("l_orderkey", "l_linenumber", "l_partkey").limit(250)


ACTION = "CASE WHEN id % 4 = 0 THEN 'DELETED' WHEN id % 4 = 1 THEN 'NEW' WHEN id % 4 = 2 THEN 'RECYCLED' END"


@query(WITH + f", a AS (SELECT *, {ACTION} AS action FROM files) SELECT action, count(*) AS n, sum(size_bytes)::BIGINT AS size FROM a WHERE action IS DISTINCT FROM 'DELETED' GROUP BY 1")
def live_rows(spark, d):
    rest = F.col("id") % 4
    action = F.when(rest == 0, "DELETED").when(rest == 1, "NEW").when(rest == 2, "RECYCLED")
    return files(spark, d).withColumn("action", action).where(live(F.col("action"))).groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").cast("long").alias("size"))


KIND = "CASE WHEN l_quantity > 40 THEN 'image' WHEN l_quantity > 28 THEN 'video' WHEN l_quantity > 16 THEN 'document' WHEN l_quantity > 9 THEN 'archive' WHEN l_quantity > 5 THEN 'software' WHEN l_quantity > 2 THEN 'other' ELSE 'odd' END"
ENTRIES_SQL = f"""e AS (SELECT l_orderkey AS archive, {KIND} AS kind, l_extendedprice::BIGINT AS size, l_linenumber = 7 AS folder, l_orderkey % 20 = 0 AS locked FROM lineitem)"""
MIX_SQL = ENTRIES_SQL + """, c AS (SELECT archive, count(*) FILTER (WHERE NOT folder) AS n, count(*) FILTER (WHERE NOT folder AND kind = 'image') AS image, count(*) FILTER (WHERE NOT folder AND kind = 'video') AS video,
    count(*) FILTER (WHERE NOT folder AND kind = 'document') AS document, count(*) FILTER (WHERE NOT folder AND kind = 'archive') AS archive_n, count(*) FILTER (WHERE NOT folder AND kind = 'software') AS software,
    count(*) FILTER (WHERE NOT folder AND kind IN ('other', 'odd')) AS other, sum(size)::BIGINT AS size, bool_or(locked) AS locked FROM e GROUP BY 1),
mix AS (SELECT *, CASE WHEN locked THEN 'Password Protected' WHEN n = 0 THEN 'Unknown' WHEN archive_n / n > 0.25 THEN 'Nested Archives' WHEN image / n > 0.55 THEN 'Photo Archive' WHEN video / n > 0.45 THEN 'Video Archive'
    WHEN document / n > 0.45 THEN 'Document Backup' WHEN software / n > 0.35 THEN 'Software' WHEN greatest(image, video, document, archive_n, software, other) / n < 0.4 THEN 'Mixed' ELSE 'General' END AS category FROM c)"""


def _entries(spark, d):
    q = F.col("l_quantity")
    kind = F.when(q > 40, "image").when(q > 28, "video").when(q > 16, "document").when(q > 9, "archive").when(q > 5, "software").when(q > 2, "other").otherwise("odd")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), kind.alias("kind"), F.rint("l_extendedprice").cast("long").alias("size"), (F.col("l_linenumber") == 7).alias("folder"), (F.col("l_orderkey") % 20 == 0).alias("locked"))


@query(f"WITH {ENTRIES_SQL} SELECT kind, count(*) AS n, sum(size)::BIGINT AS size FROM e GROUP BY 1")
def category_totals(spark, d):
    return _entries(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("size"))


def _mix(spark, d):
    return analytics.archive_mix(_entries(spark, d), "key", "kind", "size", "folder", "locked")


@query(f"WITH {MIX_SQL} SELECT archive AS key, n, image, video, document, archive_n AS archive, software, other, size, archive_n > 0 AS nested, category FROM mix")
def archive_mix(spark, d):
    return _mix(spark, d)


@query(f"""WITH {MIX_SQL}, k AS (SELECT CASE WHEN archive % 30 <> 0 THEN category ELSE 'general' END AS category, archive AS id, size FROM mix),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY size DESC, id) AS r FROM k)
SELECT category, count(*) AS n, sum(size)::BIGINT AS size, string_agg(CASE WHEN r <= 5 THEN id::VARCHAR END, ',' ORDER BY r) AS samples FROM r GROUP BY 1""")
def archive_clusters(spark, d):
    return analytics.archive_clusters(_mix(spark, d).select(F.col("key").alias("id"), "size", F.when(F.col("key") % 30 != 0, F.col("category")).alias("category")))


# Joins and related items


@query("SELECT d.doc_id, count(*) OVER () AS total FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality >= 1) ORDER BY d.doc_id LIMIT 40")
def pending_items(spark, d):
    todo = related.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", "quality", 1)
    return analytics.with_total(todo, [F.col("doc_id")], 40)


CELL = "floor(lat * 10 + 0.5)::INTEGER AS lat10, floor(lon * 10 + 0.5)::INTEGER AS lon10"
CACHE_SQL = f"cells AS (SELECT DISTINCT {CELL}, c_nationkey FROM places), cache AS (SELECT lat10, lon10, min(n_name) AS name FROM cells JOIN nation ON c_nationkey = n_nationkey WHERE (lat10 + lon10) % 3 <> 0 GROUP BY ALL)"


def _cache(spark, d):
    celled = places(spark, d).select(geo_cell(F.col("lat")).alias("lat10"), geo_cell(F.col("lon")).alias("lon10"), "c_nationkey")
    named = celled.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.where((F.col("lat10") + F.col("lon10")) % 3 != 0).groupBy("lat10", "lon10").agg(F.min("n_name").alias("name"))


@query(f"WITH {PLACES_SQL}, {CACHE_SQL} SELECT DISTINCT lat10, lon10 FROM cells c WHERE NOT EXISTS (SELECT 1 FROM cache k WHERE k.lat10 = c.lat10 AND k.lon10 = c.lon10)")
def uncached_cells(spark, d):
    return collections.uncached_cells(places(spark, d), _cache(spark, d))


@query(f"WITH {PLACES_SQL}, {CACHE_SQL}, p AS (SELECT id, name, {CELL} FROM places) SELECT p.id, p.name, k.name AS cell_name FROM p JOIN cache k USING (lat10, lon10) WHERE k.name IS NOT NULL AND p.name IS DISTINCT FROM k.name")
def place_sync(spark, d):
    return collections.place_changes(places(spark, d), _cache(spark, d)).select("id", "name", "cell_name")


@query(f"WITH {PLACES_SQL} SELECT id, lat::DOUBLE AS lat, lon::DOUBLE AS lon FROM places WHERE abs(lat - 6.26) < 0.6 AND abs(lon + 38.06) < 0.6")
def geo_near(spark, d):
    return related.near_place(places(spark, d), 6.26, -38.06, 0.6).select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))


@query("""WITH mine AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey = 7), o AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM mine) AND l_partkey <> 7)
SELECT l_orderkey, l_partkey, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS place FROM o) WHERE place <= 12""")
def same_collection(spark, d):
    return related.same_collection(table(spark, d, "lineitem"), 7, "l_orderkey", "l_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate::DATE = (SELECT o_orderdate::DATE FROM orders WHERE o_orderkey = 1) AND o_orderkey <> 1")
def same_day(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    one = rows.where("o_orderkey = 1").limit(1).select("day")
    return rows.join(F.broadcast(one), "day", "left_semi").where("o_orderkey <> 1").select("o_orderkey")


@query("""WITH t AS (SELECT o_custkey, o_orderdate, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY ALL),
n AS (SELECT *, lag(hi) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS prev_id, lead(lo) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS next_id FROM t)
SELECT o_orderkey, prev_id, next_id FROM orders JOIN n USING (o_custkey, o_orderdate)""")
def neighbours(spark, d):
    return related.neighbours(table(spark, d, "orders"), "o_orderdate", "o_orderkey", "o_custkey")


@query("""SELECT 'prev' AS side, o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-06-15' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)
UNION ALL SELECT 'next', o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1997-06-15' ORDER BY o_orderdate, o_orderkey LIMIT 1)""")
def neighbour_of(spark, d):
    return related.neighbour_of(table(spark, d, "orders"), "o_orderdate", "o_orderkey", F.lit("1997-06-15").cast("timestamp_ntz"))


@query("SELECT label AS person, count(DISTINCT vec_id % 100) AS items, count(*) AS faces FROM embeddings GROUP BY 1")
def people_counts(spark, d):
    faces = table(spark, d, "embeddings").select(F.col("label").alias("person"), (F.col("vec_id") % 100).alias("item"))
    return related.people_counts(faces, "person", "item")


@query("WITH s AS (SELECT label, vec_id, embedding[1]::DOUBLE AS score FROM embeddings) SELECT label, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC NULLS LAST, vec_id) AS rn FROM s) WHERE rn = 1")
def best_per_group(spark, d):
    return related.best_per_group(table(spark, d, "embeddings").select("label", "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("score")), "label", "score", "vec_id")


@query("SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'user') AS user_turns, min(turn) AS first_turn, max(turn) AS last_turn, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def chat_threads(spark, d):
    return related.threads(table(spark, d, "conversations"))


@query("SELECT c_mktsegment AS segment, c_custkey, o_orderkey, l_linenumber FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey")
def bridge_join(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), "c_custkey")
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return c.join(o, "c_custkey").join(li, "o_orderkey").select("segment", "c_custkey", "o_orderkey", "l_linenumber")


# Vectors


@query("""WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, avg(x) AS m, count(*) AS n FROM e GROUP BY ALL)
SELECT label, max(n) AS n, round(sum(m * m), 4) AS norm2 FROM m GROUP BY 1""")
def centroids(spark, d):
    c = cluster.centroids(table(spark, d, "embeddings"), "label", "embedding", 12)
    return c.select("label", "n", F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x), 4).alias("norm2"))


COS = "list_cosine_similarity({a}, {b})"


@query(f"""WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, round(avg(x), 6) AS m FROM e GROUP BY ALL),
c AS (SELECT label AS c_id, list(m ORDER BY pos) AS c_v FROM m GROUP BY 1),
s AS (SELECT vec_id, c_id, round({COS.format(a="embedding::DOUBLE[]", b="c_v")}, 6) AS sim FROM embeddings, c),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, c_id) AS rn FROM s)
SELECT vec_id, CASE WHEN sim >= 0.42 THEN c_id END AS label, sim FROM b WHERE rn = 1""")
def assign_clusters(spark, d):
    e = table(spark, d, "embeddings")
    found = cluster.assign(e.drop("label"), cluster.centroids(e, "label", "embedding"), "vec_id", "embedding", "label")
    return found.select("vec_id", "label", "sim")


@query("""WITH r AS (SELECT CASE WHEN label = 1 THEN 0 ELSE label END AS label, vec_id, embedding FROM embeddings)
SELECT label, count(*) AS n, arg_max(vec_id, (embedding[1], -vec_id)) AS cover_id FROM r GROUP BY 1""")
def cluster_merge(spark, d):
    merged = cluster.merge(table(spark, d, "embeddings"), "label", 1, 0).withColumn("score", F.get("embedding", F.lit(0)))
    return merged.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(cluster.covers(merged, "label", "vec_id", "score"), "label")


# Search


@query("""SELECT term FROM (SELECT lower(unnest(string_split(p_name, ' '))) AS term FROM part UNION SELECT lower(p_brand) FROM part UNION SELECT lower(p_type) FROM part UNION SELECT lower(c_mktsegment) FROM customer)
WHERE term LIKE '%br%' ORDER BY term LIMIT 8""")
def suggest_terms(spark, d):
    part = table(spark, d, "part")
    return search.suggest([F.split("p_name", " "), F.col("p_brand"), F.col("p_type"), F.col("c_mktsegment")], [part, part, part, table(spark, d, "customer")], " Br ")


QUERY_VECTOR = [round(((i * 37) % 11 - 5) / 10, 1) for i in range(64)]
CANDIDATES_SQL = FILES_SQL + f""", cand AS (SELECT f.*, round({COS.format(a="embedding::DOUBLE[]", b=f"{QUERY_VECTOR}::DOUBLE[]")}, 6) AS sim FROM files f LEFT JOIN embeddings e ON e.vec_id = f.id
    WHERE media_type IN ('en', 'de') ORDER BY sim DESC NULLS LAST, id LIMIT 240)"""


def _candidates(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return search.candidates(files(spark, d), v, QUERY_VECTOR, F.col("media_type").isin("en", "de"), 60)


@query(f"WITH {CANDIDATES_SQL} SELECT id, media_type, sim FROM cand")
def hybrid_candidates(spark, d):
    return _candidates(spark, d).select("id", "media_type", "sim")


@query("""WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS ai, [upper(split_part(p_name, ' ', 2))] AS hidden, [p_brand] AS u FROM part)
SELECT p_partkey, array_to_string(list_concat(list_filter(ai, lambda x: NOT list_contains(list_transform(hidden, lambda h: lower(h)), lower(x))), u), ',') AS tags FROM t""")
def effective_tags(spark, d):
    ai = F.split("p_name", " ")
    tags = search.effective_tags(ai, F.array(F.upper(F.split_part("p_name", F.lit(" "), F.lit(2)))), F.array("p_brand"))
    return table(spark, d, "part").select("p_partkey", F.array_join(tags, ",").alias("tags"))


# Collections

@query("SELECT l_orderkey, count(DISTINCT l_partkey) AS items, max(l_partkey) AS cover_id FROM lineitem GROUP BY 1")
def collection_counts(spark, d):
    return collections.counts(table(spark, d, "lineitem"), "l_orderkey", "l_partkey")


@query("SELECT DISTINCT CASE WHEN l_orderkey % 10 = 1 THEN l_orderkey - 1 ELSE l_orderkey END AS l_orderkey, l_partkey FROM lineitem")
def album_merge(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    moved = rows.where("l_orderkey % 10 = 1").withColumn("l_orderkey", F.col("l_orderkey") - 1)
    return reconcile.insert_missing(rows.where("l_orderkey % 10 <> 1"), moved, ["l_orderkey", "l_partkey"])


# Snapshots

MOVES_SQL = SNAPSHOT_SQL + """, f AS (SELECT coalesce(l.relative_path, s.relative_path) AS relative_path, l.relative_path IS NOT NULL AS l, s.relative_path IS NOT NULL AS s, l.size_bytes AS ls, s.size_bytes AS ss, l.quick_fingerprint AS lf, s.quick_fingerprint AS sf, l.modified_at AS lm, s.modified_at AS sm
    FROM listed l FULL JOIN stored s ON l.relative_path = s.relative_path),
mv AS (SELECT a.relative_path AS from_path, b.relative_path AS to_path, fp AS quick_fingerprint
    FROM (SELECT relative_path, sf AS fp, row_number() OVER (PARTITION BY sf ORDER BY relative_path) AS nth FROM f WHERE NOT l) a
    JOIN (SELECT relative_path, lf AS fp, row_number() OVER (PARTITION BY lf ORDER BY relative_path) AS nth FROM f WHERE NOT s) b USING (fp, nth))"""


@query(f"""WITH {MOVES_SQL} SELECT f.relative_path, mv.from_path, CASE WHEN l AND s THEN CASE WHEN ls = ss AND lm = sm THEN 'UNCHANGED' ELSE 'MODIFIED' END WHEN l THEN CASE WHEN mv.from_path IS NOT NULL THEN 'MOVED' ELSE 'NEW' END ELSE 'DELETED' END AS action
FROM f LEFT JOIN mv ON mv.to_path = f.relative_path WHERE f.relative_path NOT IN (SELECT from_path FROM mv)""")
def reconcile_actions(spark, d):
    return reconcile.reconcile(listed(spark, d), stored(spark, d))


@query(f"WITH {MOVES_SQL} SELECT from_path, to_path, quick_fingerprint FROM mv")
def reconcile_moves(spark, d):
    new, old = listed(spark, d), stored(spark, d)
    return reconcile.moves(new.join(old.select("relative_path"), "relative_path", "left_anti"), old.join(new.select("relative_path"), "relative_path", "left_anti"))


@query(f"""WITH {SNAPSHOT_SQL} SELECT coalesce(l.relative_path, s.relative_path) AS relative_path, CASE WHEN l.relative_path IS NOT NULL THEN l.size_bytes ELSE s.size_bytes END AS size_bytes,
CASE WHEN l.relative_path IS NOT NULL THEN l.quick_fingerprint ELSE s.quick_fingerprint END AS quick_fingerprint, coalesce(l.thumbnail, s.thumbnail) AS thumbnail FROM listed l FULL JOIN stored s ON l.relative_path = s.relative_path""")
def merge_upsert(spark, d):
    return reconcile.merge(listed(spark, d).drop("modified_at"), stored(spark, d).drop("id", "modified_at"), ["relative_path"], ["size_bytes", "quick_fingerprint"], ["thumbnail"])


@query(f"WITH {SNAPSHOT_SQL} SELECT id, relative_path FROM stored s WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.relative_path = s.relative_path)")
def deleted_paths(spark, d):
    return stored(spark, d).join(listed(spark, d).select("relative_path"), "relative_path", "left_anti").select("id", "relative_path")


@query("SELECT user_id, event_id, rank::INTEGER AS rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 5")
def retention(spark, d):
    return analytics.retention(table(spark, d, "events"), 5, [F.desc("ts"), F.desc("event_id")], "user_id").select("user_id", "event_id", "rank")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def retention_global(spark, d):
    return analytics.retention(table(spark, d, "events").select("event_id", "ts"), 50, [F.desc("ts"), F.desc("event_id")])


# Planning

DESTINATIONS = {"en": "English", "fr": "French", "de": "German"}
ROUTES_SQL = FILES_SQL + ", routes AS (SELECT id, name, size_bytes, concat(CASE media_type WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' ELSE 'Other' END, '/', id % 300, '.txt') AS dest_path, CASE media_type WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' ELSE 'Other' END AS destination FROM files)"


def _routes(spark, d):
    named = files(spark, d).withColumn("name", F.concat((F.col("id") % 300).cast("string"), F.lit(".txt")))
    return planning.routed(named, DESTINATIONS)


@query(f"WITH {ROUTES_SQL} SELECT destination, count(*) AS n, sum(size_bytes)::BIGINT AS size FROM routes GROUP BY 1")
def route_plan(spark, d):
    return planning.plan_summary(_routes(spark, d))


@query(f"WITH {ROUTES_SQL} SELECT dest_path, count(*) AS n, min(id) AS first_id FROM routes GROUP BY 1 HAVING count(*) > 1")
def route_collisions(spark, d):
    return planning.collisions(_routes(spark, d))


@query(f"""WITH {ROUTES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY dest_path ORDER BY id) AS nth FROM routes)
SELECT id, dest_path, CASE WHEN nth > 1 THEN 'intra_job' WHEN dest_path IN (SELECT dest_path FROM routes WHERE id % 17 = 0) THEN 'disk' END AS conflict FROM n""")
def dry_run(spark, d):
    routes = _routes(spark, d)
    return planning.dry_run(routes, routes.where("id % 17 = 0"), ["id"]).select("id", "dest_path", "conflict")


# Events


@query("""WITH f AS (SELECT *, event_type = 'error' OR value < 20 AS failed FROM events),
r AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS nth FROM r WHERE failed)
SELECT user_id, event_id, ts FROM n WHERE nth = 2""")
def offline_debounce(spark, d):
    failed = (F.col("event_type") == "error") | (F.col("value") < 20)
    return analytics.consecutive_failures(table(spark, d, "events"), "user_id", ["ts", "event_id"], failed).select("user_id", "event_id", "ts")


@query("""WITH w AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, min(epoch_us(ts) / 1e6) OVER k AS lo, count(*) OVER k AS in_window FROM events WINDOW k AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1999 PRECEDING AND CURRENT ROW))
SELECT event_id, in_window, round(t - lo, 3) AS seconds FROM w""")
def rolling_rate(spark, d):
    return streams.rolling_rate(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("event_id", "in_window", "seconds")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n, count(*) >= 4 AS burst FROM s GROUP BY user_id, k""")
def session_bursts(spark, d):
    found = streams.sessions(table(spark, d, "events"), "user_id", "6 hours", burst=4)
    return found.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n", "burst")


@query("SELECT event_type, count(*) AS n, floor(count(*) / (SELECT count(*) FROM events) * 1000 + 0.5) / 10 AS percentage FROM events GROUP BY 1")
def activity_kinds(spark, d):
    kinds = analytics.histogram(table(spark, d, "events"), "event_type")
    total = kinds.agg(F.sum("n").alias("total"))
    return kinds.join(F.broadcast(total), F.lit(True)).select("event_type", "n", percentage(F.col("n"), F.col("total")).alias("percentage"))


SCANS_SQL = "s AS (SELECT user_id, ts AS began_at, ts + INTERVAL 6 HOUR AS ended_at FROM events WHERE event_type = 'signup'), c AS (SELECT user_id, event_id, ts FROM events WHERE event_type <> 'signup')"


def _scans(spark, d):
    events = table(spark, d, "events")
    scans = events.where("event_type = 'signup'").select("user_id", F.col("ts").alias("began_at"), (F.col("ts") + F.expr("interval 6 hours")).alias("ended_at"))
    return events.where("event_type <> 'signup'").select("user_id", "event_id", "ts"), scans


@query(f"WITH {SCANS_SQL} SELECT user_id, began_at, ended_at AS due_at, count(*) AS n FROM c JOIN s USING (user_id) WHERE ts >= began_at AND ts < ended_at GROUP BY ALL")
def scan_catch_ups(spark, d):
    return streams.catch_ups(*_scans(spark, d), "user_id")


@query(f"WITH {SCANS_SQL} SELECT event_id FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = c.user_id AND c.ts >= began_at AND c.ts < ended_at)")
def changes_at_once(spark, d):
    return streams.at_once(*_scans(spark, d), "user_id").select("event_id")
