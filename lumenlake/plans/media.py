"""Queries over media files: what scans and users know of them, search, collections, plans, jobs and formats; each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlake.functions.exprs import live
from lumenlake.operators import analytics, collections, dedupe, jobs, planning, reconcile, related, search
from lumenlake.plans.registry import query
from lumenlake.sources.adapters import MEDIA_SQL, PLACES_SQL, day, media, places, table

WITH = f"WITH {MEDIA_SQL}"

# Duplicates

PREFER = {
    "oldest": "coalesce(date_taken, date_created, modified_at) ASC NULLS LAST",
    "newest": "coalesce(modified_at, date_created) DESC NULLS LAST",
    "highest_res": "coalesce(width, 0) * coalesce(height, 0) DESC",
    "shortest_path": "len(string_split(relative_path, '/'))",
}

for preset in dedupe.KEEP:

    def keeper(spark, d, preset=preset):
        return dedupe.keep_one(media(spark, d), preset).select("content_hash", "id", "keep_id", "keep", "n")

    keeper.__name__ = f"dup_keep_{preset}"
    query(f"""{WITH}, r AS (SELECT content_hash, id, count(*) OVER (PARTITION BY content_hash) AS n, first_value(id) OVER (PARTITION BY content_hash ORDER BY {PREFER[preset]}, id) AS keep_id FROM media)
SELECT content_hash, id, keep_id, id = keep_id AS keep, n FROM r WHERE n > 1""")(keeper)


@query(f"""{WITH}, l AS (SELECT * FROM media WHERE last_scan_action IS DISTINCT FROM 'DELETED'), g AS (SELECT content_hash, max(size_bytes) AS group_size, count(*) AS n FROM l GROUP BY 1 HAVING count(*) > 1)
SELECT content_hash, group_size, n, id, relative_path, name, media_type, size_bytes FROM l JOIN g USING (content_hash)""")
def dup_grouped(spark, d):
    found = dedupe.grouped(media(spark, d), live(F.col("last_scan_action")))
    return found.select("content_hash", "group_size", "n", "id", "relative_path", "name", "media_type", "size_bytes")


INDEXED_SQL = "indexed AS (SELECT doc_id AS id, replace('/nas/' || source || '/' || lang || '/' || CASE WHEN doc_id % 3 = 0 THEN 'deep/er/' ELSE '' END || doc_id, '/', chr(92)) AS path, n_chars + 1 AS indexed_size FROM documents WHERE doc_id % 5 <> 0)"


def _indexed(spark, d):
    """Another table of the same files, with backslashes."""
    k = F.col("doc_id")
    path = F.concat(F.lit("/nas/"), "source", F.lit("/"), "lang", F.lit("/"), F.when(k % 3 == 0, "deep/er/").otherwise(""), k.cast("string"))
    return table(spark, d, "documents").where(k % 5 != 0).select(F.translate(path, "/", "\\").alias("path"), (F.col("n_chars") + 1).alias("indexed_size"))


def _full_path():
    return F.concat(F.lit("/nas/"), "relative_path")


@query(f"{WITH}, {INDEXED_SQL} SELECT m.id, m.size_bytes, i.indexed_size FROM media m JOIN indexed i ON replace(i.path, chr(92), '/') = replace('/nas/' || m.relative_path, chr(92), '/')")
def path_join(spark, d):
    return related.by_path(media(spark, d), _indexed(spark, d), _full_path(), F.col("path")).select("id", "size_bytes", "indexed_size")


@query(f"""{WITH}, {INDEXED_SQL} SELECT id, CASE WHEN replace('/nas/' || relative_path, chr(92), '/') IN (SELECT replace(path, chr(92), '/') FROM indexed WHERE id % 2 = 1) THEN 'RECYCLED' ELSE last_scan_action END AS last_scan_action FROM media""")
def recycle_paths(spark, d):
    odd = _indexed(spark, d).where(F.regexp_extract("path", r"([0-9]+)$", 1).cast("long") % 2 == 1)
    return reconcile.set_where_path(media(spark, d), odd, _full_path(), "last_scan_action", F.lit("RECYCLED")).select("id", "last_scan_action")


TWO_TABLES_SQL = r"""i AS (SELECT doc_id AS file_id, replace('/nas/' || source || '/' || lang || '/' || CASE WHEN doc_id % 3 = 0 THEN 'deep/er/' ELSE '' END || doc_id, '/', chr(92)) AS path, n_chars AS size_bytes, CASE WHEN doc_id % 4 <> 1 THEN sha256(concat(text, doc_id % 2)) END AS content_hash FROM documents WHERE doc_id % 5 <> 0
    UNION ALL SELECT -1 - doc_id, '/nas/' || source || '/' || lang || '/' || CASE WHEN doc_id % 3 = 0 THEN 'deep/er/' ELSE '' END || doc_id, n_chars + 1, CASE WHEN doc_id % 4 <> 1 THEN sha256(concat(text, doc_id % 2)) END FROM documents WHERE doc_id % 6 = 1),
m AS (SELECT id, replace('/nas/' || relative_path, chr(92), '/') AS path, CASE WHEN id % 17 <> 0 THEN quick_fingerprint ELSE '' END AS quick_fingerprint, width, height, date_taken, date_created, camera_make, camera_model FROM media),
ij AS (SELECT i.*, replace(i.path, chr(92), '/') AS at FROM i), j AS (SELECT ij.*, m.* EXCLUDE (path) FROM ij JOIN m ON m.path = ij.at),
alike AS (SELECT quick_fingerprint, count(DISTINCT id) AS n, count(DISTINCT content_hash) AS hashes, sum(size_bytes)::BIGINT AS total, floor((count(DISTINCT id) - 1) * (sum(size_bytes) / count(DISTINCT id)) + 0.5)::BIGINT AS mean_wasted FROM j
    WHERE quick_fingerprint IS NOT NULL AND quick_fingerprint <> '' GROUP BY 1 HAVING count(DISTINCT id) > 1 AND NOT (count(DISTINCT content_hash) = 1 AND min(content_hash) IS NOT NULL))"""


def _two_tables(spark, d):
    """Indexed files, some of them twice with either slashes, and media with fingerprints, some of them empty; both with full paths."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents")
    path = F.concat(F.lit("/nas/"), "source", F.lit("/"), "lang", F.lit("/"), F.when(k % 3 == 0, "deep/er/").otherwise(""), k.cast("string"))
    content = F.when(k % 4 != 1, F.sha2(F.concat("text", (k % 2).cast("string")), 256)).alias("content_hash")
    once = docs.where(k % 5 != 0).select(k.alias("id"), F.translate(path, "/", "\\").alias("path"), F.col("n_chars").alias("size_bytes"), content)
    again = docs.where(k % 6 == 1).select((-1 - k).alias("id"), path.alias("path"), (F.col("n_chars") + 1).alias("size_bytes"), content)
    known = media(spark, d).withColumn("path", _full_path()).withColumn("quick_fingerprint", F.when(F.col("id") % 17 != 0, F.col("quick_fingerprint")).otherwise(""))
    return once.unionByName(again), known


@query(f"{WITH}, {TWO_TABLES_SQL} SELECT * FROM alike")
def dup_fingerprint_groups(spark, d):
    """Over the join of both tables by path, in which a file that is indexed twice counts once, and its bytes twice."""
    indexed, known = _two_tables(spark, d)
    both = related.by_path(known.select("id", "path", "quick_fingerprint"), indexed.select(F.col("path").alias("other"), "size_bytes", "content_hash"), F.col("path"), F.col("other"))
    return dedupe.fingerprint_groups(both)


@query(f"""{WITH}, {TWO_TABLES_SQL},
exact AS (SELECT content_hash, count(*) AS n, sum(size_bytes) AS total FROM i WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
ranked AS (SELECT * FROM (SELECT 'EXACT' AS kind, 5 AS confidence, content_hash AS group_key, n, floor((n - 1) * (total / n) + 0.5)::BIGINT AS wasted FROM exact
    UNION ALL SELECT 'FINGERPRINT', 4, quick_fingerprint, n, mean_wasted FROM alike) ORDER BY wasted DESC, kind, group_key LIMIT 20),
held AS (SELECT r.*, ij.at AS path, ij.file_id, ij.size_bytes, m.* EXCLUDE (path) FROM ranked r JOIN ij ON r.group_key = ij.content_hash LEFT JOIN m ON m.path = ij.at WHERE kind = 'EXACT'
    UNION ALL SELECT r.*, j.at, j.file_id, j.size_bytes, j.id, j.quick_fingerprint, j.width, j.height, j.date_taken, j.date_created, j.camera_make, j.camera_model FROM ranked r JOIN j ON r.group_key = j.quick_fingerprint WHERE kind = 'FINGERPRINT'),
placed AS (SELECT *, row_number() OVER (PARTITION BY kind, group_key ORDER BY path, file_id, id) AS place FROM held)
SELECT kind, confidence::INTEGER AS confidence, group_key, n, wasted, place::INTEGER AS place, file_id, path, size_bytes, id AS media_id, width, height, date_taken, date_created, camera_make, camera_model FROM placed WHERE place <= 10""")
def dup_report_joined(spark, d):
    return dedupe.report_joined(*_two_tables(spark, d))


# Filters and orders


@query(f"{WITH} SELECT id FROM media WHERE coalesce(date_taken, modified_at) >= TIMESTAMP '2020-07-01' AND coalesce(date_taken, modified_at) <= TIMESTAMP '2021-02-28 23:59:59'")
def date_window(spark, d):
    return media(spark, d).where(search.intent_filter(search.Intent(date_from="2020-07-01", date_to="2021-02-28"))).select("id")


@query(f"{WITH} SELECT id, scanner_version FROM media WHERE coalesce(scanner_version, 0) < 3")
def outdated_files(spark, d):
    return jobs.outdated(media(spark, d), 3).select("id", "scanner_version")


@query(f"""{WITH} SELECT id, media_type FROM media WHERE media_type NOT IN ('audio', 'other') AND relative_path NOT IN (SELECT relative_path FROM media WHERE favorite)""")
def plan_without(spark, d):
    files = media(spark, d)
    return planning.excluded(files, ("audio", "other"), files.where("favorite")).select("id", "media_type")


@query(f"{WITH} SELECT media_type, extension, count(*) AS n FROM media WHERE (media_type = 'photo' OR media_type = 'video' OR extension = 'pdf') AND last_scan_action IS DISTINCT FROM 'DELETED' GROUP BY ALL")
def thumbnail_eligible(spark, d):
    some = media(spark, d).where(analytics.eligible() & live(F.col("last_scan_action")))
    return some.groupBy("media_type", "extension").agg(F.count(F.lit(1)).alias("n"))


SORTS = {"name_asc": "name ASC", "name_desc": "name DESC", "size_asc": "size_bytes ASC", "size_desc": "size_bytes DESC", "modified_asc": "modified_at ASC NULLS LAST", "modified_desc": "modified_at DESC NULLS FIRST", "other": "indexed_at DESC"}


@query(WITH + " " + " UNION ALL ".join(f"SELECT '{k}' AS sort, row_number() OVER (ORDER BY {o}, id) AS place, id FROM media QUALIFY place <= 30" for k, o in SORTS.items()))
def sorted_pages(spark, d):
    """The first page in each order, with its places."""
    out = None
    for sort in SORTS:
        top = media(spark, d).orderBy(*analytics.sort_order(sort)).limit(30).groupBy().agg(F.collect_list("id").alias("ids"))  # a page
        page = top.select(F.lit(sort).alias("sort"), F.posexplode("ids").alias("place", "id")).withColumn("place", (F.col("place") + 1).cast("long"))
        out = page if out is None else out.unionByName(page)
    return out


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name, c_nationkey AS faces FROM customer ORDER BY (CASE WHEN c_custkey % 3 <> 0 THEN c_name END) IS NULL, c_nationkey DESC, c_custkey LIMIT 40")
def people_listed(spark, d):
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"), F.col("c_nationkey").alias("faces"))
    return people.orderBy(*jobs.people_order(F.col("name"), F.col("faces"), F.col("id"))).limit(40)


@query(f"""{WITH}, p AS (SELECT *, CASE media_type WHEN 'photo' THEN 0 WHEN 'video' THEN 1 WHEN 'document' THEN 2 WHEN 'audio' THEN 3 ELSE 4 END AS r,
    CASE media_type WHEN 'photo' THEN 0 WHEN 'document' THEN 1 WHEN 'audio' THEN 2 WHEN 'video' THEN 3 ELSE 4 END AS q FROM media)
SELECT id, (q * 1000000000000 + least(size_bytes, 999999999999))::BIGINT AS queue_score FROM p ORDER BY r, modified_at DESC NULLS LAST, relative_path LIMIT 60""")
def index_first(spark, d):
    extension = F.col("extension")
    first = media(spark, d).orderBy(*jobs.index_order(extension, F.col("modified_at"), F.col("relative_path"))).limit(60)
    return first.select("id", jobs.queue_score(extension, F.col("size_bytes")).alias("queue_score"))


FOLDER_SQL = """parts AS (SELECT string_split(relative_path, '/') AS p, size_bytes FROM media WHERE starts_with(relative_path, 'src1/')),
listing AS (SELECT p[2] AS name, count(DISTINCT p[3]) > 0 AS is_folder, sum(size_bytes)::BIGINT AS size, nullif(count(DISTINCT p[3]), 0) AS children FROM parts GROUP BY 1)"""


@query(f"{WITH}, {FOLDER_SQL} SELECT name, is_folder, size, children FROM listing")
def folder_sizes(spark, d):
    return analytics.folder_sizes(media(spark, d), "src1")


@query(f"""{WITH}, parts AS (SELECT string_split(relative_path, '/') AS p, size_bytes FROM media), listing AS (SELECT p[1] || '/' || p[2] AS name, p[2] = 'en' AS is_folder FROM parts)
SELECT DISTINCT name, is_folder FROM listing ORDER BY is_folder DESC, name LIMIT 12""")
def folders_first(spark, d):
    parts = F.split("relative_path", "/")
    listing = media(spark, d).select(F.concat(parts[0], F.lit("/"), parts[1]).alias("name"), (parts[1] == "en").alias("is_folder")).distinct()
    return listing.orderBy(*jobs.folders_first(F.col("is_folder"), F.col("name"))).limit(12)


@query(f"{WITH} SELECT id, media_type FROM media WHERE last_scan_action = 'MODIFIED' AND last_scanned_at >= TIMESTAMP '2024-03-11' ORDER BY modified_at DESC NULLS LAST, id LIMIT 100")
def job_files(spark, d):
    return jobs.touched(media(spark, d), "modified", F.lit("2024-03-11").cast("timestamp_ntz")).select("id", "media_type")


@query("SELECT doc_id AS id, left(text, 6000) AS head, length(text)::INTEGER AS n FROM documents")
def text_heads(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.left("text", F.lit(6_000)).alias("head"), F.length("text").alias("n"))


# People and messages


@query(f"""{WITH} SELECT id FROM media WHERE last_scan_action IS DISTINCT FROM 'DELETED' AND id <> 4 AND people IS NOT NULL AND EXISTS (SELECT 1 FROM unnest(people) AS t(p) WHERE lower(p) IN ('bob', 'zoe'))
ORDER BY date_taken DESC NULLS LAST, id LIMIT 24""")
def people_shared(spark, d):
    return related.with_people(media(spark, d).where(live(F.col("last_scan_action"))), ["Bob", "zoe"], but=4).limit(24).select("id")


@query("""WITH f AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 <> 0 THEN vec_id % 40 END AS person_id FROM embeddings), p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name FROM customer WHERE c_custkey % 5 <> 0)
SELECT f.id, person_id, p.name AS person_name FROM f LEFT JOIN p ON p.id = person_id""")
def face_names(spark, d):
    faces = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 7 != 0, F.col("vec_id") % 40).alias("person_id"))
    people = table(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"))
    return related.named_faces(faces, people).select("id", "person_id", "person_name")


@query("""WITH h AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1 HAVING count(*) > 2)
SELECT conv_id, h.turns, turn, role, sha256(text) AS digest, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations JOIN h USING (conv_id)""")
def chat_messages(spark, d):
    messages = table(spark, d, "conversations")
    headers = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns")).where("turns > 2")
    return related.ordered_messages(headers, messages, "conv_id", "turn").select("conv_id", "turns", "turn", "role", F.sha2("text", 256).alias("digest"), F.col("nth").cast("long").alias("nth"))


# Search

QUERY_VECTOR = [round(((i * 37) % 11 - 5) / 10, 1) for i in range(64)]
INTENT = search.Intent(keywords=("invoice", "lorem", "src1"), objects=("dog", "tree"), exclude=("indoor",), location="Zurich", doc_types=("receipt", ""), media_types=("image", "document"), date_from="2020-01-01", semantic_query="a receipt")
LOWERED = "list_transform(coalesce({c}, []), lambda x: lower(x))"
HAS = "len(list_filter({c}, lambda x: contains(x, '{w}'))) > 0"


def _keyword_sql(k: str) -> tuple[str, str]:
    nm, nt, oc = f"contains(lower(name), '{k}')", f"contains(coalesce(lower(notes), ''), '{k}')", f"contains(lower(ocr_text), '{k}')"
    return f"CASE WHEN {nm} THEN 1.0 WHEN {nt} THEN 1.0 WHEN {oc} THEN 0.9 WHEN contains(hay, '{k}') THEN 0.4 ELSE 0 END", f"""CASE WHEN {nm} THEN 'Name contains "{k}"' WHEN {nt} THEN 'Your note mentions "{k}"' WHEN {oc} THEN 'Text mentions "{k}"' END"""


def _object_sql(o: str, shown: str) -> tuple[str, str]:
    seen = f"({HAS.format(c='ob', w=o)} OR {HAS.format(c='tg', w=o)})"
    return f"CASE WHEN {seen} THEN 1.5 WHEN contains(hay, '{o}') THEN 0.7 ELSE 0 END", f"""CASE WHEN {seen} THEN '{shown} detected' WHEN contains(hay, '{o}') THEN 'Mentions "{o}"' END"""


_TERMS = [
    ("greatest(0, coalesce(sim, 0)) * 3", "CASE WHEN sim >= 0.45 THEN 'Strong content match' WHEN sim >= 0.30 THEN 'Related content' END"),
    _object_sql("dog", "Dog"),
    _object_sql("tree", "Tree"),
    *map(_keyword_sql, ("invoice", "lorem", "src1")),
    ("CASE WHEN contains(coalesce(lower(place_name), ''), 'zurich') THEN 1.5 WHEN contains(hay, 'zurich') THEN 1.0 WHEN lat IS NOT NULL THEN 0.1 ELSE 0 END", "CASE WHEN contains(coalesce(lower(place_name), ''), 'zurich') THEN 'Taken in ' || place_name WHEN contains(hay, 'zurich') THEN 'Location matches Zurich' WHEN lat IS NOT NULL THEN 'Has GPS data' END"),
    ("0", "CASE WHEN date_taken IS NOT NULL THEN 'Taken ' || strftime(date_taken, '%b %Y') END"),
    ("CASE WHEN doc_type IN ('receipt', '') THEN 1.5 ELSE 0 END", "CASE WHEN doc_type IN ('receipt', '') THEN 'Classified as ' || doc_type END"),
]


@query(f"""{WITH}, cand AS (SELECT m.*, round(list_cosine_similarity(embedding::DOUBLE[], {QUERY_VECTOR}::DOUBLE[]), 6) AS sim FROM media m LEFT JOIN embeddings e ON e.vec_id = m.id
    WHERE last_scan_action IS DISTINCT FROM 'DELETED' AND media_type IN ('image', 'photo', 'document') AND coalesce(date_taken, modified_at) >= TIMESTAMP '2020-01-01' AND doc_type IN ('receipt', '') ORDER BY sim DESC NULLS LAST, id LIMIT 240),
a AS (SELECT *, {LOWERED.format(c='hidden_tags')} AS hd, {LOWERED.format(c='objects')} AS ob, {LOWERED.format(c='people')} AS pp FROM cand),
b AS (SELECT *, list_concat(list_filter({LOWERED.format(c='tags')}, lambda t: NOT list_contains(hd, t)), {LOWERED.format(c='user_tags')}) AS tg FROM a),
h AS (SELECT *, lower(array_to_string(list_filter(list_concat([name, relative_path, coalesce(user_description, description), notes, ocr_text, doc_type, scene, place_name], list_concat(tg, list_concat(ob, pp))), lambda x: x IS NOT NULL AND x <> ''), ' ')) AS hay FROM b),
s AS (SELECT id, sim, {' + '.join(f'({p})::DOUBLE' for p, _ in _TERMS)} AS raw, [{', '.join(r for _, r in _TERMS)}] AS why FROM h WHERE NOT contains(hay, 'indoor'))
SELECT id, floor(raw * 100 + 0.5) / 100 AS score, CASE WHEN raw >= 2.2 THEN 'very_likely' WHEN raw >= 1.1 THEN 'likely' ELSE 'possible' END AS confidence,
    array_to_string(list_slice(list_filter(why, lambda x: x IS NOT NULL), 1, 5), '; ') AS reasons
FROM s WHERE raw > 0.05 AND NOT (coalesce(sim, 1) < 0.15 AND raw < 1) ORDER BY score DESC, sim DESC NULLS LAST, id LIMIT 60""")
def hybrid_scored(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    rows = search.candidates(media(spark, d), v, QUERY_VECTOR, live(F.col("last_scan_action")) & search.intent_filter(INTENT), 60)
    return search.scored(rows, INTENT).select("id", "score", "confidence", "reasons")


@query(f"""{WITH}, t AS (SELECT id, array_to_string(list_filter([name, replace(regexp_extract(relative_path, '^(.*)/[^/]*$', 1), '/', ' '), description, array_to_string(tags, ' '), array_to_string(objects, ' '), array_to_string(people, ' '), scene, doc_type,
    left(ocr_text, 2000), camera_make, camera_model, strftime(date_taken, '%Y-%m-%d'), user_description, array_to_string(user_tags, ' '), left(notes, 2000)], lambda x: x IS NOT NULL AND x <> ''), chr(10)) AS body FROM media)
SELECT id, length(body)::INTEGER AS n, sha256(body) AS digest FROM t""")
def embedding_text(spark, d):
    body = search.media_embedding_text()
    return media(spark, d).select("id", F.length(body).alias("n"), F.sha2(body, 256).alias("digest"))


@query(f"""{WITH}, q AS (SELECT embedding::DOUBLE[] AS qv, media_type AS qt, content_hash AS qh FROM embeddings JOIN media ON vec_id = id WHERE id = 3),
s AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], qv), 6) AS sim FROM embeddings JOIN media ON vec_id = id, q
    WHERE vec_id <> 3 AND media_type = qt AND content_hash <> qh AND last_scan_action IS DISTINCT FROM 'DELETED' ORDER BY sim DESC, id LIMIT 24)
SELECT id, sim, floor(sim * 100 + 0.5) / 100 AS score, CASE WHEN sim >= 0.6 THEN 'very_likely' WHEN sim >= 0.45 THEN 'likely' ELSE 'possible' END AS confidence, floor(sim * 100 + 0.5)::BIGINT || '% similar content' AS reason FROM s""")
def knn_similar(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return search.similar(media(spark, d), v, 3, 24, live(F.col("last_scan_action")))


# Collections

RULE = collections.SmartRule(media_types=("document", "photo"), extensions=(".PDF", "jpg", "odt"), name_contains="a", date_from="2019-09-01", date_to="2021-06-01", min_size=300, max_size=20_000)
BEST = "coalesce(date_taken, date_created, modified_at)"
RULE_SQL = f"media_type IN ('document', 'photo') AND lower(extension) IN ('pdf', 'jpg', 'odt') AND name ILIKE '%a%' AND {BEST} >= TIMESTAMP '2019-09-01' AND {BEST} <= TIMESTAMP '2021-06-01' AND size_bytes >= 300 AND size_bytes <= 20000"


@query(f"{WITH} SELECT id, size_bytes FROM media WHERE {RULE_SQL}")
def smart_rule(spark, d):
    return media(spark, d).where(RULE.predicate(collections.best_date())).select("id", "size_bytes")


@query(f"{WITH} SELECT 'papers' AS collection, count(*) AS items, max(id) AS cover_id FROM media WHERE {RULE_SQL} UNION ALL SELECT 'liked', count(*), max(id) FROM media WHERE favorite UNION ALL SELECT 'all', count(*), max(id) FROM media")
def smart_counts(spark, d):
    return collections.smart_counts(media(spark, d), {"papers": RULE, "liked": collections.SmartRule(favorites_only=True), "all": collections.SmartRule()})


CELL_SQL = "floor({x} * 10 + 0.5)::INTEGER"
CELLS_SQL = f"{PLACES_SQL}, cells AS (SELECT lat10, lon10, min(n_name) AS name FROM (SELECT DISTINCT {CELL_SQL.format(x='lat')} AS lat10, {CELL_SQL.format(x='lon')} AS lon10, n_name FROM places JOIN nation ON c_nationkey = n_nationkey) WHERE (lat10 + lon10) % 3 <> 0 GROUP BY ALL)"
AUTO_SQL = f"""{MEDIA_SQL}, {CELLS_SQL}, placed AS (SELECT m.*, {CELL_SQL.format(x='lat')} AS a, {CELL_SQL.format(x='lon')} AS o, {BEST} AS best FROM media m),
docs AS (SELECT id, CASE WHEN regexp_matches(lower(name), 'receipt|invoice|rechnung|quittung|bill\\b|billing') THEN 'receipts' WHEN regexp_matches(lower(name), 'manual|handbook|handbuch|guide|instructions|anleitung') THEN 'manuals' WHEN regexp_matches(lower(name), 'statement|bank|tax|steuer|w-?2|1099') THEN 'finance'
    WHEN extension = 'pdf' THEN 'pdf' WHEN extension IN ('xls', 'xlsx', 'csv', 'ods', 'numbers') THEN 'spreadsheets' WHEN extension IN ('ppt', 'pptx', 'key', 'odp') THEN 'presentations' ELSE 'other' END AS c FROM media WHERE media_type = 'document'),
keyed AS (SELECT id, 'event:' || strftime(best, '%Y-%m') AS auto_key, strftime(best, '%B %Y') AS name, 'Photos & videos from ' || strftime(best, '%B %Y') AS description FROM placed WHERE media_type IN ('photo', 'video') AND best IS NOT NULL
    UNION ALL SELECT id, concat('place:', regexp_replace((a / 10)::DECIMAL(9, 1)::VARCHAR, '[.]0$', ''), ',', regexp_replace((o / 10)::DECIMAL(9, 1)::VARCHAR, '[.]0$', '')),
        coalesce(c.name, concat('Around ', (abs(a) / 10)::DECIMAL(9, 1)::VARCHAR, '°', CASE WHEN a >= 0 THEN 'N' ELSE 'S' END, ', ', (abs(o) / 10)::DECIMAL(9, 1)::VARCHAR, '°', CASE WHEN o >= 0 THEN 'E' ELSE 'W' END)),
        coalesce('Media taken in and around ' || c.name, 'Media taken near this location') FROM placed LEFT JOIN cells c ON c.lat10 = a AND c.lon10 = o WHERE lat IS NOT NULL AND lon IS NOT NULL
    UNION ALL SELECT id, 'doc:' || c, CASE c WHEN 'receipts' THEN 'Receipts & Invoices' WHEN 'manuals' THEN 'Manuals & Guides' WHEN 'finance' THEN 'Financial Documents' WHEN 'pdf' THEN 'PDFs' WHEN 'spreadsheets' THEN 'Spreadsheets' WHEN 'presentations' THEN 'Presentations' ELSE 'Other Documents' END,
        CASE c WHEN 'receipts' THEN 'Documents that look like receipts, invoices, or bills' WHEN 'manuals' THEN 'Instruction manuals, handbooks, and guides' WHEN 'finance' THEN 'Statements, tax, and banking documents' WHEN 'pdf' THEN 'All PDF documents' WHEN 'spreadsheets' THEN 'Spreadsheets and tabular data' WHEN 'presentations' THEN 'Slide decks and presentations' ELSE 'Text files, notes, and other documents' END FROM docs),
groups AS (SELECT auto_key, min(name) AS name, min(description) AS description, count(*) AS n, max(id) AS cover_id FROM keyed GROUP BY 1 HAVING count(*) >= CASE WHEN auto_key LIKE 'doc:%' THEN 1 ELSE 3 END)"""


def _keyed(spark, d):
    spots = places(spark, d).select(collections.geo_cell(F.col("lat")).alias("lat10"), collections.geo_cell(F.col("lon")).alias("lon10"), "c_nationkey").distinct()
    named = spots.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cells = named.where((F.col("lat10") + F.col("lon10")) % 3 != 0).groupBy("lat10", "lon10").agg(F.min("n_name").alias("name"))
    return collections.keyed_items(media(spark, d), cells)


def _existing(spark, g):
    """Collections that an earlier run left: some of the present groups, some renamed, removed, or with covers of their own; and one whose group is gone."""
    n = F.col("n")
    name = F.when(n % 2 == 0, "Around there").otherwise("Mine")
    cover = F.when(n % 7 != 0, F.col("cover_id") - F.when(n % 3 == 0, 1).otherwise(0))
    gone = spark.createDataFrame([("event:1900-01", "Old", False, 1)], "auto_key string, name string, removed boolean, cover_id long")
    return g.where("n % 4 <> 0").select("auto_key", name.alias("name"), (n % 5 == 0).alias("removed"), cover.alias("cover_id")).unionByName(gone)


@query(f"WITH {AUTO_SQL} SELECT auto_key, name, description, n, cover_id FROM groups")
def auto_groups(spark, d):
    return collections.auto_groups(_keyed(spark, d))


EXISTING_SQL = "e AS (SELECT auto_key, CASE WHEN n % 2 = 0 THEN 'Around there' ELSE 'Mine' END AS name, n % 5 = 0 AS removed, CASE WHEN n % 7 <> 0 THEN cover_id - CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END END AS cover_id FROM groups WHERE n % 4 <> 0 UNION ALL SELECT 'event:1900-01', 'Old', false, 1)"


@query(f"""WITH {AUTO_SQL}, {EXISTING_SQL}, v AS (SELECT e.* REPLACE (CASE WHEN EXISTS (SELECT 1 FROM keyed k WHERE k.auto_key = e.auto_key AND k.id = e.cover_id) THEN e.cover_id END AS cover_id) FROM e),
b AS (SELECT auto_key, e.name AS old_name, g.name AS new_name, coalesce(e.cover_id, g.cover_id) AS cover_id,
    CASE WHEN e.removed THEN 'skip' WHEN e.auto_key IS NULL THEN 'create' WHEN g.auto_key IS NULL THEN 'delete' WHEN starts_with(e.name, 'Around ') AND e.name <> g.name THEN 'rename' ELSE 'keep' END AS action FROM v e FULL JOIN groups g USING (auto_key))
SELECT auto_key, action, CASE WHEN action IN ('create', 'rename') THEN new_name ELSE old_name END AS name, cover_id FROM b""")
def collection_diff(spark, d):
    keyed = _keyed(spark, d)
    g = collections.auto_groups(keyed)
    return collections.difference(_existing(spark, g), g, keyed)


@query(f"WITH {AUTO_SQL}, {EXISTING_SQL} SELECT DISTINCT k.auto_key, k.id FROM keyed k JOIN groups g USING (auto_key) WHERE k.auto_key NOT IN (SELECT auto_key FROM e WHERE removed)")
def rebuilt_members(spark, d):
    keyed = _keyed(spark, d)
    g = collections.auto_groups(keyed)
    return collections.rebuilt_members(keyed, g, _existing(spark, g))


# Snapshots with rows from before fingerprints

LEGACY_SQL = """s AS (SELECT doc_id AS id, source || '/' || doc_id AS relative_path, n_chars AS size_bytes, CASE WHEN doc_id % 3 <> 0 THEN sha256(concat('f', text)) END AS quick_fingerprint, sha256(text) AS content_hash,
    TIMESTAMP '2024-01-01' + to_days((doc_id % 50)::INTEGER) AS modified_at FROM documents WHERE doc_id % 7 <> 0),
l AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'moved/' || doc_id ELSE source || '/' || doc_id END AS relative_path, n_chars AS size_bytes, sha256(concat('f', text)) AS quick_fingerprint, sha256(text) AS content_hash,
    TIMESTAMP '2024-01-01' + to_days((doc_id % 50 + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END)::INTEGER) AS modified_at FROM documents WHERE doc_id % 11 <> 0),
n AS (SELECT * FROM l WHERE relative_path NOT IN (SELECT relative_path FROM s)), o AS (SELECT * FROM s WHERE relative_path NOT IN (SELECT relative_path FROM l)),
m1 AS (SELECT a.relative_path AS from_path, b.relative_path AS to_path FROM (SELECT *, row_number() OVER (PARTITION BY quick_fingerprint ORDER BY relative_path) AS nth FROM o WHERE quick_fingerprint IS NOT NULL) a
    JOIN (SELECT *, row_number() OVER (PARTITION BY quick_fingerprint ORDER BY relative_path) AS nth FROM n) b USING (quick_fingerprint, nth)),
g AS (SELECT * FROM o WHERE quick_fingerprint IS NULL), r AS (SELECT * FROM n WHERE relative_path NOT IN (SELECT to_path FROM m1) AND size_bytes IN (SELECT size_bytes FROM g)),
m AS (SELECT * FROM m1 UNION ALL SELECT a.relative_path, b.relative_path FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY relative_path) AS nth FROM g) a
    JOIN (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY relative_path) AS nth FROM r) b USING (content_hash, nth))"""


@query(f"""WITH {LEGACY_SQL} SELECT coalesce(l.relative_path, s.relative_path) AS relative_path, m.from_path,
    CASE WHEN l.relative_path IS NULL THEN 'DELETED' WHEN s.relative_path IS NOT NULL THEN CASE WHEN l.size_bytes = s.size_bytes AND l.modified_at = s.modified_at THEN 'UNCHANGED' ELSE 'MODIFIED' END WHEN m.from_path IS NOT NULL THEN 'MOVED' ELSE 'NEW' END AS action
FROM l FULL JOIN s ON l.relative_path = s.relative_path LEFT JOIN m ON m.to_path = l.relative_path WHERE l.relative_path IS NOT NULL OR s.relative_path NOT IN (SELECT from_path FROM m)""")
def reconcile_legacy(spark, d):
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    home, finger, full = F.concat("source", F.lit("/"), k.cast("string")), F.sha2(F.concat(F.lit("f"), "text"), 256), F.sha2("text", 256)
    stored = docs.where(k % 7 != 0).select(home.alias("relative_path"), F.col("n_chars").alias("size_bytes"), F.when(k % 3 != 0, finger).alias("quick_fingerprint"), full.alias("content_hash"), day(k % 50, "2024-01-01").alias("modified_at"))
    path = F.when(k % 4 == 0, F.concat(F.lit("moved/"), k.cast("string"))).otherwise(home)
    listed = docs.where(k % 11 != 0).select(path.alias("relative_path"), F.col("n_chars").alias("size_bytes"), finger.alias("quick_fingerprint"), full.alias("content_hash"), day(k % 50 + F.when(k % 9 == 0, 1).otherwise(0), "2024-01-01").alias("modified_at"))
    return reconcile.reconcile(listed, stored, full_hash="content_hash")


# Formats

EXTENSIONS = "jpg jpeg png webp heic avif tiff bmp gif raw cr2 dng psd mp4 mov avi mkv webm m4v wmv flv ts mpg m2ts mxf mp3 wav pdf doc docx zip".split()
_PICK = "list_extract([" + ", ".join(f"'{e}'" for e in EXTENSIONS) + f"], (doc_id % {len(EXTENSIONS)} + 1)::INTEGER)"


def _format_sql(jpg: str, png: str, raw: str) -> str:
    """Status, category, target and ratio of each extension; jpg, png and raw depend on the profile."""
    return f"""WITH k AS (SELECT doc_id AS id, {_PICK} AS extension, n_chars AS size_bytes FROM documents),
r AS (SELECT DISTINCT extension, CASE WHEN extension IN ('jpg', 'jpeg') THEN {jpg} WHEN extension = 'png' THEN {png} WHEN extension IN ('raw', 'cr2', 'dng') THEN {raw} WHEN extension = 'psd' THEN ['protected', 'image', NULL, '0'] WHEN extension IN ('mov', 'mxf') THEN ['protected', 'video', NULL, '0']
    WHEN extension IN ('webp', 'heic', 'avif') THEN ['optimal', 'image', NULL, '0'] WHEN extension IN ('mp4', 'webm', 'm4v') THEN ['optimal', 'video', NULL, '0'] WHEN extension = 'mp3' THEN ['optimal', 'audio', NULL, '0'] WHEN extension IN ('pdf', 'docx') THEN ['optimal', 'document', NULL, '0']
    WHEN extension = 'wav' THEN ['skip', 'audio', NULL, '0'] WHEN extension = 'doc' THEN ['skip', 'document', NULL, '0'] WHEN extension = 'bmp' THEN ['convert', 'image', 'png', '0.70'] WHEN extension = 'tiff' THEN ['convert', 'image', 'png', '0.55'] WHEN extension = 'gif' THEN ['convert', 'image', 'png', '0.25']
    WHEN extension = 'avi' THEN ['convert', 'video', 'mp4', '0.62'] WHEN extension = 'wmv' THEN ['convert', 'video', 'mp4', '0.65'] WHEN extension = 'flv' THEN ['convert', 'video', 'mp4', '0.60'] WHEN extension = 'mpg' THEN ['convert', 'video', 'mp4', '0.72'] WHEN extension = 'm2ts' THEN ['convert', 'video', 'mp4', '0.55']
    WHEN extension = 'ts' THEN ['convert', 'video', 'mp4', '0.52'] WHEN extension = 'mkv' THEN ['convert', 'video', 'mp4', '0.40'] ELSE ['skip', 'other', NULL, '0'] END AS r FROM k),
t AS (SELECT extension, string_agg(id::VARCHAR, ',' ORDER BY n) AS samples, list(size_bytes ORDER BY n) AS sizes FROM (SELECT extension, id, size_bytes, row_number() OVER (PARTITION BY extension ORDER BY size_bytes DESC, id) AS n FROM k) WHERE n <= 3 GROUP BY 1),
sums AS (SELECT extension, any_value(r[2]) AS category, any_value(r[1]) AS status, any_value(r[3]) AS target, count(*) AS n, sum(size_bytes)::BIGINT AS size, floor(sum(size_bytes)::DOUBLE * any_value(r[4])::DOUBLE + 0.5)::BIGINT AS saving, any_value(samples) AS samples, array_to_string(list_transform(any_value(sizes), lambda x: floor(x * (1 - coalesce(any_value(r[4])::DOUBLE, 0)) + 0.5)::BIGINT), ',') AS samples_after, NULL::VARCHAR AS codec FROM k JOIN r USING (extension) JOIN t USING (extension) GROUP BY extension)"""


RANKED = "SELECT *, CASE status WHEN 'convert' THEN 0 WHEN 'protected' THEN 1 WHEN 'optimal' THEN 2 ELSE 3 END::INTEGER AS status_rank FROM sums"
PROFILE_SQL = {
    "ARCHIVE": _format_sql("['protected', 'image', 'jpg', '0']", "['convert', 'image', 'png', '0.15']", "['protected', 'image', NULL, '0']"),
    "BALANCED": _format_sql("['convert', 'image', 'jpg', '0.18']", "['convert', 'image', 'png', '0.15']", "['convert', 'image', 'jpg', '0.80']"),
    "MAXIMUM": _format_sql("['convert', 'image', 'webp', '0.27']", "['convert', 'image', 'webp', '0.30']", "['protected', 'image', NULL, '0']"),
}


def _by_format(spark, d, profile):
    k = F.col("doc_id")
    named = F.get(F.array(*[F.lit(e) for e in EXTENSIONS]), (k % len(EXTENSIONS)).cast("int"))
    rows = table(spark, d, "documents").select(k.alias("id"), named.alias("extension"), F.col("n_chars").alias("size_bytes"))
    return planning.savings(rows, planning.rules(spark, profile, raw=profile == "BALANCED"))


for profile in PROFILE_SQL:

    def saver(spark, d, profile=profile):
        return _by_format(spark, d, profile)

    saver.__name__ = f"ext_savings_{profile.lower()}"
    query(f"{PROFILE_SQL[profile]} {RANKED}")(saver)


CODEC_SQL = "list_extract([NULL, 'mjpeg', 'prores', 'h264', 'weird'], (id % 5 + 1)::INTEGER)"


@query(f"""{PROFILE_SQL['BALANCED']}, c AS (SELECT extension, arg_min(codec, rank) AS codec FROM (SELECT extension, {CODEC_SQL} AS codec, row_number() OVER (ORDER BY size_bytes DESC, id) AS rank FROM k) WHERE codec IS NOT NULL AND extension IN ('mov', 'mkv', 'mp4', 'm4v') GROUP BY 1),
o AS (SELECT sums.* EXCLUDE (codec, samples_after, saving), c.codec, CASE WHEN c.codec = 'mjpeg' THEN 0.68 ELSE r[4]::DOUBLE END AS ratio, sizes, saving FROM sums LEFT JOIN c USING (extension) JOIN r USING (extension) JOIN t USING (extension))
SELECT extension, category, CASE codec WHEN 'mjpeg' THEN 'convert' WHEN 'prores' THEN 'protected' WHEN 'h264' THEN 'optimal' ELSE status END AS status, CASE WHEN codec = 'mjpeg' THEN 'mp4' ELSE target END AS target, n, size,
    CASE WHEN codec = 'mjpeg' THEN floor(size * 0.68::DOUBLE + 0.5)::BIGINT ELSE saving END AS saving, samples, array_to_string(list_transform(sizes, lambda x: floor(x * (1 - coalesce(ratio, 0)) + 0.5)::BIGINT), ',') AS samples_after, codec,
    CASE CASE codec WHEN 'mjpeg' THEN 'convert' WHEN 'prores' THEN 'protected' WHEN 'h264' THEN 'optimal' ELSE status END WHEN 'convert' THEN 0 WHEN 'protected' THEN 1 WHEN 'optimal' THEN 2 ELSE 3 END::INTEGER AS status_rank FROM o""")
def ext_savings_detected(spark, d):
    """Containers by the codec of their largest file."""
    k = F.col("doc_id")
    pick = lambda *values: F.get(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int"))
    rows = table(spark, d, "documents").select(k.alias("id"), pick(*EXTENSIONS).alias("extension"), F.col("n_chars").alias("size_bytes"), pick(None, "mjpeg", "prores", "h264", "weird").alias("video"))
    return planning.savings(rows, planning.rules(spark, "BALANCED", raw=True), codec="video")


@query(f"{PROFILE_SQL['MAXIMUM']} SELECT coalesce(sum(n), 0)::BIGINT AS files, coalesce(sum(size), 0)::BIGINT AS size, coalesce(sum(CASE WHEN status = 'convert' THEN saving ELSE 0 END), 0)::BIGINT AS saving FROM sums")
def total_savings(spark, d):
    return planning.total_savings(_by_format(spark, d, "MAXIMUM"))


CODECS = "prores dnxhd v210 h264 hevc vp8 mjpeg wmv1 svq3 cinepak ffv1".split()


@query(f"""WITH k AS (SELECT doc_id AS id, list_extract([{', '.join(f"'{c}'" for c in CODECS)}], (doc_id % {len(CODECS)} + 1)::INTEGER) AS codec, doc_id % 3 = 0 AS progressive, doc_id % 200 AS exif, list_extract(['4:2:0', '4:2:2', '4:4:4', NULL], (doc_id % 4 + 1)::INTEGER) AS chroma, n_chars AS size FROM documents)
SELECT id, CASE WHEN codec IN ('prores', 'dnxhd', 'v210') THEN 'protected' WHEN codec IN ('h264', 'hevc', 'vp8') THEN 'optimal' WHEN codec IN ('mjpeg', 'wmv1', 'svq3', 'cinepak') THEN 'convert' ELSE 'skip' END AS status, CASE WHEN codec IN ('mjpeg', 'wmv1', 'svq3', 'cinepak') THEN 0.68::DOUBLE END AS ratio,
    array_to_string(list_filter([CASE WHEN NOT progressive THEN 'progressive encoding disabled' END, CASE WHEN size > 0 AND exif / size > 0.05 THEN 'excessive metadata overhead (EXIF > 5% of file size)' END, CASE WHEN chroma NOT IN ('4:2:0', '4:2:2') THEN 'suboptimal chroma subsampling (' || chroma || ')' END], lambda x: x IS NOT NULL), ';') AS issues FROM k""")
def codecs_and_issues(spark, d):
    k = F.col("doc_id")
    pick = lambda *values: F.get(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int"))
    status, ratio = planning.codec_override(pick(*CODECS), F.lit("skip"))
    issues = planning.jpeg_issues(k % 3 == 0, k % 200, F.col("n_chars"), pick("4:2:0", "4:2:2", "4:4:4", None))
    return table(spark, d, "documents").select(k.alias("id"), status.alias("status"), ratio.alias("ratio"), F.array_join(issues, ";").alias("issues"))
