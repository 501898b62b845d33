"""The library model over the Parquet tables at hand; each view only projects columns that exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions.exprs import fingerprint, media_type

FILES_SQL = """files AS (
    SELECT doc_id AS id, concat(source, '/', lang, '/', doc_id, '.txt') AS relative_path, concat(doc_id, '.txt') AS name,
        lang AS media_type, source, n_chars AS size_bytes, text AS ocr_text, sha256(text) AS content_hash,
        sha256(concat(n_chars, left(text, 65536), CASE WHEN length(text) > 65536 THEN right(text, 65536) ELSE '' END)) AS quick_fingerprint
    FROM documents)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(n: Column, first: str) -> Column:
    """The n-th day after the first, at midnight."""
    return F.lit(first).cast("timestamp_ntz") + F.make_dt_interval(n)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a file table."""
    d = table(spark, sf_dir, "documents")
    doc = F.col("doc_id").cast("string")
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat("source", F.lit("/"), "lang", F.lit("/"), doc, F.lit(".txt")).alias("relative_path"),
        F.concat(doc, F.lit(".txt")).alias("name"),
        F.col("lang").alias("media_type"),
        "source",
        F.col("n_chars").alias("size_bytes"),
        F.col("text").alias("ocr_text"),
        F.sha2("text", 256).alias("content_hash"),
        fingerprint(F.col("n_chars"), F.col("text")).alias("quick_fingerprint"),
    )


SNAPSHOT_SQL = """stored AS (
    SELECT doc_id AS id, concat(source, '/', doc_id, '.txt') AS relative_path, n_chars AS size_bytes, sha256(concat(n_chars, left(text, 65536), CASE WHEN length(text) > 65536 THEN right(text, 65536) ELSE '' END)) AS quick_fingerprint,
        CASE WHEN doc_id % 10 = 0 THEN 'thumb-' || doc_id END AS thumbnail, TIMESTAMP '2024-01-01' + to_days((doc_id % 300)::INTEGER) AS modified_at
    FROM documents WHERE doc_id % 7 <> 0),
listed AS (
    SELECT CASE WHEN doc_id % 13 = 0 THEN concat('moved/', doc_id, '.txt') ELSE concat(source, '/', doc_id, '.txt') END AS relative_path,
        n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS size_bytes,
        sha256(concat(n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END, left(text, 65536), CASE WHEN length(text) > 65536 THEN right(text, 65536) ELSE '' END)) AS quick_fingerprint, NULL::VARCHAR AS thumbnail,
        TIMESTAMP '2024-01-01' + to_days((doc_id % 300 + CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END)::INTEGER) AS modified_at
    FROM documents WHERE doc_id % 11 <> 0)"""


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier snapshot: six documents of seven."""
    d = table(spark, sf_dir, "documents").where("doc_id % 7 <> 0")
    thumb = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("thumb-"), F.col("doc_id").cast("string")))
    return d.select(F.col("doc_id").alias("id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("relative_path"), F.col("n_chars").alias("size_bytes"), fingerprint(F.col("n_chars"), F.col("text")).alias("quick_fingerprint"), thumb.alias("thumbnail"), day(F.col("doc_id") % 300, "2024-01-01").alias("modified_at"))


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later listing: some documents gone, some edited, some moved."""
    d = table(spark, sf_dir, "documents").where("doc_id % 11 <> 0")
    doc, size = F.col("doc_id").cast("string"), F.col("n_chars") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    path = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("moved/"), doc, F.lit(".txt"))).otherwise(F.concat("source", F.lit("/"), doc, F.lit(".txt")))
    return d.select(path.alias("relative_path"), size.alias("size_bytes"), fingerprint(size, F.col("text")).alias("quick_fingerprint"), F.lit(None).cast("string").alias("thumbnail"), day(F.col("doc_id") % 300 + F.when(F.col("doc_id") % 17 == 0, 1).otherwise(0), "2024-01-01").alias("modified_at"))


PLACES_SQL = """places AS (
    SELECT c_custkey AS id, c_nationkey, c_mktsegment AS name, (c_custkey % 180) * 0.37 - 30 AS lat, (c_custkey % 360) * 0.53 - 90 AS lon FROM customer)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as places: latitude and longitude follow from the key, exactly, in decimals."""
    key = F.col("c_custkey")
    at = lambda mod, step, shift: ((key % mod).cast("decimal(10,0)") * F.lit(step).cast("decimal(3,2)") - F.lit(shift).cast("decimal(3,0)"))
    return table(spark, sf_dir, "customer").select(key.alias("id"), "c_nationkey", F.col("c_mktsegment").alias("name"), at(180, "0.37", 30).alias("lat"), at(360, "0.53", 90).alias("lon"))


MEDIA_SQL = """media AS (
    SELECT doc_id AS id, n_chars AS size_bytes, text AS ocr_text, sha256(text) AS content_hash,
        list_extract(['invoice', 'Manual', 'bank', 'trip', 'Billing', 'notes', 'Tax', 'beach'], (doc_id % 8 + 1)::INTEGER) || '-' || doc_id || '.' || list_extract(['jpg', 'mts', 'pdf', 'xlsx', 'key', 'mp3', 'bin', 'cr3', 'odt', 'png', 'mov'], (doc_id % 11 + 1)::INTEGER) AS name,
        list_extract(['jpg', 'mts', 'pdf', 'xlsx', 'key', 'mp3', 'bin', 'cr3', 'odt', 'png', 'mov'], (doc_id % 11 + 1)::INTEGER) AS extension,
        list_extract(['photo', 'video', 'document', 'document', 'document', 'audio', 'other', 'photo', 'document', 'photo', 'video'], (doc_id % 11 + 1)::INTEGER) AS media_type,
        source || '/' || lang || '/' || CASE WHEN doc_id % 3 = 0 THEN 'deep/er/' ELSE '' END || doc_id AS relative_path, source AS folder,
        CASE WHEN doc_id % 9 <> 0 THEN TIMESTAMP '2020-01-01' + to_days((doc_id * 53 % 1500)::INTEGER) END AS modified_at,
        CASE WHEN doc_id % 6 <> 0 THEN TIMESTAMP '2020-01-01' + to_days((doc_id * 37 % 900)::INTEGER) END AS date_taken,
        CASE WHEN doc_id % 4 <> 0 THEN TIMESTAMP '2019-06-01' + to_days((doc_id * 41 % 900)::INTEGER) END AS date_created,
        CASE WHEN doc_id % 5 <> 0 THEN (doc_id * 13 % 4000)::INTEGER END AS width, CASE WHEN doc_id % 7 <> 0 THEN (doc_id * 7 % 3000)::INTEGER END AS height,
        list_extract(['Canon', 'NIKON', NULL, ''], (doc_id % 4 + 1)::INTEGER) AS camera_make, CASE WHEN doc_id % 3 = 1 THEN 'EOS ' || doc_id % 7 END AS camera_model, sha256(concat(n_chars, left(text, 65536), CASE WHEN length(text) > 65536 THEN right(text, 65536) ELSE '' END)) AS quick_fingerprint,
        doc_id % 10 = 0 AS favorite, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 180) * 0.37 - 30 END AS lat, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 360) * 0.53 - 90 END AS lon,
        CASE WHEN doc_id % 12 = 0 THEN 'Zurich' WHEN doc_id % 15 = 0 THEN 'Bern' END AS place_name,
        CASE WHEN doc_id % 8 = 0 THEN 'see invoice ' || doc_id END AS notes, CASE WHEN doc_id % 5 <> 1 THEN left(text, 60) END AS description,
        CASE WHEN doc_id % 11 = 0 THEN 'our own beach ' || doc_id END AS user_description, CASE WHEN doc_id % 13 = 0 THEN 'indoor' ELSE '' END AS scene,
        list_extract(['receipt', 'letter', NULL, ''], (doc_id % 4 + 1)::INTEGER) AS doc_type,
        CASE WHEN doc_id % 4 <> 3 THEN [lang, 'Sunset', source] END AS tags, CASE WHEN doc_id % 2 = 0 THEN ['sunset'] END AS hidden_tags,
        CASE WHEN doc_id % 9 = 0 THEN ['Family', 'sunset'] END AS user_tags, CASE WHEN doc_id % 5 < 3 THEN ['Dog', 'tree ' || doc_id % 4] END AS objects,
        CASE WHEN doc_id % 4 = 0 THEN ['Ann', 'bob'] WHEN doc_id % 4 = 1 THEN ['BOB'] WHEN doc_id % 4 = 2 THEN [] END AS people,
        CASE WHEN doc_id % 4 = 0 THEN NULL ELSE (doc_id % 4)::INTEGER END AS scanner_version,
        list_extract(['NEW', 'MODIFIED', 'DELETED', 'UNCHANGED', NULL], (doc_id % 5 + 1)::INTEGER) AS last_scan_action,
        TIMESTAMP '2024-03-01' + to_days((doc_id % 30)::INTEGER) AS last_scanned_at, TIMESTAMP '2024-01-01' + to_days((doc_id * 7 % 365)::INTEGER) AS indexed_at
    FROM documents)"""


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as media files with what scans and users know of them; all but text, source and language follows from the id."""
    k = F.col("doc_id")
    pick = lambda n, *values: F.get(F.array(*[F.lit(v) for v in values]), (k % n).cast("int"))
    texts = lambda *values: F.array(*[F.lit(v) if isinstance(v, str) else v for v in values])
    doc = k.cast("string")
    extension = pick(11, "jpg", "mts", "pdf", "xlsx", "key", "mp3", "bin", "cr3", "odt", "png", "mov")
    coordinate = lambda mod, step, shift: F.when(k % 3 == 0, (k % mod).cast("decimal(10,0)") * F.lit(step).cast("decimal(3,2)") - F.lit(shift).cast("decimal(3,0)"))
    columns = {
        "id": k,
        "size_bytes": F.col("n_chars"),
        "ocr_text": F.col("text"),
        "content_hash": F.sha2("text", 256),
        "name": F.concat(pick(8, "invoice", "Manual", "bank", "trip", "Billing", "notes", "Tax", "beach"), F.lit("-"), doc, F.lit("."), extension),
        "extension": extension,
        "media_type": media_type(extension),
        "relative_path": F.concat("source", F.lit("/"), "lang", F.lit("/"), F.when(k % 3 == 0, "deep/er/").otherwise(""), doc),
        "folder": F.col("source"),
        "modified_at": F.when(k % 9 != 0, day(k * 53 % 1500, "2020-01-01")),
        "date_taken": F.when(k % 6 != 0, day(k * 37 % 900, "2020-01-01")),
        "date_created": F.when(k % 4 != 0, day(k * 41 % 900, "2019-06-01")),
        "width": F.when(k % 5 != 0, (k * 13 % 4000).cast("int")),
        "height": F.when(k % 7 != 0, (k * 7 % 3000).cast("int")),
        "camera_make": pick(4, "Canon", "NIKON", None, ""),
        "camera_model": F.when(k % 3 == 1, F.concat(F.lit("EOS "), (k % 7).cast("string"))),
        "quick_fingerprint": fingerprint(F.col("n_chars"), F.col("text")),
        "favorite": k % 10 == 0,
        "lat": coordinate(180, "0.37", 30),
        "lon": coordinate(360, "0.53", 90),
        "place_name": F.when(k % 12 == 0, "Zurich").when(k % 15 == 0, "Bern"),
        "notes": F.when(k % 8 == 0, F.concat(F.lit("see invoice "), doc)),
        "description": F.when(k % 5 != 1, F.left("text", F.lit(60))),
        "user_description": F.when(k % 11 == 0, F.concat(F.lit("our own beach "), doc)),
        "scene": F.when(k % 13 == 0, "indoor").otherwise(""),
        "doc_type": pick(4, "receipt", "letter", None, ""),
        "tags": F.when(k % 4 != 3, texts(F.col("lang"), "Sunset", F.col("source"))),
        "hidden_tags": F.when(k % 2 == 0, texts("sunset")),
        "user_tags": F.when(k % 9 == 0, texts("Family", "sunset")),
        "objects": F.when(k % 5 < 3, texts("Dog", F.concat(F.lit("tree "), (k % 4).cast("string")))),
        "people": F.when(k % 4 == 0, texts("Ann", "bob")).when(k % 4 == 1, texts("BOB")).when(k % 4 == 2, F.array().cast("array<string>")),
        "scanner_version": F.nullif((k % 4).cast("int"), F.lit(0)),
        "last_scan_action": pick(5, "NEW", "MODIFIED", "DELETED", "UNCHANGED", None),
        "last_scanned_at": day(k % 30, "2024-03-01"),
        "indexed_at": day(k * 7 % 365, "2024-01-01"),
    }
    return table(spark, sf_dir, "documents").select(*[c.alias(n) for n, c in columns.items()])
