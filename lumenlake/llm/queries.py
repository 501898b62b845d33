"""The corpus operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.llm import alignment, decontaminate, knn, langid, licenses, mixing, neardup, packing, pii, ppm, secrets, spelling, urlrules
from lumenlake.llm.common import joined_spans, remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digests(spans, base_kinds: tuple[str, ...]) -> list:  # noqa: ANN001
    base = F.filter(spans, lambda s: s["kind"].isin(*base_kinds))

    def number(kind: str):  # noqa: ANN202
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return [*map(number, base_kinds), F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(spans).alias("spans")]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect_pii(_table(spark, sf_dir, "documents"), ["doc_id"])
    scores = F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",").alias("scores")
    return found.select("doc_id", *_digests(F.col("pii"), pii.BASE_KINDS), scores)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    known = langid.learn(docs, remainder("doc_id", 5) != 0)
    keyed = docs.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text")
    return langid.identify(keyed, known, ["doc_id", "held_out"])


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"), ["doc_id"])
    spans = secrets.span_order(F.concat("base", "linked"), secrets.BASE_KINDS + secrets.WEAK_KINDS)
    ordered = found.select("doc_id", spans.alias("found"))
    return ordered.select("doc_id", *_digests(F.col("found"), secrets.BASE_KINDS))


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    counts = ppm.learn(docs, remainder("doc_id", 7) != 2)
    keyed = docs.select("doc_id", F.coalesce(remainder("doc_id", 7) == 2, F.lit(False)).alias("held_out"), "text")
    return ppm.score_texts(keyed, counts, ["doc_id", "held_out"])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return urlrules.judge(pages, urlrules.mine_rules(urlrules.label_by_rules(pages)), ["page_id"])


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"), ["doc_id"])


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op9_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = mixing.quality_weights(_table(spark, sf_dir, "labels"))
    return mixing.mix(_table(spark, sf_dir, "documents"), ["doc_id"], quality=quality)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), ["doc_id"], public_tokenizers.path("word_bpe_49k.json"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align_texts(_table(spark, sf_dir, "documents"), ["doc_id"], a, b)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii, op2_langid, op3_secrets, op4_ppm, op5_decontaminate, op6_urls, op7_licenses, op8_neardup, op9_knn, op10_mixing, op11_packing, op12_spelling, op13_alignment)}

_WORDS = r"SELECT {id}, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM {table} WHERE text IS NOT NULL"

SQL: dict[str, str] = {
    "op5_decontaminate": f"""
WITH dw AS ({_WORDS.format(id="doc_id", table="documents")}), bw AS ({_WORDS.format(id="item_id", table="benchmark")}),
k AS (SELECT 5 AS k UNION SELECT DISTINCT len(w) FROM bw WHERE len(w) BETWEEN 1 AND 4),
d AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM dw JOIN k ON len(w) >= k)),
b AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM (SELECT item_id, w, least(len(w), 5) AS n, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM bw WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY item_id),
c AS (SELECT d.doc_id, b.item_id, count(*) AS shared FROM d JOIN b USING (s) GROUP BY ALL)
SELECT doc_id, item_id, shared, item_shingles, round(shared / item_shingles, 6) AS containment
FROM c JOIN n USING (item_id) WHERE shared >= ceil(item_shingles * 0.8 - 1e-9)""",
    "op8_neardup": """
WITH RECURSIVE t AS (SELECT doc_id, text, row_number() OVER () AS row_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
u AS (SELECT text, any_value(w) AS w, count(*) AS copies, min(row_id) AS rep FROM t WHERE len(w) > 0 GROUP BY text),
s AS (SELECT DISTINCT rep, array_to_string(list_slice(w, i, i + 4), ' ') AS s, len(w) < 5 AS short FROM (SELECT rep, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM u)),
n AS (SELECT rep, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.rep AS a, b.rep AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.short = b.short AND a.rep <> b.rep GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE common >= 0.8 * (x.n + y.n - common) - 1e-9),
walk(node, hop) AS (SELECT DISTINCT a, a FROM e UNION SELECT node, b FROM walk JOIN e ON hop = a),
comp AS (SELECT node, min(hop) AS comp FROM walk GROUP BY 1),
l AS (SELECT a AS rep, sum(copies)::BIGINT AS links FROM e JOIN u ON u.rep = b GROUP BY 1),
r AS (SELECT t.doc_id, coalesce(comp.comp, u.rep, t.row_id) AS comp, coalesce(links, 0) + coalesce(copies, 1) - 1 AS n_links FROM t LEFT JOIN u ON t.text = u.text AND len(t.w) > 0 LEFT JOIN comp ON node = u.rep LEFT JOIN l ON l.rep = u.rep)
SELECT doc_id, min(doc_id) OVER (PARTITION BY comp) AS class_id, n_links FROM r""",
    "op9_knn": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(list_zip(q.v, e.v), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
}
