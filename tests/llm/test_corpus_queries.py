"""The corpus queries as registered: whole tables, contract columns, SQL where there is some."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from conftest import MIDDLE, SMALL
from harness import compare, oracle
from lumenlake.llm import queries, secrets
from test_pii import plain as plain_pii
from test_secrets import plain as plain_secrets

import __spark_entry__ as entry_points

COLUMNS = {
    "op1_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op2_langid": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op4_ppm": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op5_decontaminate": ["doc_id", "item_id"],
    "op6_urls": ["page_id", "host", "path", "rule", "verdict"],
    "op7_licenses": ["doc_id", "sentences", "licenses"],
    "op8_neardup": ["doc_id", "class_id", "n_links"],
    "op9_knn": ["query_id", "rank", "vec_id", "score"],
    "op10_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op11_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op12_spelling": ["word", "form", "root", "n", "n_near", "form_n"],
    "op13_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
}
PER_DOCUMENT = ["op1_pii", "op2_langid", "op3_secrets", "op4_ppm", "op7_licenses", "op8_neardup", "op10_mixing", "op13_alignment"]


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def test_all_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry_points.queries())
    assert list(queries.QUERIES) == list(COLUMNS)


@pytest.mark.parametrize("name", sorted(queries.SQL))
@pytest.mark.parametrize("sf_dir", [SMALL, MIDDLE])
def test_equals_sql(spark, name, sf_dir):
    assert compare(spark, oracle(sf_dir), queries.QUERIES[name], queries.SQL[name], sf_dir) is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    assert all(t != "void" for _, t in df.dtypes)


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_a_row_for_each_document(spark, documents, name):
    ids = [r["doc_id"] for r in queries.QUERIES[name](spark, SMALL).select("doc_id").collect()]
    assert sorted(ids) == sorted(documents)


def digest(spans) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def test_personal_data_digests(spark, documents):
    for r in queries.op1_pii(spark, SMALL).collect():
        base = plain_pii(documents[r["doc_id"]]["text"] or "")
        assert r["base_sha256"] == digest(base)
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[0] == k for x in base) for k in ("email", "ip", "card", "phone")]
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r["spans"].split(","))


def test_secret_digests(spark, documents):
    kinds = [*secrets.BASE_KINDS, *secrets.WEAK_KINDS]
    for r in queries.op3_secrets(spark, SMALL).collect():
        base, linked = plain_secrets(documents[r["doc_id"]]["text"])
        order = lambda x: (x[0], kinds.index(x[1]))
        assert r["base_sha256"] == digest([(k, s, e) for s, k, e in sorted(base, key=order)])
        assert r["spans"] == ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(base + linked, key=order))
        assert [r[f"n_{k}"] for k in kinds[:3]] == [sum(x[1] == k for x in base) for k in kinds[:3]]


def test_held_out_rows(spark):
    for name, mod, rest in (("op2_langid", 5, 0), ("op4_ppm", 7, 2)):
        for r in queries.QUERIES[name](spark, SMALL).select("doc_id", "held_out").collect():
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == rest)
