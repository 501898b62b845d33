"""The pipeline's stages against brute force on the smallest tables, and on documents of every kind."""

from __future__ import annotations

import corpus_pipeline
import pytest
from conftest import SMALL
from lumenlake.llm import langid, mixing, pii
from pyspark.sql import functions as F
from test_decontaminate import leaks
from test_neardup import brute


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def by_hand(spark, docs, sf_dir: str) -> tuple[dict, dict]:
    """Texts that reach the mix, by id; and how many rows each stage left."""
    rows = {r["doc_id"]: r for r in docs.collect()}
    parser = langid.Parser(langid.learn(docs, F.lit(True)))
    ids = sorted(rows)
    left = [i for i, fits in zip(ids, parser.judge([rows[i]["text"] for i in ids])[2]) if fits]
    steps = {"language": len(left)}
    classes = {}
    for doc, cls, links in brute([(i, rows[i]["text"]) for i in left]):
        classes.setdefault(cls if links else doc, []).append(doc)
    left = sorted(map(min, classes.values()))
    steps["near"] = len(left)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {x[0] for x in leaks([(i, rows[i]["text"]) for i in left], items)}
    left = [i for i in left if i not in bad]
    steps["leaks"] = len(left)
    return {i: pii.redact(rows[i]["text"]) for i in left}, steps


def test_stages_equal_brute_force(spark, documents):
    wanted, steps = by_hand(spark, documents, SMALL)
    assert steps["language"] > steps["near"] > steps["leaks"] > 0
    docs, out = documents, None
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == documents.columns
        docs = out.cache()
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == wanted
    mixed = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in mixed} <= set(wanted) and all(r["taken"] > 0 and r["text"] == wanted[r["doc_id"]] for r in mixed)
    sizes: dict = {}
    for r in docs.select("source", mixing.words(F.col("text")).alias("n")).collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["n"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    for source, target in zip(order, mixing.targets([sizes[s] for s in order])):
        assert sum(r["taken"] for r in mixed if r["source"] == source) == round(target)


def test_rows_of_any_kind_pass_through(spark, tmp_path):
    prose = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).collect()
    extra = [(None, prose[0]["text"], None, None, None, 1), (7_001, None, "en", "x", 0, 2), (7_002, "", "en", "x", 0, 3), (7_003, prose[1]["text"], prose[1]["lang"], None, 5, 4), (7_003, prose[1]["text"], prose[1]["lang"], None, 5, 4)]
    rows = [(*(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")), 9) for r in prose] + extra
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, taken int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns.count("taken") == 1
    ids = [r["doc_id"] for r in found.collect()]
    assert len(ids) == len(set(ids)) and not {7_001, 7_002, 7_003} & set(ids)


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
