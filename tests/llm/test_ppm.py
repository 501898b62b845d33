"""Prediction by partial matching against its definition, and the base score against counts."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from lumenlake.llm import ppm
from pyspark.sql import functions as F


def lowered(text: str | None) -> bytes:
    return (text or "").encode().lower()


def model(texts: list[bytes], order: int = ppm.ORDER) -> dict[bytes, Counter]:
    """Followers of every context of up to order bytes."""
    out: dict[bytes, Counter] = defaultdict(Counter)
    for t in texts:
        whole = bytes([ppm.START]) * order + t + bytes([ppm.END])
        for i in range(order, len(whole)):
            for k in range(order + 1):
                out[whole[i - k : i]][whole[i]] += 1
    return out


def log_probability(text: bytes, found: dict[bytes, Counter], order: int = ppm.ORDER) -> float:
    whole, bits = bytes([ppm.START]) * order + text + bytes([ppm.END]), 0.0
    for i in range(order, len(whole)):
        gone: set[int] = set()
        for k in range(order, -1, -1):
            followers = {s: n for s, n in found.get(whole[i - k : i], {}).items() if s not in gone}
            total, kinds = sum(followers.values()), len(followers)
            if whole[i] in followers:
                bits += math.log10(followers[whole[i]] / (total + kinds))
                break
            if kinds:
                bits += math.log10(kinds / (total + kinds))
                gone |= set(followers)
        else:
            bits -= math.log10(max(1, 256 - len(found.get(b"", ()))))
    return bits


def random_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    words = ["the", "cat", "sat", "on", "Mat", "é", "日本", "x1", "THE", "and", "\t", "\n", "  ", "zebra", "q"]
    return [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(n)]


def tokens(text: str | None) -> list[bytes]:
    return [*lowered(text).split(), b""]


def test_scores_equal_the_definition(spark):
    texts = [*random_texts(120, 1), None, "", "unseen Ωmega ψ", "the cat " * 50_000]
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(None, "the cat", "b"), (0, texts[0], "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    train = [t for i, t in enumerate(texts[:100]) if i % 3]
    counts = ppm.learn(docs, (F.col("doc_id") < 100) & (F.col("doc_id") % 3 != 0))
    found = ppm.score_texts(docs, counts, ["doc_id"]).collect()
    assert len(found) == len(rows)
    trained, base = model([lowered(t) for t in train]), Counter(x for t in train for x in tokens(t))
    n, v = base.total(), len(base)
    for r in found:
        text = texts[r["doc_id"]] if r["doc_id"] is not None else "the cat"
        own = tokens(text)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(base[x] > 0 for x in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((base[x] + 1) / (n + v + 1)) for x in own), rel=1e-9)
        assert r["score"] == pytest.approx(log_probability(lowered(text), trained), rel=1e-9)


def test_scores_equal_the_definition_beyond_the_head(spark, monkeypatch):
    monkeypatch.setattr(ppm, "NODES", 400)
    monkeypatch.setattr(ppm, "HEAD", 2)
    monkeypatch.setattr(ppm, "ASKED", 100)
    texts = random_texts(200, 6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = ppm.learn(docs, F.col("doc_id") % 3 != 0)
    strings = counts.where("kind = 'string'").count()
    assert 0 < len(ppm._head(counts)[0]) // 8 < strings / 2
    trained = model([lowered(t) for i, t in enumerate(texts) if i % 3])
    found = ppm.score_texts(docs, counts, ["doc_id"]).collect()
    assert len(found) == len(texts)
    for r in found:
        assert r["score"] == pytest.approx(log_probability(lowered(texts[r["doc_id"]]), trained), rel=1e-9)


@pytest.mark.parametrize("nodes", [1 << 21, 40])
def test_probabilities_add_up_to_one(nodes, spark, monkeypatch):
    monkeypatch.setattr(ppm, "NODES", nodes)
    docs = spark.createDataFrame(list(enumerate(random_texts(60, 2))), "doc_id long, text string")
    trie = ppm.build_trie(ppm._levels(ppm.learn(docs, F.lit(True))))
    for context in (b"the c", b"\xfe\xfe\xfe\xfe\xfe", b"zzzzz", b" the ", b"\xfe\xfethe", b"at sa"):
        head = int.from_bytes(context, "big") << 8
        total = (10.0 ** trie.score(np.array([head | s for s in range(256)], np.uint64))).sum()
        assert total == pytest.approx(1, abs=1e-5)


def test_rare_tokens_meet_their_counts_in_a_join(spark, monkeypatch):
    monkeypatch.setattr(ppm, "HEAD", 2)
    docs = spark.createDataFrame([(1, "a a a b"), (2, "a c"), (3, None)], "doc_id long, text string")
    found = {r["doc_id"]: r["base_score"] for r in ppm.score_texts(docs, ppm.learn(docs, F.lit(True)), ["doc_id"]).collect()}
    base = Counter({b"a": 4, b"b": 1, b"c": 1, b"": 3})
    for i, t in ((1, "a a a b"), (2, "a c"), (3, None)):
        assert found[i] == pytest.approx(sum(math.log10((base[x] + 1) / (9 + 4 + 1)) for x in tokens(t)))


def test_empty_tables_and_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    nothing = ppm.learn(docs, F.lit(False))
    row = ppm.score_texts(docs, nothing, ["doc_id"]).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)
    assert row["score"] == pytest.approx(-10 * math.log10(256))
    assert ppm.score_texts(docs.limit(0), nothing, ["doc_id"]).count() == 0


def test_a_better_model_scores_kindred_text_higher(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat and slept") for i in range(20)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "xq zvkw jjp qqx wwz mmk")], "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in ppm.score_texts(asked, ppm.learn(docs, F.lit(True)), ["doc_id"]).collect()}
    assert found[1] > found[2] + 10
