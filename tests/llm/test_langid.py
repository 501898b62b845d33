"""Cross-parsing against its definition, and held-out accuracy."""

from __future__ import annotations

import random
import re

import numpy as np
from conftest import MIDDLE
from lumenlake.llm import langid, queries
from pyspark.sql import functions as F


def phrases_by_definition(symbols: list[int], sample: bytes) -> int:
    """Boundaries between phrases: each is the longest string from its start that occurs in the sample."""
    text, at, n = bytes(symbols), 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at += size
        n += 1
    return n


def test_phrases_equal_the_definition():
    rng = random.Random(3)
    for _ in range(60):
        sample = bytes(rng.choices(range(4), k=rng.randint(1, 60)))
        text = rng.choices(range(5), k=rng.randint(1, 50))
        steps = langid.automaton(np.frombuffer(sample, np.uint8), 6)
        block = np.array(text, np.uint8)[:, None]
        assert int(langid.phrases(block, steps)[0][0]) + 1 == phrases_by_definition(text, sample)


def predict_by_definition(text: str | None, sample: dict[str, str]) -> tuple[str, float]:
    """The language whose phrases cost least, the smaller name among equals, and the score."""
    norm = lambda t: re.sub(rb"[^a-z\xc3-\xf4\x80-\xbf]+", b" ", (t or "").lower().encode())
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    rates = []
    for name, known in sorted(sample.items()):
        own = norm(known)[: langid.SAMPLE_BYTES]
        raw = norm(text)
        symbols = [b if b in own else 255 for b in raw]
        unseen = symbols.count(255)
        bits = np.log2(max(len(own), langid.LEAST_SAMPLE))
        rates.append((((phrases_by_definition(symbols, own) - unseen) * bits + unseen * langid.UNSEEN_BITS) / len(raw), name))
    best, n = min(rates), len(norm(text))
    return best[1], 1 / sum(np.exp(-langid.SHARPNESS * n / (n + langid.SHORT_TEXT) * (r - best[0])) for r, _ in rates)


def test_predictions_equal_the_definition(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 16)
    monkeypatch.setattr(langid, "WARM", 4)
    rng = random.Random(5)
    sample = {"aa": "the cat sat on the mat and the dog ran", "bb": "der hund lief zum haus", "cc": "the cat sat on the mat and the dog ran", "dd": "ab", "ру": "кошка сидела на ковре", "zz": "aaaaaaa"}
    words = " ".join(sample.values()).split()
    texts = [None, "", "12 34", "ab", "q", "a" * 300, "ab" * 90, "кошка", "𝒶𝒷𝒸 日本語", *(" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(120))]
    langs, scores = langid.Parser(sample).predict(texts)
    for text, lang, score in zip(texts, langs, scores):
        wanted = predict_by_definition(text, sample)
        assert lang == wanted[0] and abs(score - wanted[1]) < 1e-9, text
    assert "cc" not in langs  # equal to aa, the smaller name


def test_small_samples_gain_nothing_by_what_they_lack(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    sample = langid.learn_sample(docs, F.lit(True))
    texts = [r["text"] for r in docs.where("lang = 'en' and length(text) > 200").limit(50).collect()]
    assert set(langid.Parser(sample).predict(texts)[0]) == {"en"}
    for tiny in ("ab", "qz", "qqq", texts[0][:120]):
        assert set(langid.Parser(sample | {"xx": tiny}).predict(texts[1:])[0]) == {"en"}


def test_scripts_and_letters_beyond_the_basic_plane():
    sample = {"zh": "我们今天去图书馆看书然后回家吃饭" * 9, "ja": "私たちは今日図書館へ行って本を読みます" * 9, "ko": "우리는 오늘 도서관에 가서 책을 읽습니다" * 9, "ru": "сегодня мы идём в библиотеку" * 9, "el": "σήμερα πάμε στη βιβλιοθήκη" * 9, "got": "𐌰𐍄𐍄𐌰 𐌿𐌽𐍃𐌰𐍂 𐌸𐌿 𐌹𐌽 𐌷𐌹𐌼𐌹𐌽𐌰𐌼" * 9}
    texts = ["图书馆看书", "図書館へ行って", "도서관에 가서", "в библиотеку", "στη βιβλιοθήκη", "𐌸𐌿 𐌹𐌽"]
    assert langid.Parser(sample).predict(texts)[0] == list(sample)


SAMPLE = {"aa": "the cat sat on the mat and the dog ran to the house " * 5, "bb": "der hund lief zum haus und die katze sass auf dem teppich " * 5}


def test_languages_and_empty_texts(spark):
    long = "und die katze lief zum haus " * 40_000
    rows = [(1, "the dog sat on the mat", "bb"), (2, "die katze und der hund", "aa"), (3, None, None), (4, "", "x"), (5, "12345 !!", "x"), (6, long, None), (None, "the cat", "q"), (1, "the dog sat on the mat", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    found = sorted(((r["doc_id"] or 0, r["lang_pred"], 0 <= r["score"] <= 1) for r in langid.identify(docs, SAMPLE, ["doc_id"]).collect()))
    assert found == [(0, "aa", True), (1, "aa", True), (1, "aa", True), (2, "bb", True), (3, "und", True), (4, "und", True), (5, "und", True), (6, "bb", True)]
    assert {r["lang_pred"] for r in langid.identify(docs, {}, ["doc_id"]).collect()} == {"und"}
    kept = langid.keep_identified(docs, SAMPLE)
    assert kept.schema == docs.schema and kept.count() == 5
    assert langid.identify(docs.limit(0), SAMPLE, ["doc_id"]).count() == 0


def test_the_sample_is_bounded_and_takes_no_null_rows(spark):
    rows = [(i, "wort " * 300, "de" if i % 3 else None) for i in range(1_000)] + [(None, "text", "fr"), (5_000, None, "it"), (5_001, "", "it"), (5_002, "lungo testo " * 9_000, "la")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.learn_sample(docs, F.lit(True))
    assert set(sample) == {"de", "la"} and len(sample["de"]) <= langid.SAMPLE_CHARS + langid.SAMPLE_ROWS and len(sample["la"]) == langid.ROW_CHARS
    assert langid.learn_sample(docs.limit(0), F.lit(True)) == {}


GREEK = "Η γλώσσα είναι ένα σύστημα επικοινωνίας που χρησιμοποιούν οι άνθρωποι για να μιλούν μεταξύ τους. " * 4


def test_languages_that_are_not_learned_go(spark):
    """Two of four languages, or one, are learned: long texts of the others go, texts of these stay, and the score says so."""
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text", "lang")
    texts = {k: [r["text"] for r in docs.where((F.col("lang") == k) & (F.length("text") > 600)).collect()] for k in ("en", "de", "es", "fr")}
    for learned in (("en", "de"), ("de",)):
        known = langid.learn(docs, F.col("lang").isin(*learned))
        parser = langid.Parser(known)
        for name, some in texts.items():
            langs, scores, fits = parser.judge(some)
            share = sum(fits) / len(fits)
            assert share > 0.98 if name in learned else share < 0.1, (learned, name, share)
            assert all(a in learned for a in langs)
            assert np.median(scores) > 0.9 if name in learned else np.median(scores) < 0.5
        assert parser.judge([GREEK, "日本語の文章です" * 30])[2] == [False, False]
        greek = spark.createDataFrame([(1, GREEK), (2, texts["de"][0]), (3, None), (4, "..")], "doc_id long, text string")
        assert [r["doc_id"] for r in langid.keep_identified(greek, known).collect()] == [2]


def test_scores_of_short_texts_and_ties():
    known = langid.Known({"aa": SAMPLE["aa"], "bb": SAMPLE["bb"], "cc": SAMPLE["bb"]}, {})
    langs, scores = langid.Parser(known).predict(["x", "th", "the cat sat on the mat", "der hund lief zum haus"])
    assert scores[0] < 0.5 and scores[0] < scores[2] and scores[1] < scores[2] > 0.9
    assert langs[3] == "bb" and scores[3] <= 0.5  # as likely another name


def test_held_out_accuracy(spark):
    found = queries.op2_langid(spark, MIDDLE)
    assert found.count() == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    truth = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang")
    held = found.join(truth, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    right, n = held.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert n > 50 and right / n >= 0.95
