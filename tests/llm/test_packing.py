"""Packing against the definition: every id once, gapless sequences, little padding."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenlake.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for t in texts]


def verify(rows, docs, capacity=packing.CAPACITY):
    """Pieces of (doc_id, text) rows with distinct ids: each id in one piece, and sequences without gaps."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for (doc, _), ids in zip(docs, plain([t for _, t in docs]), strict=True):
        at = 0
        for r in sorted(by_doc.pop(doc), key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part))
            at += r["length"]
        assert at == len(ids)
    assert not by_doc
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return len(by_sequence)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = packing.pack(docs.repartition(7), ["doc_id"], PATH).collect()
    n = verify(rows, [tuple(r) for r in docs.collect()])
    total = sum(r["length"] for r in rows)
    assert n * packing.CAPACITY - total < max(packing.CAPACITY, 0.02 * total)


def test_full_sequences_of_classes(spark):
    """Many documents of few lengths: sequences of k pieces of one class, filled across tasks."""
    words = {4: 900, 5: 700, 13: 400, 1366: 40, 9_000: 5}
    docs = [(i, "a " * (n - 1)) for i, n in enumerate(n for n, times in words.items() for _ in range(times))]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(9), ["doc_id"], PATH, capacity=64).collect()
    n = verify(rows, docs, 64)
    assert n * 64 - sum(r["length"] for r in rows) < 0.03 * 64 * n + 64


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \t\n "), (4, "x" * 30_000), (5, "a<|endoftext|>b <|startoftext|> c"), (6, "É é \x1c\x85 don't 's ＡΣ Σ"), (7, "word " * 5_000), (8, "\U0001f600   z"), (9, "the" + "\x0b" + "end")]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), ["doc_id"], PATH).collect()
    verify(rows, docs)


def test_repeated_rows_nulls_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x")] * 3 + [(None, "a b", 6, "y")], "doc_id long, text string, length int, sequence_id string")
    rows = packing.pack(docs, ["doc_id", "length"], PATH).collect()
    assert [r["doc_id"] for r in rows].count(1) == 3 and sum(r["length"] for r in rows) == 4 * len(plain(["a b"])[0])
    assert sorted(r["offset"] for r in rows) == [0, 3, 6, 9]
    assert packing.pack(docs.limit(0), ["doc_id"], PATH).collect() == []


@given(st.integers(1, 20_000))
def test_lengths(total):
    found = packing.lengths_of(total)
    assert sum(n for n, _ in found) == total and len(found) <= total // packing.CAPACITY + 5
    for n, k in found:
        assert k == packing.CAPACITY // n
        assert packing.CAPACITY - k * n <= packing.CAPACITY * packing.SLACK + k or k >= 1 / packing.SLACK


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(packing, "WORDS_KEPT", 3)
    encoder = packing.WordEncoder(PATH)
    texts = ["a bb ccc", "y" * 100 + " a", "dd ee ff", "a ccc " + "y" * 100, "bb dd"]
    for t, ids in zip(texts, plain(texts), strict=True):
        assert encoder([t.encode()])[0].tolist() == ids[:-1]


@pytest.mark.parametrize("text", ["abc def", "a  b", "The, END.) <|ENDOFTEXT|> it's,'s é, E\u0301, e\u0301; 12,3 x.y 'll.'re ß; Ǆa,b", "a.\u0338b ,.a;;b|c ａ,b"])
def test_a_task_encodes_as_the_whole(text):
    assert packing.WordEncoder(PATH)([text.encode()])[0].tolist() == plain([text])[0][:-1]
