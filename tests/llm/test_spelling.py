"""Spelling variants against a definition that compares words by deletions and replacements."""

import re
import string
import zlib
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lumenlake.llm import spelling

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_words(docs):
    total = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if n >= 3 and len(w) >= 5}


def plain_near(words):
    """Words that differ by one edit, from the strings that one deletion or one blank leaves."""
    left, near = {}, {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            left.setdefault(("*", w[:i], w[i + 1 :]), set()).add(w)
            shorter = w[:i] + w[i + 1 :]
            if shorter in near:
                near[w].add(shorter)
                near[shorter].add(w)
    for some in left.values():
        for w in some:
            near[w] |= some - {w}
    return near


def plain(words):
    near, forms = plain_near(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        return w if forms[w] is None else root(forms[w])

    return sorted((w, forms[w] or "", root(w), n, len(near[w]), words[forms[w]] if forms[w] else -1) for w, n in words.items())


def rows(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in df.collect())


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = plain(plain_words([tuple(r) for r in docs.collect()]))
    assert rows(spelling.variants(docs.repartition(5))) == want
    assert sum(r[1] != "" for r in want) > 100


def test_edges(spark):
    long = "q" * 3_000
    texts = [
        "stone stone stone stones stones stones Stone STONE stone stone",
        "aaaaa " * 3 + "aaaaaa " * 6 + "aaaaaaa " * 12 + "aaaaaaaa " * 24,  # a chain, and runs of one letter
        "éclair " * 3 + "Éclair " * 3 + "eclair " * 6 + "÷×÷×÷ " * 3,
        f"{long}a " * 3 + f"{long}b " * 6 + f"{long} " * 2 + f"x{long}a " * 3,
        "bcdef " * 3 + "acdef " * 4 + "abdef " * 5 + "abcef " * 6 + "abcdf " * 7 + "abcdef " * 7,
        "tie-aaabb " * 3 + "ccabb aacbb aabbb " * 9,
        None,
        "",
        "1 2 3 Āā ab'cd",
    ]
    docs = list(enumerate(texts)) + [(None, "stone stonf stonf stonf"), (None, "stone stonf")] * 3
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, word string").repartition(4)
    assert rows(spelling.variants(df)) == plain(plain_words(docs))
    assert spelling.variants(df.limit(0)).collect() == []


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("abé", min_size=5, max_size=9), min_size=1, max_size=120, unique=True))
def test_pairs_of_dense_words(spark, words):
    words = {w: i + 3 for i, w in enumerate(words)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    found = [(r["a"], r["b"]) for r in spelling.near_pairs(table).collect()]
    assert sorted(found) == sorted((a, b) for a, some in plain_near(words).items() for b in some)


def test_few_and_many_nodes_agree(spark, monkeypatch):
    """The same pairs where most nodes count as hot."""
    words = [a + b + c + "end" for a in "abcdef" for b in "abcdef" for c in "abcdef"] * 2
    table = spark.createDataFrame([(w, 3) for w in sorted(set(words))] + [(f"zz{i:03d}".translate(str.maketrans("0123456789", "abcdefghij")), 3) for i in range(1_000)], "word string, n long")
    want = {(r["a"], r["b"]) for r in spelling.near_pairs(table).collect()}
    names = {r["word"]: 3 for r in table.collect()}
    assert want == {(a, b) for a, some in plain_near(names).items() for b in some}
    monkeypatch.setattr("lumenlake.llm.common.BROADCAST_BYTES", 0)
    assert {(r["a"], r["b"]) for r in spelling.near_pairs(table).collect()} == want
