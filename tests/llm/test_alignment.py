"""Alignment of two tokenizers against whole texts encoded at once."""

import hashlib
import json
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from lumenlake.llm import alignment
from tokenizers import Tokenizer

A, B = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def tokens():
    """Ids and bytes of A's and B's tokens of a whole text."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    with open(A) as f:
        alphabet = alignment._byte_alphabet()
        spelled = {i: bytes(alphabet.get(c, 0) for c in t) for t, i in json.load(f)["model"]["vocab"].items()}

    def piece(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    return lambda text: ([(i, spelled[i]) for i in a.encode(" " + text, add_special_tokens=False).ids], [(i, piece(i)) for i in b.encode(text)])


def plain(docs, tokens):
    """doc_id, numbers and digest by the definition."""
    links, found = {}, {}
    for at, (doc, text) in enumerate(docs):
        pair = tokens(text) if text else ([], [])
        if not text or any(b"".join(t for _, t in x) != (" " + text).encode() for x in pair):
            found[at] = (doc, 0, 0, 0, "")
            links[at] = Counter()
            continue
        ends = []
        for side in pair:
            n, own = 0, []
            for _, t in side:
                n += len(t)
                own.append(n)
            ends.append(own)
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, before, own = [], 0, Counter()
        for stop in common:
            part = [[i for (i, _), e in zip(side, e_, strict=True) if before < e <= stop] for side, e_ in zip(pair, ends, strict=True)]
            own.update((x, y) for x in part[0] for y in part[1])
            groups.append("|".join(",".join(map(str, x)) for x in part))
            before = stop
        links[at] = own
        found[at] = (doc, len(pair[0]), len(pair[1]), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest())
    count, best = Counter(p for own in links.values() for p in own), defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for at, (doc, n_a, n_b, n_groups, digest) in found.items():
        own = links[at]
        out.append((doc, n_a, n_b, n_groups, own.total(), sum(n for p, n in own.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in own.items()), digest))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r["doc_id"], *(r[n] for n in alignment.RESULTS)) for r in df.collect()), key=str)


def test_split_spaces():
    assert " " in alignment.split_spaces(A, B) and "\r" not in alignment.split_spaces(A, B)


def test_whole_table(spark, tokens):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert rows(alignment.align_texts(docs.repartition(5), ["doc_id"], A, B)) == plain([tuple(r) for r in docs.collect()], tokens)


def test_edges_in_small_slices(spark, tokens, monkeypatch):
    texts = [
        "The cat sat.\nOn  the\t mat;\r\n end \n\n",
        " \t\n ",
        "a",
        "",
        None,
        "lower ▁ block",
        "<s>x</s> <|endoftext|> <unk> <0x41>",
        "naïve \U0001f600 ąęß 日本語  x \x1c \x85 \x00 y",
        "x" * 5_000 + " " + "日本" * 2_000,
        " " * 300 + "wide",
        "the the the the " * 3_000,
        ";\r x\r y \r\nz ▁",
        "don't I'll we're '' ,,,.. !?",
        "The cat sat.\nOn  the\t mat;\r\n end \n\n",
    ]
    monkeypatch.setattr(alignment, "SLICE_BYTES", 200)
    monkeypatch.setattr(alignment, "LINKED", 7)
    docs = [(i % 12 if i % 5 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, 1, "g") for i, t in docs], "doc_id long, text string, n_a int, __groups string").repartition(3)
    assert rows(alignment.align_texts(df, ["doc_id", "n_a"], A, B)) == plain(docs, tokens)
    assert alignment.align_texts(df.limit(0), ["doc_id"], A, B).collect() == []


def test_segments_that_are_not_given_back(tokens):
    """Single lossy segments are found among good ones, whatever the reason."""
    a, b = alignment.ByteLevel(A), alignment.Pieces(B)
    b.tokens[b.ids(" cat")[0]] = b"?"
    found = alignment.Linked(alignment.align([b" dog", b" cat", b" the", b" \xe2\x96\x81", b" cat"], a, b))
    assert (found.counts[:, 2] < 0).tolist() == [False, True, False, True, True]
    assert found.texts[1] == b"" and found.texts[0]
