"""Personal data against the plain patterns, and the method's own spans."""

from __future__ import annotations

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lumenlake.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text: str) -> list[tuple[str, int, int]]:
    """The base spans, read off the patterns."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(d := digits(m.group())) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]


def base(text: str) -> list[tuple[str, int, int]]:
    return [(k, s, e) for k, s, e, *_ in pii.find_spans(text) if k in pii.BASE_KINDS]


PIECES = st.sampled_from(["a", "b.c", "@", ".", "-", "+", " ", "4111111111111111", "4111 1111 1111 1111", "10.0.0.1", "256.1.1.1", "1.2.3", "+1 (555) 010-9999", "é", "😀", "_", "%", "x@y.zz", "00", "7", "(", ")", "\n"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert base(text) == plain(text)


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("pay into my bank account DE89 3704 0044 0532 0130 00 today", "iban"),
        ("call me, phone 555-010-9999 now", "national_phone"),
        ("my social security number 078-05-1120 is", "national_id"),
    ],
)
def test_the_method_adds_spans(text, kind):
    assert kind in [s[0] for s in pii.find_spans(text)]


def test_checksums_and_context_decide():
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000")
    assert not [s for s in pii.find_spans("bank DE88 3704 0044 0532 0130 00") if s[0] == "iban"]
    assert not [s for s in pii.find_spans("order 078-05-1120 shipped") if s[0] == "national_id"]
    near, far = pii.find_spans("mail a@b.cc")[0], pii.find_spans("zzz a@b.cc")[0]
    assert near[3] > far[3]


def test_long_runs_take_linear_time():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "+1" * 500_000, "a@" * 500_000, "1." * 500_000, "1 " * 500_000):
        pii.find_spans(text)


def test_ibans_end_where_their_country_says():
    found = lambda t: [t[s[1] : s[2]] for s in pii.find_spans(t) if s[0] == "iban"]
    assert found("IBAN DE89 3704 0044 0532 0130 00 AND BANK GB82 WEST 1234 5698 7654 32") == ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]
    assert found("bank DE89370400440532013000X") == found("bank DE8937040044053201300") == []


def test_numbers_out_of_range_are_no_ids():
    assert not [s for n in ("000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "123-45-0000") for s in pii.find_spans(f"my social security number {n}") if s[0] == "national_id"]


def test_very_many_spans_in_one_text():
    text = "phone 555-010-9999 or +1 555 010 9999, " * 20_000
    began = time.time()
    found = pii.find_spans(text)
    assert sum(s[0] == "phone" for s in found) == sum(s[0] == "national_phone" for s in found) == 20_000
    assert time.time() - began < 20
    taken = [("ip", s, s + 3, True) for s in (5, 7, 30, 8, 50)]
    free = pii._free(taken)
    assert all(free(a, a + n) == all(a + n <= s or e <= a for _, s, e, _ in taken) for a in range(60) for n in range(1, 30))


def test_rows_of_any_kind(spark):
    long = "word " * 200_000 + "a@b.cc"
    rows = [(1, "a@b.cc", "x"), (1, "a@b.cc", "x"), (2, None, "y"), (None, "", None), (3, long, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii string")
    found = sorted(((r["doc_id"] or 0, [(s["kind"], s["start"], s["end"]) for s in r["pii"]]) for r in pii.detect_pii(docs, ["doc_id"]).collect()), key=str)
    assert found == [(0, []), (1, [("email", 0, 6)]), (1, [("email", 0, 6)]), (2, []), (3, [("email", 1_000_000, 1_000_006)])]
    assert pii.detect_pii(docs.limit(0), ["doc_id"]).count() == 0


def test_redaction_leaves_nothing_and_other_texts_alone(spark):
    texts = ["write to a@b.cc or 10.0.0.1", "nothing here", None, "", "4111 1111 1111 1111 and +1 555 010 9999"]
    docs = spark.createDataFrame([(i, t, len(t or ""), "s") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, source string")
    out = pii.redact_pii(docs).orderBy("doc_id").collect()
    assert out[0]["text"] == "write to [EMAIL] or [IP]" and out[0]["n_chars"] == len(out[0]["text"])
    assert [r["text"] for r in out[1:4]] == texts[1:4]
    assert not any(pii.find_spans(r["text"]) for r in out)
    assert pii.redact_pii(docs).schema == docs.schema
