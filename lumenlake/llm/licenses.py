"""Licence recognition by sentences and rules.

A text is normalised to words: lower case, runs of letters and digits; version numbers and years stand apart, and comment signs, quotes and
line ends within a paragraph vanish, so that sentences may be wrapped as they are in files. Known sentences, normalised
alike, have identifiers. One is recognised where its words stand within a paragraph (blank lines end it), beginning and ending at a line's
edge or a sign of punctuation; of several the longest counts, from left to right.

A tag SPDX-License-Identifier is a sentence of its own, spdx: and its expression, which names the licence as it stands: identifiers joined by AND, OR
and WITH, in parentheses or not.

The identifiers of a text, in order and without what stands between them, are matched against ordered rules from left to right: the first
rule whose sequence stands at a place is reported and its sentences are used up; a sentence that begins no rule reports
"unmatched:<identifier>".

Null and empty texts have no sentences; an empty table gives no rows. Very long texts are read whole, in time that grows with their length. Equal lengths can't tie: two
known sentences never have the same words. Repeated rows give one result row each. Extra columns are harmless.
"""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumenlake.llm.common import map_texts
from lumenlake.llm.license_sentences import RULES, SENTENCES, SPDX

#: One of these occurs in each known sentence, whatever blanks and signs part its words; other texts need no reading.
HINT = re.compile(r"licen[sc]e|permission|copyright|warrant|redistribut|merchantab|rights[\W_]+reserved|public[\W_]+domain|mozilla|liable|CC[\W_]*BY|CC0", re.I)
WORD = re.compile(r"v?([0-9]+(?:\.[0-9]+)*)(?![^\W_])|[^\W_]+")
# Spellings that count as one.
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed"}
ANYWHERE = "..."
#: An expression: no more of the line than its grammar takes.
_ONE = r"(?:\([ \t]*)*[A-Za-z0-9][A-Za-z0-9.+-]*(?:[ \t]*\))*"
SPDX_TAG = re.compile(rf"SPDX-License-Identifier:[ \t]*({_ONE}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_ONE})*)")


def _word(m: re.Match) -> str:
    return "{v}" if m[1] else SPELLINGS.get(m[0], m[0])


def normalised(sentence: str) -> tuple[str, ...]:
    """A known sentence's words."""
    return tuple(x for part in re.split(r"(\{v\})", sentence.lower().removeprefix(ANYWHERE)) for x in ((part,) if part == "{v}" else map(_word, WORD.finditer(part))))


def _index() -> dict[tuple[str, str], list[tuple[tuple[str, ...], str, bool]]]:
    """Words, identifier and whether it begins anywhere, of the known sentences by their first two words; the longest first."""
    out = defaultdict(list)
    for name, wordings in SENTENCES.items():
        for w in wordings:
            words = normalised(w)
            out[words[:2]].append((words, name, w.startswith(ANYWHERE)))
    for known in out.values():
        known.sort(key=lambda k: (-len(k[0]), k[0]))
    return dict(out)


KNOWN = _index()


def sentences(text: str | None) -> list[tuple[str, str, int]]:
    """(identifier, version, start) of the known sentences, in order; the version is the first one in it."""
    if not text or not HINT.search(text):
        return []
    low = text.lower()
    if len(low) != len(text):  # a few letters change their length; positions are those of the text
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found = list(WORD.finditer(low))
    words = [_word(m) for m in found]
    gaps = [low[a.end() : b.start()] for a, b in zip(found, found[1:])]
    edge = [True, *(not g.isspace() or "\n" in g for g in gaps), True]  # before each word, and after the last
    paragraph = [0]
    for g in gaps:
        paragraph.append(paragraph[-1] + (g.count("\n") > 1))
    out, at = [], 0
    while at + 1 < len(words):
        for known, name, anywhere in KNOWN.get((words[at], words[at + 1]), ()):
            stop = at + len(known)
            if stop <= len(words) and tuple(words[at:stop]) == known and edge[stop] and (anywhere or edge[at]) and paragraph[at] == paragraph[stop - 1]:
                version = next((m[1] for m in found[at:stop] if m[1]), "")
                out.append((name, version, found[at].start()))
                at = stop
                break
        else:
            at += 1
    tags = [(SPDX + _expression(m[1]), "", m.start()) for m in SPDX_TAG.finditer(text)]
    return sorted([*out, *tags], key=lambda x: x[2]) if tags else out


def _expression(text: str) -> str:
    """With single blanks, and without parentheses that nothing closes."""
    text = re.sub(r"\(\s+", "(", re.sub(r"\s+\)", ")", " ".join(text.split())))
    return text if text.count("(") == text.count(")") else text.replace("(", "").replace(")", "")


def _fits(names: tuple[str, ...], wanted: tuple[str, ...]) -> int:
    """How many of the first names a rule takes; 0 if it doesn't stand there."""
    at = 0
    for w in wanted:
        if at < len(names) and names[at] == w.removesuffix("?"):
            at += 1
        elif not w.endswith("?"):
            return 0
    return at


MOST_WANTED = max(len(wanted) for _, wanted in RULES)


def match_rules(found: list[tuple[str, str, int]]) -> list[tuple[str, int]]:
    """(licence, start) of what the rules report, from left to right."""
    out, at, names = [], 0, tuple(x[0] for x in found)
    while at < len(found):
        if names[at].startswith(SPDX):
            out.append((names[at][len(SPDX) :], found[at][2]))
            at += 1
            continue
        here = names[at : at + MOST_WANTED]
        for licence, wanted in RULES:
            if n := _fits(here, wanted):
                version = next((v for _, v, _ in found[at : at + n] if v), "")
                named = licence.replace("{v}", version) if "{v}" in licence else f"{licence}-{version}" if version else licence
                out.append((named, found[at][2]))
                at += n
                break
        else:
            out.append((f"unmatched:{names[at]}", found[at][2]))
            at += 1
    return out


def scan_licenses(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys; sentences and licenses in order of place, comma-joined; n_licenses; and places, code points where they start."""

    def work(texts: list[str | None]) -> list[list]:
        found = [sentences(t) for t in texts]
        ruled = [match_rules(x) for x in found]
        return [[",".join(x[0] for x in f) for f in found], [",".join(x[0] for x in r) for r in ruled], [len(r) for r in ruled], [",".join(str(x[1]) for x in r) for r in ruled]]

    fields = [T.StructField("sentences", T.StringType()), T.StructField("licenses", T.StringType()), T.StructField("n_licenses", T.LongType()), T.StructField("places", T.StringType())]
    return map_texts(docs, keys, text_col, fields, lambda: work)
