"""Personal data in text: patterns propose, checksums confirm, words nearby adjust the score.

Base kinds (always reported): email, ip, card (Luhn), phone. Kinds that the method adds, reported at
MIN_SCORE or more: iban (length by country, mod-97), and national_phone and national_id (number ranges), which need a context word.

Null and empty texts have no spans; an empty table gives no rows. Repeated rows and ids give one result row each. Other columns of the
input play no part, whatever their names. Every text is read whole in one pass; patterns take linear time,
since each run of characters is entered once (possessive quantifiers, or a scan back from the at sign).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumenlake.llm.common import map_texts, replace_texts

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "national_phone", "national_id")
MIN_SCORE = 0.6
#: Characters on either side of a span in which context words count.
CONTEXT_CHARS = 48
# Words that make a kind more likely.
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "login", "client"),
    "card": ("card", "visa", "credit", "debit", "payment", "tarjeta", "carte", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta", "transfer"),
    "national_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "national_id": ("ssn", "social", "security", "identity", "id", "dni", "passport", "ausweis"),
}
# A kind's score before checks and context.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.5, "phone": 0.5, "iban": 0.5, "national_phone": 0.4, "national_id": 0.3}
CHECKED, NEAR = 0.4, 0.3

# Characters of an IBAN by country.
IBAN_SIZES = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, ES=24, FI=18, FO=18,
    FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LI=21, LT=20, LU=20, LV=21,
    MC=27, MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, SA=24, SE=24, SI=19, SK=24, SM=27,
    TN=24, TR=26, VG=24, XK=20,
)

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
NATIONAL_PHONE = re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("checked", T.BooleanType())]))


def luhn(digits: str) -> bool:
    """Luhn's checksum: every second digit from the right is doubled."""
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if place % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: the first four characters go last, letters count from 10, the number modulo 97 is 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        head = text[free:at]
        start = free + len(head.rstrip(LOCAL))
        m = DOMAIN.match(text, at) if start < at else None
        free = m.end() if m else at + 1
        if m:
            yield start, m.end()
        at = text.find("@", free)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) < 3 or len(p) == 3 and p <= "255" for x in m.group().split(".")):
            yield m.span()


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    m = IBAN.search(text)
    while m:
        start, end = m.span()
        size = IBAN_SIZES.get(text[start : start + 2])
        if size:  # what follows in capitals may be other words
            places = [i for i in range(start, end) if text[i] != " "]
            end = places[size - 1] + 1 if len(places) >= size else end
        whole = text[start:end].replace(" ", "")
        good = len(whole) == (size or len(whole)) and not text[end : end + 1].isalnum() and mod97(whole)
        if good:
            yield start, end
        m = IBAN.search(text, end if good else start + 4)


def _national_ids(text: str) -> Iterator[tuple[int, int]]:
    for m in NATIONAL_ID.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


def _near(text: str, kind: str, start: int, end: int) -> bool:
    around = f"{text[max(0, start - CONTEXT_CHARS) : start]} {text[end : end + CONTEXT_CHARS]}".lower()
    return not set(CONTEXT[kind]).isdisjoint(WORD.findall(around))


def _free(found: list[tuple]) -> Callable[[int, int], bool]:
    """Whether a span overlaps none of those found: they are merged into runs, of which a search meets one."""
    starts, ends = [], []
    for s, e in sorted((s, e) for _, s, e, _ in found):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return lambda a, b: (i := bisect_left(starts, b)) == 0 or ends[i - 1] <= a


def find_spans(text: str | None) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, checked) of all spans: base kinds as listed, then added ones; by start within a kind."""
    if not text:
        return []
    found = [("email", *s, False) for s in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [("ip", *s, True) for s in _ips(text)]
        found += [("card", *s, True) for s in _cards(text)]
        found += [("phone", *s, False) for s in _phones(text)] if "+" in text else []
        clear = _free(found)
        more = [("iban", *s, True) for s in _ibans(text)]
        more += [("national_phone", *m.span(), False) for m in NATIONAL_PHONE.finditer(text)]
        more += [("national_id", *s, False) for s in _national_ids(text)]
        found += [x for x in more if clear(x[1], x[2])]
    out = []
    for kind, start, end, checked in found:
        score = min(1.0, PRIOR[kind] + CHECKED * checked + NEAR * _near(text, kind, start, end))
        if kind in BASE_KINDS or score >= MIN_SCORE:
            out.append((kind, start, end, round(score, 2), checked))
    return out


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the widest reach is covered."""
    spans = sorted((s, -e, kind) for kind, s, e, _, _ in find_spans(text))
    if not spans:
        return text
    parts, at = [], 0
    for start, neg_end, kind in spans:
        if -neg_end <= at:
            continue
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = -neg_end
    return "".join([*parts, text[at:]])


def detect_pii(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys and pii, an array of (kind, start, end, score, checked), of every row; positions are code points, end exclusive."""
    names = SPANS.elementType.names
    one = lambda text: [dict(zip(names, s, strict=True)) for s in find_spans(text)]
    return map_texts(docs, keys, text_col, [T.StructField("pii", SPANS)], lambda: lambda texts: [[one(t) for t in texts]])


def redact_pii(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with redacted texts; length_col, if there, follows the length of a text that changed."""
    return replace_texts(docs, text_col, lambda texts: [redact(t) for t in texts], length_col)
