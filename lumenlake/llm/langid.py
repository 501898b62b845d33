"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a sample of labelled text is built. A text is parsed against it into
phrases, each the longest string from its start that occurs in the sample; a symbol that the sample lacks
is a phrase of its own. A phrase costs log2 of the sample's length, LEAST_SAMPLE at least, and a symbol that the sample lacks
UNSEEN_BITS whatever the sample, so that a small sample gains nothing by what it doesn't know. The language whose
phrases cost least per symbol wins; equal ones go to the smaller name.

Texts are lower-cased, runs of non-letters count as one blank, marks stay with their letters, and symbols are the bytes of
what remains, so that all scripts count alike. Whole texts are parsed: pieces of BLOCK symbols advance together, a symbol at
a time, each after WARM symbols of the one before it; a piece that doesn't begin as the one before it ended is parsed again from there.

Whether a text is in the languages learned at all is judged by its own cost a symbol, each piece of BLOCK symbols in the language that suits it best (a
text may hold passages of several), against that of pieces of labelled rows that were kept out of
the sample (HELD_CHARS of each language): it may lie OVER of their median and FIXED_SPREAD of their upper spreads above the median, and PIECE_SPREAD
more for a text as short as a piece; that part falls with the root of the length. A language without such rows takes the largest limit of the others. The
score is how far the best language is ahead of the others, less for short texts, times how well its cost fits.

The sample and what is held back are the only things learned and are bounded: SAMPLE_CHARS characters of each language (SAMPLE_BYTES symbols;
MODEL_BYTES shared evenly where the languages are many), in the order of a hash of the rows' ids; a row over ROW_CHARS characters lends
a stretch of that length, at a place given by the hash. Predictions see the text alone.
Null texts and texts without a letter are "und" with score 0, and so is every text if nothing could be
learned. Null ids are not learned from and not held out. Languages of equal samples tie, and the smaller name gets
all of their texts, with a score of a half at most. An empty table gives no rows. Repeated rows and extra columns are harmless.
"""

from __future__ import annotations

import functools
import unicodedata
from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.llm.common import filter_texts, map_texts

SAMPLE_CHARS, ROW_CHARS, SAMPLE_ROWS, SALTS = 48_000, 4_000, 400, 64
SAMPLE_BYTES, MODEL_BYTES = 48_000, 400_000
LEAST_SAMPLE, UNSEEN_BITS = 1_024, 24.0
BLOCK, WARM, COLUMNS = 1_024, 128, 1_024
#: How fast the score falls with the distance, in bits a symbol, to other languages.
SHARPNESS = 8.0
#: A text of so many symbols tells half as much as a long one.
SHORT_TEXT = 16
#: Characters of a language that judge its costs; symbols of a piece; how far a text may lie above the median cost of pieces, in parts of it and in spreads.
HELD_CHARS, PIECE, OVER, FIXED_SPREAD, PIECE_SPREAD = 16_000, 128, 0.4, 3.0, 6.0
#: The spread is the distance from the median to the 75th percentile in standard deviations; copies of the sample, which cost nothing, and pieces in other
#: languages don't widen it.
UPPER = 0.6745
#: How fast the score falls where a cost, in bits a symbol, reaches its limit.
FIT = 4.0
SPACE = 32


@dataclass(frozen=True)
class Known:
    """By language: a bounded sample of labelled text, and pieces of rows that were held back from it."""

    sample: dict[str, str]
    held: dict[str, list[str]]


def learn(docs: DataFrame, rows: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Known:
    """The sample of each language, SAMPLE_ROWS rows and SAMPLE_CHARS characters at most, and what comes after it, HELD_CHARS characters at most.

    Where a language has no more than its sample, every fifth row is held back.
    """
    text, lang = docs[text_col], docs[lang_col]
    rows = docs.where(rows & docs[id_col].isNotNull() & text.isNotNull() & lang.isNotNull() & (F.length(text) > 0))
    place = 1 + F.pmod(F.xxhash64(id_col), F.greatest(F.length(text) - ROW_CHARS, F.lit(0)) + 1).cast("int")
    rows = rows.select(lang.alias("lang"), F.substring(text, place, F.lit(ROW_CHARS)).alias("text"), F.xxhash64(id_col).alias("h"))
    by = Window.partitionBy("lang").orderBy("h", "text")
    # The first of each salt, then of all: a common language's rows are narrowed down by many tasks.
    salted = Window.partitionBy("lang", F.pmod("h", F.lit(SALTS))).orderBy("h", "text")
    rows = rows.withColumn("n", F.row_number().over(salted)).where(F.col("n") <= -(-2 * SAMPLE_ROWS // SALTS))
    rows = rows.withColumn("n", F.row_number().over(by)).where(F.col("n") <= SAMPLE_ROWS)
    rows = rows.withColumn("upto", F.sum(F.length("text")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    picked = rows.where(F.col("upto") <= SAMPLE_CHARS + HELD_CHARS).select("lang", "n", "upto", "text").collect()
    found: dict[str, list] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["n"])):
        found.setdefault(r["lang"], []).append(r)
    sample, held = {}, {}
    for name, own in found.items():
        known = {r["text"] for r in own if r["upto"] <= SAMPLE_CHARS}
        back = [r["text"] for r in own if r["upto"] > SAMPLE_CHARS and r["text"] not in known]
        sample[name] = "\n".join(r["text"] for r in own if r["upto"] <= SAMPLE_CHARS and (back or r["n"] % 5))
        held[name] = back or [r["text"] for r in own if r["n"] % 5 == 0]
    return Known({k: v for k, v in sample.items() if v}, held)


def learn_sample(docs: DataFrame, rows: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """The sample of learn() alone."""
    return learn(docs, rows, id_col, text_col, lang_col).sample


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point, whether it is a letter, and whether it is a letter or a mark."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    mark = np.fromiter((unicodedata.category(chr(i))[0] == "M" for i in range(0x110000)), bool, 0x110000)
    return letter, letter | mark


def encode(text: str | None) -> np.ndarray:
    """The bytes of the text's letters in lower case, with one blank for a run of anything else; none for a text without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter, kept = _letters()
    if not letter[codes].any():
        return np.zeros(0, np.uint8)
    gap = ~kept[codes]
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    return np.frombuffer(np.where(gap, np.uint32(SPACE), codes)[keep].tobytes().decode("utf-32-le").encode(), np.uint8)


def automaton(symbols: np.ndarray, width: int) -> np.ndarray:
    """Flat table of the suffix automaton's steps: 2 * width * (next state) + (1 if a new phrase begins).

    Symbols are below width - 2. The symbol width - 2 occurs nowhere: a last state follows it, so that it is a phrase and whatever
    comes next begins one. The symbol width - 1 pads: it changes nothing.
    """
    step = array("i", [-1]) * (width * (2 * len(symbols) + 2))
    link, length, last, states = [-1], [0], 0, 1
    for c in symbols.tolist():
        new, states = states, states + 1
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and step[p * width + c] < 0:
            step[p * width + c] = new
            p = link[p]
        if p >= 0:
            q = step[p * width + c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy, states = states, states + 1
                step[copy * width : (copy + 1) * width] = step[q * width : (q + 1) * width]
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p * width + c] == q:
                    step[p * width + c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.frombuffer(step, np.int32)[: (states + 1) * width].reshape(states + 1, width).copy()
    ends = table < 0
    ends[0] = False  # the first phrase is the first symbol's
    table[0][table[0] < 0] = states
    table = np.where(ends, table[0], table)
    table *= 2 * width
    table += ends
    table[:, width - 1] = np.arange(states + 1, dtype=np.int32) * (2 * width)
    return table.ravel()


def phrases(blocks: np.ndarray, steps: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How many phrases begin in each column of blocks, after the first symbol of a text, and the state at its end; at: where they start."""
    at = np.zeros(blocks.shape[1], np.int32) if at is None else at.copy()
    count = np.zeros(blocks.shape[1], np.int32)
    entry = np.empty_like(at)
    for row in blocks:
        np.add(at, row, out=at)
        np.take(steps, at, out=entry)
        np.bitwise_and(entry, 1, out=at)
        count += at
        np.right_shift(entry, 1, out=at)
    return count, at


class Language:
    """A language's automaton, over the bytes of its own sample."""

    def __init__(self, name: str, symbols: np.ndarray) -> None:
        seen = np.unique(symbols)
        self.name, self.unseen, self.pad = name, len(seen), len(seen) + 1
        self.symbol = np.full(256, self.unseen, np.uint8)
        self.symbol[seen] = np.arange(len(seen))
        self.steps = automaton(self.symbol[symbols], len(seen) + 2)
        self.bits = float(np.log2(max(len(symbols), LEAST_SAMPLE)))

    def rates(self, joined: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Cost in bits per symbol of each text, and in bits of each of their pieces; texts stand one after another in joined."""
        own = self.symbol[joined]
        parts = -(-sizes // BLOCK)
        first = np.cumsum([0, *parts[:-1]])
        inner = np.ones(int(parts.sum()), bool)
        inner[first] = False
        of = np.repeat(np.arange(len(sizes)), parts)
        begin = (starts[of] + BLOCK * (np.arange(len(of)) - first[of])).astype(np.int32)
        end = np.minimum(begin + BLOCK, starts[of] + sizes[of]).astype(np.int32)
        padded = np.append(own, np.uint8(self.pad))
        count, state, entered = (np.zeros(len(of), np.int32) for _ in range(3))
        for some in order:
            at = None
            if inner[some].any():
                warm = np.where(inner[some][None, :], begin[some][None, :] - WARM + np.arange(WARM, dtype=np.int32)[:, None], np.int32(len(own)))
                at = phrases(padded[warm], self.steps)[1]
                entered[some] = at
            longest = int((end[some] - begin[some]).max())
            place = begin[some][None, :] + np.arange(longest, dtype=np.int32)[:, None]
            block = padded[np.where(place < end[some][None, :], place, np.int32(len(own)))]
            count[some], state[some] = phrases(block, self.steps, at)
        # A piece that was entered in another state than the one before it ended in is parsed from there.
        for b in np.flatnonzero(inner & (entered != np.append(0, state[:-1]))).tolist():
            self._again(own, b, begin, end, count, state, entered, inner)
        unseen = np.add.reduceat(own == self.unseen, begin, dtype=np.int64)
        count[first] += 1  # the first phrase of a text
        bits = (count - unseen) * self.bits + unseen * UNSEEN_BITS
        return np.add.reduceat(bits, first) / sizes, bits

    def _again(self, own: np.ndarray, b: int, begin: np.ndarray, end: np.ndarray, count: np.ndarray, state: np.ndarray, entered: np.ndarray, inner: np.ndarray) -> None:
        steps = self.steps
        while b < len(inner) and inner[b] and entered[b] != state[b - 1]:
            entered[b] = state[b - 1]
            at, n = int(state[b - 1]), 0
            for c in own[begin[b] : end[b]].tolist():
                entry = int(steps[at + c])
                n += entry & 1
                at = entry >> 1
            count[b], state[b] = n, at
            b += 1


class Parser:
    """The languages of a sample, with the limits of their costs where held-back rows set them."""

    def __init__(self, known: dict[str, str] | Known) -> None:
        known = known if isinstance(known, Known) else Known(known, {})
        most = min(SAMPLE_BYTES, MODEL_BYTES // max(1, len(known.sample)))
        coded = [(name, encode(text)[:most]) for name, text in sorted(known.sample.items())]
        self.languages = [Language(name, c) for name, c in coded if len(c)]
        self.limits = self._limits(known.held)

    def _limits(self, held: dict[str, list[str]]) -> np.ndarray:
        """Median and upper spread of the cost of pieces of each language's held-back rows; where it has none, the largest there are."""
        out = np.full((2, len(self.languages)), np.nan)
        for at, language in enumerate(self.languages):
            joined = encode(" ".join(held.get(language.name, [])))
            parts = [joined[i : i + PIECE] for i in range(0, len(joined) - PIECE + 1, PIECE)]
            if len(parts) > 1:
                costs = self._rates(parts, [language])[0][0]
                middle, high = np.percentile(costs, (50, 75))
                out[:, at] = middle, (high - middle) / UPPER
        return np.where(np.isnan(out), np.nanmax(out, 1, keepdims=True) if np.isfinite(out).any() else np.inf, out) if len(self.languages) else out

    @staticmethod
    def _rates(coded: list[np.ndarray], languages: list[Language]) -> tuple[np.ndarray, np.ndarray]:
        """Costs in bits a symbol of texts that are not empty, by language; and where each of their pieces is in the language that suits it best."""
        sizes = np.array([len(c) for c in coded])
        starts = np.cumsum([0, *sizes[:-1]])
        joined = np.concatenate(coded)
        # Pieces of like length advance together; those that need warming up, apart.
        parts = -(-sizes // BLOCK)
        lengths = np.full(int(parts.sum()), BLOCK)
        lengths[np.cumsum(parts) - 1] = sizes - BLOCK * (parts - 1)
        first = np.zeros(len(lengths), bool)
        first[np.cumsum([0, *parts[:-1]])] = True
        order = [some for kind in (np.flatnonzero(first), np.flatnonzero(~first)) if len(kind) for some in np.array_split(kind[np.argsort(lengths[kind], kind="stable")], -(-len(kind) // COLUMNS))]
        rates, bits = zip(*[x.rates(joined, starts, sizes, order) for x in languages], strict=True)
        return np.array(rates), np.add.reduceat(np.array(bits).min(0), np.cumsum([0, *parts[:-1]])) / sizes

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """The language and the score, from 0 to 1, of each text; whether its cost is within that language's limit."""
        languages = self.languages
        coded = [encode(t) for t in texts]
        real = [i for i, c in enumerate(coded) if len(c)]
        langs, scores, fits = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
        if not real or not languages:
            return langs, scores, fits
        rates, mixed = self._rates([coded[i] for i in real], languages)
        sizes = np.array([len(coded[i]) for i in real])
        best = rates.argmin(0)
        weight = SHARPNESS * sizes / (sizes + SHORT_TEXT)
        ahead = 1 / np.exp(-weight * (rates - rates.min(0))).sum(0)
        middle, spread = self.limits[:, best]
        over = mixed - (middle * (1 + OVER) + spread * (FIXED_SPREAD + PIECE_SPREAD * np.sqrt(PIECE / sizes)))
        score = ahead / (1 + np.exp(np.clip(FIT * over, -50, 50)))
        for i, b, s, o in zip(real, best.tolist(), score.tolist(), over.tolist(), strict=True):
            langs[i], scores[i], fits[i] = languages[b].name, s, o <= 0
        return langs, scores, fits

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and the score of each text."""
        return self.judge(texts)[:2]


def identify(docs: DataFrame, known: dict[str, str] | Known, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, lang_pred and score of every row."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_texts(docs, keys, text_col, fields, lambda: Parser(known).predict)


def keep_identified(docs: DataFrame, known: dict[str, str] | Known, text_col: str = "text") -> DataFrame:
    """The rows, unchanged, whose text has letters and is, by its cost, in one of the languages known; without held-back rows any text with letters is."""
    return filter_texts(docs, text_col, lambda: lambda texts, parser=Parser(known): parser.judge(texts)[2])
