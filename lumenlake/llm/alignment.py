"""Alignment of two tokenizers' tokens, by distinct segments.

A text with a blank before it is split before a run of white space that follows a character which is none, where no token of either vocabulary
holds such a character and that white space after it: there neither tokenizer joins anything, so segments can be encoded on their own.
The vocabularies say which white space that is. Characters that share their first byte with white space count as such: there texts stay whole.

Slices of documents name each of their distinct segments once, and documents become numbers of segments. The names of all slices meet by
a hash of the segment; each distinct segment is encoded and aligned once there, and what is known of it goes back to the slices. Byte
offsets where tokens of both end cut a segment into groups; each pair of an A and a B token of a group is a link.
From the slices' documents follow, for each pair of ids, how many documents hold it linked; slices send these counts, each pair once, to
where they are added up and compared, and get the sums back, from which each document's own follow.

What travels is one row for each slice and bucket, of arrays. A slice is bounded by its bytes, unless one text is longer; a bucket by the number of buckets, which grows
with the shuffle's partitions. A segment or pair that all documents hold counts once a slice.

A text has no tokens if it is null or empty, or if the bytes of A's or B's tokens are not those of the text with a blank before it, as
with U+2581, which B takes for a blank: its numbers are 0 and its groups "". Null and repeated ids, repeated rows and ties: each row
counts as a document of its own. An empty table gives no rows. Very long texts are encoded whole. Extra columns play no part.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenlake.llm.common import cut, pieces, spread, tidied

SPACES = " \t\n\x0b\x0c\r"
#: A character before white space, in UTF-8: none that is white space, or begins as such, or as a control sign.
SOLID = rb"[!-~]", rb"[\xc3-\xdf][\x80-\xbf]", rb"[\xe4-\xed][\x80-\xbf]{2}", rb"[\xf0-\xf4][\x80-\xbf]{3}"
SOLID_END = re.compile(rb"(?:%b)\Z" % b"|".join(SOLID))
#: Bytes that a text without other white space, control signs or the like lacks.
ODD = re.compile(rb"[\x00-\x08\x0d-\x1f\x7f\xc2\xe1-\xe3]")
#: Bytes of texts in a slice; distinct segments encoded at a time; buckets of segments for each partition of the shuffle.
SLICE_BYTES, SEGMENT_BYTES, BUCKETS = 6_000_000, 250_000, 4
#: Segments that are linked at a time.
LINKED = 30_000
#: Distinct segments that a bucket keeps, in bytes, before it forgets them.
KEPT_BYTES = 16_000_000
#: Ids of B are below this.
WIDTH = 1 << 20


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(own))
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """A tokenizer: the ids of a text that begins with white space, and the bytes of each id."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.sizes = np.array([len(t) for t in tokens], np.int64)

    def ids(self, text: str) -> np.ndarray:
        raise NotImplementedError

    def joins(self, space: str) -> bool:
        """Whether a token holds the white space after something else."""
        inner = re.compile(rb"(?:%b)%b" % (b"|".join(SOLID), re.escape(space.encode())))
        return any(inner.search(t) for t in self.tokens)


class ByteLevel(Vocabulary):
    """A byte-level BPE from a file of the tokenizers library. Its words are cut before white space by its own pattern."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        alphabet = _byte_alphabet()
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            tokens[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        super().__init__(tokens)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)


class Pieces(Vocabulary):
    """A BPE model of the sentencepiece library that adds a blank before a text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces_ = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        super().__init__([bytes([int(t[3:5], 16)]) if p.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(pieces_)])
        self.blank = p.piece_to_id("▁")

    def ids(self, text: str) -> np.ndarray:
        if text == " ":  # at a text's end; the model adds no blank to nothing
            return np.array([self.blank], np.int64)
        if text[0] == " ":
            return np.array(self.processor.encode(text[1:], num_threads=1), np.int64)
        found = np.array(self.processor.encode(text, num_threads=1), np.int64)
        if found[0] != self.blank:
            raise ValueError("the blank before a text is joined to it")
        return found[1:]


@functools.cache
def split_spaces(a_path: str, b_path: str) -> str:
    """White space before whose runs texts are split: no token of either vocabulary holds it after something else, nor a blank before it that B adds."""
    both = ByteLevel(a_path), Pieces(b_path)
    return "".join(s for s in SPACES if not any(v.joins(s) for v in both) and (s == " " or not any(t.startswith(b" " + s.encode()) for t in both[1].tokens)))


def splitter(spaces: str) -> Callable[[bytes], list[bytes]]:
    """The segments of a text that begins with a blank."""
    own = re.escape(spaces).encode()
    plain = re.compile(rb"[%b]+[^%b]*" % (own, own))
    odd = re.compile(rb"(?=[%b])(?:%b)" % (own, b"|".join(rb"(?<=%b)" % x for x in SOLID)))
    return lambda text: odd.split(text) if ODD.search(text) or not set(SPACES[:-1]) <= set(spaces) else plain.findall(text)


class Aligned:
    """Some segments' tokens, in their order: for A and for B how many a segment has, their ids, and which of them end a group. Lossy segments have none."""

    def __init__(self, sizes: list[np.ndarray], ids: list[np.ndarray], ends: list[np.ndarray]) -> None:
        self.sizes, self.ids, self.ends = sizes, ids, ends

    def taken(self, order: np.ndarray) -> Aligned:
        """The segments at these places."""
        at = [spread((np.cumsum(n) - n)[order], n[order]) for n in self.sizes]
        return Aligned([n[order] for n in self.sizes], [x[i] for x, i in zip(self.ids, at, strict=True)], [x[i] for x, i in zip(self.ends, at, strict=True)])


def joined(parts: list[Aligned]) -> Aligned:
    """The segments of all parts, one after another."""
    return Aligned(*([np.concatenate([getattr(x, k)[side] for x in parts]) for side in (0, 1)] for k in ("sizes", "ids", "ends")))


def align(segments: list[bytes], a: Vocabulary, b: Vocabulary) -> Aligned:
    """The tokens of each segment and where groups end. All are encoded as one text; a segment that one of the vocabularies does not give back is lossy."""
    alone = np.array([SOLID_END.search(s) is None for s in segments], bool)
    if alone.any() and len(segments) > 1:  # what ends a text may end otherwise, and is encoded on its own
        order = np.argsort(alone, kind="stable").tolist()
        rest = align([segments[i] for i in order[: len(order) - int(alone.sum())]], a, b)
        return joined([rest, *[align([segments[i]], a, b) for i in order[len(order) - int(alone.sum()) :]]]).taken(np.argsort(order))
    lossy = np.array(["▁".encode() in s for s in segments], bool)
    good = [s for s, bad in zip(segments, lossy.tolist(), strict=True) if not bad]
    text = b"".join(good)
    ids = [v.ids(text.decode()) for v in (a, b)] if text else [np.zeros(0, np.int64)] * 2
    if any(b"".join([v.tokens[i] for i in x.tolist()]) != text for v, x in zip((a, b), ids, strict=True)):
        if len(segments) == 1:
            return Aligned([np.zeros(1, np.int64)] * 2, [np.zeros(0, np.int64)] * 2, [np.zeros(0, bool)] * 2)
        half = len(segments) // 2
        return joined([align(segments[:half], a, b), align(segments[half:], a, b)])
    stops = [np.cumsum(v.sizes[x]) for v, x in zip((a, b), ids, strict=True)]
    bounds = np.cumsum([len(s) for s in good])
    sizes = [np.zeros(len(segments), np.int64) for _ in stops]
    for n, stop in zip(sizes, stops, strict=True):
        n[~lossy] = np.bincount(np.searchsorted(bounds, stop), minlength=len(good))
    return Aligned(sizes, ids, [np.isin(stop, other) for stop, other in zip(stops, stops[::-1], strict=True)])


class Linked:
    """What follows for some segments: numbers of tokens, groups (-1 if lossy) and links; the groups' texts; pairs of ids, and how often each is linked."""

    def __init__(self, found: Aligned) -> None:
        of = [np.cumsum(x) - x for x in found.ends]  # the group of each token
        groups = int(found.ends[0].sum())
        n = [np.bincount(x, minlength=groups) for x in of]
        segment = np.repeat(np.arange(len(found.sizes[0])), found.sizes[0])[found.ends[0]]  # the segment of each group
        self.counts = np.stack([np.bincount(segment, x, len(found.sizes[0])).astype(np.int64) for x in (n[0], n[1], np.ones(groups, np.int64), n[0] * n[1])], axis=1)
        self.counts[found.sizes[0] == 0, 2] = -1
        self.texts = _group_texts(found.ids, of, segment, len(found.sizes[0]))
        # Distinct ids of each group with their numbers; the pairs of a group are those of its distinct ids.
        distinct, own = [], []
        for ids, x in zip(found.ids, of, strict=True):
            key, many = np.unique(x * WIDTH + ids, return_counts=True)
            distinct.append((key % WIDTH, many))
            own.append(np.bincount(key // WIDTH, minlength=groups))
        pairs_of = own[0] * own[1]
        group = np.repeat(np.arange(groups), pairs_of)
        nth = np.arange(len(group)) - np.repeat(np.cumsum(pairs_of) - pairs_of, pairs_of)
        first = [np.cumsum(x) - x for x in own]
        at_a, at_b = first[0][group] + nth // np.maximum(own[1][group], 1), first[1][group] + nth % np.maximum(own[1][group], 1)
        pairs, times = distinct[0][0][at_a] * WIDTH + distinct[1][0][at_b], distinct[0][1][at_a] * distinct[1][1][at_b]
        # A pair may be linked in several groups of a segment.
        where = np.repeat(segment, pairs_of)
        order = np.lexsort((pairs, where))
        where, pairs, times = where[order], pairs[order], times[order]
        begin = np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (pairs[1:] != pairs[:-1]))[: len(pairs)])
        self.sizes = np.bincount(where[begin], minlength=len(found.sizes[0]))
        self.pairs, self.times = pairs[begin], np.add.reduceat(times, begin) if len(begin) else times


def linked(found: Aligned) -> Linked:
    """The same for any number of segments, LINKED at a time, as what is built on the way is many times what stays."""
    n = len(found.sizes[0])
    parts = [Linked(found.taken(np.arange(lo, min(n, lo + LINKED)))) for lo in range(0, max(n, 1), LINKED)]
    whole = parts[0]
    for k in ("counts", "sizes", "pairs", "times"):
        setattr(whole, k, np.concatenate([getattr(x, k) for x in parts]))
    whole.texts = [t for x in parts for t in x.texts]
    return whole


def _group_texts(encoded: list[np.ndarray], of: list[np.ndarray], segment: np.ndarray, segments: int) -> list[bytes]:
    """a1,a2|b1;a3|b2,b3 of each segment."""
    sides = []
    for ids, x in zip(encoded, of, strict=True):
        names = [str(i) for i in ids.tolist()]
        cuts = np.searchsorted(x, np.arange(len(segment) + 1)).tolist()
        sides.append([",".join(names[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)])
    groups = [f"{p}|{q}" for p, q in zip(*sides, strict=True)]
    cuts = np.searchsorted(segment, np.arange(segments + 1)).tolist()
    return [";".join(groups[lo:hi]).encode() for lo, hi in zip(cuts, cuts[1:], strict=False)]


FIELDS = "slice long, kind int, bucket long, row long, codes binary, segments binary, sizes binary, counts binary, pairs binary, times binary, a_sizes binary, a_ids binary, a_ends binary, b_sizes binary, b_ids binary, b_ends binary"
SIDES = tuple(f"__{side}_{k}" for k in ("sizes", "ids", "ends") for side in "ab")
DOCUMENT, SEGMENTS, PAIRS = 2, 0, 1  # in a slice, documents come last
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def packed(values: np.ndarray | bytes, rising: bool = False) -> bytes:
    """Values, or the steps of rising ones, compressed, with their size in front: they travel and are written more than once."""
    if rising:
        values = np.diff(values, prepend=values.dtype.type(0))
    raw = values if isinstance(values, bytes) else values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, dtype: type | None = None, rising: bool = False) -> np.ndarray | bytes:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True) if data[:8] != bytes(8) else b""
    if dtype is None:
        return raw
    values = np.frombuffer(raw, dtype)
    return np.cumsum(values, dtype=dtype) if rising else values


def packed_pairs(pairs: np.ndarray) -> bytes:
    """Pairs as their A ids, then their B ids."""
    return packed(np.concatenate([pairs // WIDTH, pairs % WIDTH]).astype(np.uint32))


def unpacked_pairs(data: bytes) -> np.ndarray:
    a, b = unpacked(data, np.uint32).reshape(2, -1).astype(np.int64)
    return a * WIDTH + b


def _pair_bucket(pairs: np.ndarray, buckets: int) -> np.ndarray:
    """By A's id, as the pairs of an id are compared."""
    return (pairs // WIDTH) * 2_654_435_761 % (1 << 32) % buckets


def _schema(df_fields: list[T.StructField], ddl: str) -> T.StructType:
    return T.StructType([*df_fields, *T._parse_datatype_string(ddl).fields])  # noqa: SLF001


def align_texts(docs: DataFrame, keep: list[str], a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """keep, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    spark = docs.sparkSession
    keep = [c for c in keep if c not in RESULTS]
    picked = docs.select(*keep, docs[text_col].cast("binary").alias("__text"))
    kept = picked.select(*keep).schema.fields
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    spaces = split_spaces(a_path, b_path)
    fields = [T.StructField(f"__{f.name}", f.dataType) for f in T._parse_datatype_string(FIELDS).fields]  # noqa: SLF001
    coded_type = T.StructType([*kept, *fields])
    coded_arrow = to_arrow_schema(coded_type)

    def filled(size: int, into: pa.Schema, **columns: object) -> pa.RecordBatch:
        """A batch with the columns given, all others null."""
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in into], schema=into)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each slice a row for each bucket of its segments, and its documents as numbers of these."""
        at, split = TaskContext.get().partitionId() << 33, splitter(spaces)
        rows: list[pa.RecordBatch] = []
        coded: list[np.ndarray] = []
        number: dict[bytes, int] = {}
        held = 0

        def told() -> Iterator[pa.RecordBatch]:
            names = list(number)
            bucket = np.fromiter(map(zlib.crc32, names), np.int64, len(names)) % buckets
            order = np.argsort(bucket, kind="stable")
            own, first = np.unique(bucket[order], return_index=True)
            parts = np.split(order.astype(np.uint32), first[1:]) if len(order) else []
            if parts:
                own_names = [[names[i] for i in x.tolist()] for x in parts]
                columns = {"__codes": [packed(x, rising=True) for x in parts], "__segments": [packed(b"".join(x)) for x in own_names], "__sizes": [packed(np.array([len(s) for s in x], np.uint32)) for x in own_names]}
                yield filled(len(own), coded_arrow, __slice=np.full(len(own), at), __kind=np.full(len(own), SEGMENTS), __bucket=own, **columns)
            codes = iter([packed(c) for c in coded])
            row = at
            for batch in rows:
                n = batch.num_rows
                columns = dict(zip(keep, batch.columns[: len(keep)], strict=True))
                yield filled(n, coded_arrow, __slice=np.full(n, at), __kind=np.full(n, DOCUMENT), __row=np.arange(row, row + n), __codes=[next(codes) for _ in range(n)], **columns)
                row += n

        for batch in batches:
            column = pc.fill_null(batch.column(len(keep)), b"")
            for lo, hi in pieces(column):
                for text in column.slice(lo, hi - lo).to_pylist():
                    found = split(b" " + text) if text else []
                    coded.append(np.fromiter((number.setdefault(s, len(number)) for s in found), np.uint32, len(found)))
                    held += len(text)
                rows.append(batch.slice(lo, hi - lo).select(list(range(len(keep)))))
                if held >= SLICE_BYTES:
                    yield from told()
                    at += sum(x.num_rows for x in rows)
                    rows, coded, number, held = [], [], {}, 0
        yield from told()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each slice's segments of a bucket, aligned; a segment that several slices name is aligned once."""
        a, b = ByteLevel(a_path), Pieces(b_path)
        number: dict[bytes, int] = {}
        whole: Aligned | None = None
        kept_bytes, last = 0, None
        for batch in batches:
            for r in batch.select(["__slice", "__bucket", "__codes", "__segments", "__sizes"]).to_pylist():
                if r["__bucket"] != last or kept_bytes >= KEPT_BYTES:
                    number, whole, kept_bytes, last = {}, None, 0, r["__bucket"]
                ends, text = np.cumsum(unpacked(r["__sizes"], np.uint32), dtype=np.int64).tolist(), unpacked(r["__segments"])
                names = [text[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)]
                new = [s for s in names if s not in number]
                if new:
                    number |= {s: i for i, s in enumerate(new, len(number))}
                    kept_bytes += sum(map(len, new))
                    parts = [align(new[i:j], a, b) for i, j in pieces(pa.array(new, pa.binary()), SEGMENT_BYTES)]
                    whole = joined([*([whole] if whole else []), *parts])
                own = whole.taken(np.fromiter(map(number.__getitem__, names), np.int64, len(names)))
                sent = dict(zip(SIDES, (packed(x.astype(np.uint32 if x.dtype != bool else np.uint8)) for x in (*own.sizes, *own.ids, *own.ends)), strict=True))
                yield filled(1, answer_arrow, __slice=[r["__slice"]], __kind=[SEGMENTS], __bucket=[last], __codes=[r["__codes"]], **{k: [v] for k, v in sent.items()})

    answer_type = T.StructType([f for f in fields if f.name != "__row"])
    answer_arrow = to_arrow_schema(answer_type)
    added = [T.StructField(n, T.LongType()) for n in RESULTS[:4]] + [T.StructField("groups_sha256", T.StringType())]
    composed_type = T.StructType([*kept, *added, *fields])
    composed_arrow = to_arrow_schema(composed_type)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents from their segments, with their pairs; and for each slice and bucket of pairs, how many of its documents link each."""
        slice_, answers, known = None, [], None
        documents = np.zeros(0, np.int64)

        def told() -> Iterator[pa.RecordBatch]:
            if known is not None and len(known[1]):
                bucket = _pair_bucket(known[1], buckets)
                own, first = np.unique(bucket, return_index=True)
                columns = {"__pairs": [packed_pairs(x) for x in np.split(known[1], first[1:])], "__counts": [packed(x.astype(np.uint32)) for x in np.split(documents, first[1:])]}
                yield filled(len(own), composed_arrow, __slice=np.full(len(own), slice_), __kind=np.full(len(own), PAIRS), __bucket=own, **columns)

        for batch in batches:
            of_slice = batch.column("__slice").to_numpy()
            kinds = batch.column("__kind").to_numpy()
            cuts = np.flatnonzero(np.append(True, (of_slice[1:] != of_slice[:-1]) | (kinds[1:] != kinds[:-1]))[: len(kinds)])
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(kinds)], strict=True):
                part = batch.slice(lo, hi - lo)
                if of_slice[lo] != slice_:
                    yield from told()
                    slice_, answers, known = of_slice[lo], [], None
                if kinds[lo] == SEGMENTS:
                    answers += part.select(["__codes", *SIDES]).to_pylist()
                    continue
                if known is None:
                    known, answers = _known(answers, buckets), []
                    documents = np.zeros(len(known[1]), np.int64)
                for i, j in pieces(part.column("__codes")):
                    some = part.slice(i, j - i)
                    columns, local, seen = _composed(some.column("__codes").to_pylist(), known)
                    documents += seen
                    lead = dict(zip(keep, some.columns[: len(keep)], strict=True))
                    yield filled(some.num_rows, composed_arrow, **lead, **columns, __slice=some.column("__slice"), __kind=some.column("__kind"), __pairs=[packed(x, rising=True) for x, _ in local], __times=[packed(x) for _, x in local])
        yield from told()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each slice's pairs of a bucket with the number of documents of all slices, negative if it isn't the highest of the A id."""
        last, rows = None, []

        def told() -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            keys = [unpacked_pairs(r["__pairs"]) for r in rows]
            own, back = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(back, np.concatenate([unpacked(r["__counts"], np.uint32) for r in rows]), len(own)).astype(np.int64)
            ids, first = np.unique(own // WIDTH, return_index=True)
            highest = np.repeat(np.maximum.reduceat(total, first), np.diff(np.append(first, len(own))))
            told_ = np.where(total == highest, total, -total)
            for r, key in zip(rows, keys, strict=True):
                yield filled(1, answer_arrow, __slice=[r["__slice"]], __kind=[PAIRS], __bucket=[last], __counts=[packed(told_[np.searchsorted(own, key)])])

        for batch in batches:
            for r in batch.select(["__slice", "__bucket", "__pairs", "__counts"]).to_pylist():
                if r["__bucket"] != last:
                    yield from told()
                    last, rows = r["__bucket"], []
                rows.append(r)
        yield from told()

    result_type = T.StructType([*kept, *[T.StructField(n, T.LongType()) for n in RESULTS[:6]], T.StructField("groups_sha256", T.StringType())])
    result_arrow = to_arrow_schema(result_type)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with the sums over their pairs."""
        slice_, answers, counts = None, [], None
        for batch in batches:
            of_slice = batch.column("__slice").to_numpy()
            kinds = batch.column("__kind").to_numpy()
            cuts = np.flatnonzero(np.append(True, (of_slice[1:] != of_slice[:-1]) | (kinds[1:] != kinds[:-1]))[: len(kinds)])
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(kinds)], strict=True):
                part = batch.slice(lo, hi - lo)
                if of_slice[lo] != slice_:
                    slice_, answers, counts = of_slice[lo], [], None
                if kinds[lo] == PAIRS:
                    answers += [unpacked(x, np.int64) for x in part.column("__counts").to_pylist()]
                    continue
                if counts is None:
                    counts, answers = np.concatenate([np.zeros(0, np.int64), *answers]), []
                best, sums = [], []
                for p, t in zip(part.column("__pairs").to_pylist(), part.column("__times").to_pylist(), strict=True):
                    found, times = counts[unpacked(p, np.uint32, rising=True)], unpacked(t, np.uint32).astype(np.int64)
                    best.append(int(times[found > 0].sum()))
                    sums.append(int((np.abs(found) * times).sum()))
                columns = {n: part.column(n) for n in (*keep, *RESULTS[:4], "groups_sha256")}
                yield pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.array(best if f.name == "n_best" else sums, f.type) for f in result_arrow], schema=result_arrow)

    def by(df: DataFrame, *keys: str) -> DataFrame:
        return df.repartition(keys[0]).sortWithinPartitions(*keys)

    coded = cut(picked.mapInArrow(tidied(code), coded_type), "coded")
    named = coded.where(F.col("__kind") == SEGMENTS).select("__slice", "__bucket", "__codes", "__segments", "__sizes")
    answers = by(named, "__bucket").mapInArrow(tidied(solve), answer_type)
    both = coded.where(F.col("__kind") == DOCUMENT).unionByName(answers, allowMissingColumns=True)
    composed = cut(by(both, "__slice", "__kind", "__bucket").mapInArrow(tidied(compose), composed_type), "composed")
    counted = composed.where(F.col("__kind") == PAIRS).select("__slice", "__bucket", "__pairs", "__counts")
    sums = by(counted, "__bucket").mapInArrow(tidied(compare), answer_type)
    all_ = composed.where(F.col("__kind") == DOCUMENT).unionByName(sums, allowMissingColumns=True)
    return by(all_, "__slice", "__kind", "__bucket").mapInArrow(tidied(finish), result_type)


def _known(answers: list[dict], buckets: int) -> tuple[Linked, np.ndarray]:
    """A slice's segments, in the order of their numbers, with pairs as numbers of the slice's pairs; and these, by bucket."""
    numbers, *sides = (np.concatenate([np.zeros(0, np.uint8), *[unpacked(r[k], np.uint8 if k.endswith("ends") else np.uint32, rising=k == "__codes") for r in answers]]).astype(np.int64) for k in ("__codes", *SIDES))
    found = linked(Aligned(sides[:2], sides[2:4], [x.astype(bool) for x in sides[4:]]).taken(np.argsort(numbers)))
    own, back = np.unique(found.pairs, return_inverse=True)
    order = np.lexsort((own, _pair_bucket(own, buckets)))
    place = np.empty(len(own), np.int64)
    place[order] = np.arange(len(own))
    found.pairs = place[back]
    return found, own[order]


def _composed(codes: list[bytes], known: tuple) -> tuple[dict[str, list], list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Of documents: their numbers and digests; their pairs and how often they are linked; of each pair of the slice, how many of them link it."""
    segments, pairs = known
    counts, texts = segments.counts, segments.texts
    begin = np.cumsum(segments.sizes) - segments.sizes
    found = [unpacked(c, np.uint32) for c in codes]
    numbers, digests = np.zeros((len(found), 4), np.int64), []
    keys, many = [], []
    for i, own in enumerate(found):
        if not len(own) or (counts[own, 2] < 0).any():
            digests.append("")
            continue
        numbers[i] = counts[own].sum(0)
        digests.append(hashlib.sha256(b";".join([texts[j] for j in own.tolist()])).hexdigest())
        distinct, n = np.unique(own, return_counts=True)
        size = segments.sizes[distinct]
        inside = spread(begin[distinct], size)
        keys.append(segments.pairs[inside] + i * len(pairs))
        many.append(segments.times[inside] * np.repeat(n, size))
    flat = np.concatenate([np.zeros(0, np.int64), *keys])
    distinct, back = np.unique(flat, return_inverse=True)
    times = np.bincount(back, np.concatenate([np.zeros(0, np.int64), *many]), len(distinct)).astype(np.uint32)
    of, local = np.divmod(distinct, max(1, len(pairs)))
    cuts = np.searchsorted(of, np.arange(1, len(found)))
    parts = list(zip(np.split(local.astype(np.uint32), cuts), np.split(times, cuts), strict=True))
    return dict(zip(RESULTS[:4], numbers.T.tolist(), strict=True)) | {"groups_sha256": digests}, parts, np.bincount(local, minlength=len(pairs))
